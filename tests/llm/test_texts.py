"""BPE, packing, sharding, WARC and the language model against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrane.llm import bpe, lm, packing, sharding, warc
from terrane.llm.common import Scratch, forget, slices
from terrane.llm.queries import vocabulary

from .conftest import prose, rows

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abstmdlrve '\n\t\r.!09é×½²ÀßİĀ\x1c\x85\xa0—漢", "'re", "<|endoftext|>", "<|"]), max_size=24).map("".join), min_size=1, max_size=6))
def test_splitting_is_the_librarys(texts):
    for path, own in ((BYTES, bpe.load(BYTES)), (WORDS, packing.load(WORDS))):
        tok, out = library(path), []
        for s in slices(pa.array(texts, pa.string())):
            ids, bounds = own.encode_slice(s)
            out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert out == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_split_pieces_go_to_the_model_alone():
    """Every character of the quick way, alone and in words, without the library's own splitting."""
    texts = [f"{chr(c)} {chr(c)}{chr(c)} ab{chr(c)}Ré{chr(c)}'s 7{chr(c)}" for c in range(1, 0x250)] + [prose(31, 500), "é" * 5000]
    tok, own, done = library(WORDS), packing.FoldingTokens(WORDS), 0
    own.tokenizer = None
    for s in slices(pa.array(texts)):
        odd = packing.pretokens(s, b"<|", fold=True)[-1]
        quick = [t for t, x in zip(texts[s.rows.start : s.rows.stop], odd) if not x]
        done += len(quick)
        for part in slices(pa.array(quick)):
            ids, bounds = own.encode_slice(part)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in quick]
    assert done > 500


def test_tokens_make_room_for_the_next_operator():
    own = packing.load(WORDS)
    assert packing.load(WORDS) is own
    forget()
    assert packing.load.cache_info().currsize == 0 and packing.load(WORDS) is not own


def test_bpe(docs, empty):
    tok = library(BYTES)
    got = bpe.digests(docs, BYTES).collect()
    want = Counter()
    for i, text, *_ in rows():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    both = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert Counter(map(tuple, both)) == Counter((i, t or "") for i, t, *_ in rows())
    assert bpe.digests(empty, BYTES).count() == 0


def thue_morse(n, zero="a", one="b"):
    """Two complementary texts; any polynomial modulo 2**64 gives them one hash."""
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join(one if x else zero for x in bits), "".join(zero if x else one for x in bits)


def test_hashes_tell_thue_morse_apart(spark):
    from terrane.llm import common, minhash, suffix_dedup

    pair = thue_morse(11)
    sets = [x for s in slices(pa.array(pair)) for x in minhash.shingle_sets(s)]
    assert not len(set(sets[0].tolist()) & set(sets[1].tolist()))
    long = [" ".join(x) for x in thue_morse(11)]
    windows = [set(suffix_dedup.Windows(s, 1100).full.tolist()) for t in long for s in slices(pa.array([t]))]
    assert not windows[0] & windows[1]
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, long[0]), (4, long[1])], "doc_id long, text string").coalesce(1)
    for path, found in ((BYTES, bpe.digests(docs, BYTES)), (WORDS, packing.pieces(docs, WORDS))):
        tok = library(path)
        n = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) if path == BYTES else (r["length"], r["ids_crc32"]) for r in found.collect()}
        for i, text in ((1, pair[0]), (2, pair[1]), (3, long[0]), (4, long[1])):
            ids = tok.encode(text, add_special_tokens=False).ids + ([0] if path == WORDS else [])
            if len(ids) <= 2048:
                raw = struct.pack(f"<{len(ids)}I", *ids)
                assert n[i] == (len(ids), hashlib.sha256(raw).hexdigest() if path == BYTES else zlib.crc32(raw))
    assert {r["doc_id"]: r["component_id"] for r in minhash.link(docs.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
    got = {r["doc_id"]: r["n_known"] for r in lm.score(docs.where("doc_id < 3"), docs["doc_id"] == 1).collect()}
    assert got == {1: 2, 2: 1}
    assert len({common.span_hashes(s.data, s.bounds[:-1], s.bounds[1:])[0] for t in pair for s in slices(pa.array([t]))}) == 2


def test_cache_holds_bytes_against_hashes(monkeypatch):
    """With a hash that always collides, tokens still get their own ids."""
    import numpy as np

    from terrane.llm import common

    monkeypatch.setattr(common, "span_hashes", lambda data, a, b: np.zeros(len(a), common.U64))
    cache = common.TokenCache(lambda pieces: [[len(p), *p] for p in pieces])
    data = np.frombuffer(b"abcabd" + b"x" * 80 + b"y" * 80, np.uint8)
    for a, b in (([0], [3]), ([3], [6]), ([0, 3], [3, 6]), ([6], [86]), ([86], [166]), ([0], [3])):
        ids, size = cache.ids(data, np.array(a), np.array(b))
        want = [[y - x, *data[x:y].tolist()] for x, y in zip(a, b)]
        assert ids.tolist() == sum(want, []) and size.tolist() == [len(w) for w in want]


def test_merging_skips_stale_entries():
    own = bpe.load(BYTES)
    tok = library(BYTES)
    for word in ("aaaaaaaa", "mississippi", "lowerlowest", prose(1, 1).replace(" ", ""), "abababababab" * 20):
        assert own.merge(word.encode()) == tok.encode(word, add_special_tokens=False).ids


def test_packing(docs, empty):
    tok = library(WORDS)
    got = packing.packed(docs, WORDS).collect()
    want = Counter()
    for i, text, *_ in rows():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r["length"] for r in got)
    assert len(filled) <= math.ceil(tokens / 2048) + 3
    assert packing.packed(empty, WORDS).count() == 0
    pieces = packing.pieces(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS, with_ids=True)
    scratch = Scratch(docs.sparkSession, "t")
    kept = scratch.keep(pieces, "p")
    seqs = packing.sequences(packing.pack(kept, scratch), kept).collect()
    assert all(len(r["ids"]) == r["n_tokens"] <= 2048 for r in seqs)


def test_packers_close_the_fullest():
    p = packing.Packer(10, open_bins=2)
    assert p.place(6) == (0, 0) and p.place(7) == (1, 0)
    assert p.place(3) == (1, 7)  # the tightest that fits
    assert p.place(5) == (2, 0) and p.place(5) == (2, 5)
    assert p.place(8) == (3, 0)  # bins 1 and 2 are full, so 0 stays open
    assert p.place(9) == (4, 0)  # 3 is the fullest and closes
    assert p.place(4) == (0, 6)
    many = packing.Packer(100, 16)
    sizes = [1 + (k * 37) % 60 for k in range(5000)]
    at = defaultdict(int)
    for s in sizes:
        b, o = many.place(s)
        assert at[b] == o
        at[b] += s
    assert max(at.values()) <= 100 and len(at) < 1.05 * sum(sizes) / 100


def test_several_streams_repeat_exactly(spark):
    docs = spark.createDataFrame([(k, prose(k, 30 + k % 90)) for k in range(300)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    kept = scratch.keep(packing.pieces(docs, WORDS), "p")
    one, two = (sorted(map(tuple, packing.pack(kept, scratch, per_packer=100).collect())) for _ in range(2))
    assert one == two and len({r[5] >> 40 for r in one}) == 3


def test_sharding(docs, empty):
    got = sharding.byte_shards(docs, 3).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in order]
    assert keys == sorted(keys)
    before, total = 0, sum(r["size"] for r in got)
    for k, r in enumerate(order):
        assert r["shard"] == (2 * before + r["size"]) * 3 // (2 * total)
        assert r["slot"] == (0 if k == 0 or order[k - 1]["shard"] != r["shard"] else order[k - 1]["slot"] + 1)
        before += r["size"]
    assert sharding.byte_shards(empty, 3).count() == 0
    even = sharding.byte_shards(docs.sparkSession.range(1000).selectExpr("id as doc_id", "'same' as text"), 8).groupBy("shard").count().collect()
    assert {r["count"] for r in even} == {125}


PAGES = [(1, "http://a", "<html><title>T</title><script>x('</p>')</script><p>a &amp;lt; b<br>c</p><!-- no --></html>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "plain  text"), (5, "http://e", "<style>p{"), (None, "http://f", "<b>x</b>é" + "<p>long</p>" * 5000), (1, "http://a", "<html><title>T</title><script>x('</p>')</script><p>a &amp;lt; b<br>c</p><!-- no --></html>")]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as block", "'y' as record_id")
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 2 * len(PAGES)
    for r in got:
        s = source[r["refers_to"]]
        assert r["source_payload_digest"] == "sha1:" + hashlib.sha1(s["body"].encode()).hexdigest() == s["payload_digest"]
        assert r["block_digest"] == "sha1:" + hashlib.sha1(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
        assert r["target_uri"] == s["target_uri"]
        if r["warc_type"] == "metadata":
            assert r["refers_to"] in r["block"] and s["payload_digest"] in r["block"] and "source-http-status: 200" in r["block"]
    text = {r["page_id"]: r["block"] for r in got if r["warc_type"] == "conversion"}
    assert text[1] == "T\na &lt; b\nc" and text[2] == "" and text[4] == "plain text" and text[5] == "" and text[None].startswith("xé\nlong\nlong")
    folder = str(tmp_path / "w")
    done = warc.write_warc(warc.derivatives(warc.responses(pages)), folder).collect()
    assert sum(r["records"] for r in done) == 2 * len(PAGES)
    import gzip

    raw = b"".join(gzip.open(r["file"]).read() for r in done)
    first = warc.parse_record(raw)
    assert first["version"] == "WARC/1.1" and first["warc-refers-to"] in source and first["block"]
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_language_model(docs, empty, head, monkeypatch):
    from terrane.llm.common import crc_of_id

    monkeypatch.setattr(lm.known_words, "__defaults__", (head,))
    got = lm.score(docs, crc_of_id() % 7 != 2).collect()
    train, texts = Counter(), []
    for i, text, *_ in rows():
        w = [*words(text), None]
        texts.append((i, w))
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update(w)
    n, v = sum(train.values()), len(train)
    want = Counter((i, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in texts)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if head == lm.HEAD:
        assert lm.score(empty, crc_of_id() % 7 != 2).count() == 0
        none = lm.score(docs, crc_of_id() < 0).collect()
        assert {r["n_known"] for r in none} == {0} and len(none) == len(rows())


def test_model_is_a_distribution_and_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    freq = np.r_[np.ones(lm.SHAPES), 50.0, np.full(20, 10.0)]
    net = lm.Network(freq)
    v = len(freq)
    hs = rng.normal(0, 0.5, (3, lm.HIDDEN)).astype(np.float32)
    total = np.zeros(3)
    for y in range(v):
        total += np.exp(net.output(hs, np.full(3, y))[0])
    assert np.allclose(total, 1, atol=1e-4)
    # a cycle of items is learnt far beyond their frequencies
    text = np.r_[np.tile(lm.SHAPES + 1 + np.arange(20), 30), lm.SHAPES].astype(np.int32)
    items, bounds = np.tile(text, 20), np.arange(21) * len(text)
    def loss():
        h, out = None, []
        for x, y, reset, valid, _ in lm.feed(items, bounds):
            hs, h, _ = net.run(x, reset, lm.carried(h, x), keep=False)
            out.append(net.output(hs.reshape(-1, lm.HIDDEN)[valid.ravel()], y.ravel()[valid.ravel()])[0])
        return -np.concatenate(out).mean()
    before = loss()
    for _ in range(8):
        lm.train_texts(net, items, bounds)
    assert loss() < 0.5 * before


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(1)
    freq = np.r_[np.ones(lm.SHAPES), np.full(10, 5.0)]
    x, y = rng.integers(0, len(freq), (4, 3)), rng.integers(0, len(freq), (4, 3))
    reset = np.zeros((4, 3), bool)
    reset[0] = reset[2, 1] = True
    valid = np.ones((4, 3), bool)
    valid[3, 2] = False
    h0 = np.zeros((3, lm.HIDDEN), np.float32)
    net = lm.Network(freq)
    for v in net.p.values():  # larger weights, so that differences stand out
        v += rng.normal(0, 0.3, v.shape).astype(np.float32) * (v > -20)
    grads, (rows_, sums), _ = net.gradients(x, y, reset, valid, h0)

    def loss():
        hs, _, _ = net.run(x, reset, h0, keep=False)
        return -net.output(hs.reshape(-1, lm.HIDDEN)[valid.ravel()], y.ravel()[valid.ravel()])[0].astype(np.float64).sum()

    def slope(name, cell, eps=2e-2):
        at = net.p[name][cell]
        net.p[name][cell] = at + eps
        up = loss()
        net.p[name][cell] = at - eps
        down = loss()
        net.p[name][cell] = at
        return (up - down) / (2 * eps)

    k = net.cls[y[1, 1]]
    for name, cell in (("U", (1, 5)), ("U", (3, lm.HIDDEN + 2)), ("U", (0, 2 * lm.HIDDEN + 7)), ("Wc", (2, 1)), ("bc", (int(k),)), ("Wo", (int(k), 4, 0)), ("bo", (int(k), 0))):
        assert grads[name][cell] == pytest.approx(slope(name, cell), rel=0.05, abs=5e-3), name
    for r, column in ((0, 1), (1, lm.HIDDEN + 3), (2, 2 * lm.HIDDEN + 5)):
        assert sums[r, column] == pytest.approx(slope("A", (int(rows_[r]), column)), rel=0.05, abs=5e-3)


def test_scores_are_plain_sums():
    """Text by text and token by token, the state carried through: the sums that
    lanes and windows give, in training order too."""
    import numpy as np

    rng = np.random.default_rng(4)
    freq = np.r_[np.ones(lm.SHAPES), 50.0, np.full(20, 10.0)]
    net = lm.Network(freq)
    net.flat += rng.normal(0, 0.2, net.flat.shape).astype(np.float32) * (net.flat > -20)
    sizes = np.r_[rng.integers(1, 60, 700), 3000, 1500, 1]
    bounds = np.append(0, np.cumsum(sizes))
    items = rng.integers(0, len(freq), bounds[-1]).astype(np.int32)
    items[bounds[1:] - 1] = lm.SHAPES
    total, seen, h = np.zeros(len(sizes)), [], None
    for x, y, reset, valid, text in lm.feed(items, bounds):
        hs, h, _ = net.run(x, reset, lm.carried(h, x), keep=False)
        out, _ = net.output(hs.reshape(-1, lm.HIDDEN)[valid.ravel()], y.ravel()[valid.ravel()])
        total += np.bincount(text[valid], weights=out, minlength=len(sizes))
        seen.append(y[valid])
    assert (np.bincount(np.concatenate(seen), minlength=len(freq)) == np.bincount(items, minlength=len(freq))).all()
    H, p = lm.HIDDEN, net.p
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for i in (0, 350, 700, 701, 702):
        h, was, want = np.zeros(H), lm.SHAPES, 0.0
        for y in items[bounds[i] : bounds[i + 1]]:
            a, u = p["A"][was], h @ p["U"]
            r, z = sigmoid(a[:H] + u[:H]), sigmoid(a[H : 2 * H] + u[H : 2 * H])
            n = np.tanh(a[2 * H :] + r * u[2 * H :])
            h = n + z * (h - n)
            c = net.cls[y]
            outer = h @ p["Wc"] + p["bc"]
            inner = (h @ p["Wo"][c] + p["bo"][c])[: net.held[c]]
            want += outer[c] - np.log(np.exp(outer).sum()) + inner[net.slot[y]] - np.log(np.exp(inner).sum())
            was = y
        assert abs(total[i] - want) < 1e-3 * max(1, abs(want)), i
