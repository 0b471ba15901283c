"""Repeated passages by sparse suffixes at minimiser positions.

A text is a sequence of word hashes. Of all suffixes, those are kept that start
at a minimiser: in every window of ``min_words`` words, the position whose next
``HEAD`` words have the least hash. The choice depends on the window's content
alone, so two equal windows keep the same suffix. About one suffix in eighteen
stays.

Kept suffixes meet by the hash of their heads; no order among heads is needed,
so none is made. A head that occurs once ends there. For the others the
match is extended left and right: first by the whole block of windows that
share the suffix, which settles most of them at one comparison, then, where a
head's blocks differ, window by window for one member of each distinct block.
A window is found repeated exactly if it occurs at two places, in two documents
or in one; touching windows join into maximal spans.

Comparing only neighbours in suffix order would miss repeats whose left parts
differ from the neighbours', so extension compares with all suffixes of a head,
by hash and grouped minimum. Hot heads are combined before the shuffle; members
of a block are judged against its first occurrence only, never pairwise.

Defined results: words are runs without ASCII space, A-Z lowered; texts of
fewer than ``min_words`` words, null and empty texts have no repeats; texts of
any length are read whole; the first occurrence, in the order of id, is kept
and later ones are copies; rows with equal id and text are one document; a null
id sorts first; an empty table gives an empty table; columns other than id and
text are carried by ``dedup`` untouched, and its own helper columns begin with
two underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Slice, mix, slices, words
from .graphs import marked, only_ids

MIN_WORDS = 50
HEAD = 16
_MOST = np.iinfo(U64).max


_STEP = U64(0xD6E8FEB86659FD93)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """From each place with ``n`` words to come, the hash of these words in
    order: hashes of 1, 2, 4, ... words, each mixed of two halves, are joined."""
    total = len(h) - n + 1
    if total < 1:
        return np.empty(0, U64)
    out, done, size, level = None, 0, 1, h
    while size <= n:
        if n & size:
            part = level[done : done + total]
            out = part if out is None else mix(out * _STEP + part)
            done += size
        if 2 * size <= n:
            level = mix(level[:-size] * _STEP + level[size:])
        size *= 2
    return out


class Windows:
    """Word hashes of a slice and the hashes of its windows of ``min_words``."""

    def __init__(self, s: Slice, min_words: int = 0):
        self.h, self.starts, self.ends, self.row = words(s)
        self.first = np.searchsorted(self.row, np.arange(len(s.rows) + 1))
        self.full = runs(self.h, min_words) if min_words else None

    def anchors(self, min_words: int) -> tuple[np.ndarray, ...]:
        """(position, first and last window start, head hash, block hash) of
        the kept suffixes, by word index in the slice."""
        n = len(self.h)
        none = np.empty(0, np.int64)
        if n < min_words:
            return none, none, none, none.astype(U64), none.astype(U64)
        heads = runs(self.h, HEAD)
        if heads is self.h:
            heads = heads.copy()
        heads[self.row[HEAD - 1 :] != self.row[: n - HEAD + 1]] = _MOST
        width = min_words - HEAD + 1
        least = np.lib.stride_tricks.sliding_window_view(heads, width).argmin(axis=1)
        start = np.flatnonzero(self.row[min_words - 1 :] == self.row[: n - min_words + 1])
        if not len(start):
            return none, none, none, none.astype(U64), none.astype(U64)
        pos = start + least[start]
        new = np.ones(len(start), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)
        lo = start[new]
        hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        pos = pos[new]
        # the first and the last window overlap, hence hold all words of the block
        block = mix(mix(self.full[lo] * _STEP + self.full[hi]) ^ mix((pos - lo).astype(U64) + (hi - lo).astype(U64) * U64(1 << 20)))
        return pos, lo, hi, heads[pos], block


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k (identity of a row by id and text), text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("k"), F.col(text_col).alias("text"))


def _suffixes(keyed: DataFrame, min_words: int) -> DataFrame:
    kind = dict(keyed.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(2)):
                w = Windows(s, min_words)
                pos, lo, hi, head, block = w.anchors(min_words)
                row = w.row[pos] if len(pos) else pos
                first = w.first[row] if len(pos) else pos
                take = pa.array(row + s.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x - first).astype(np.int32)) for x in (pos, lo, hi))],
                    names=["head", "block", "id", "k", "pos", "lo", "hi"],
                )

    return keyed.mapInArrow(run, f"head bigint, block bigint, id {kind}, k bigint, pos int, lo int, hi int")


def _window_rows(joined: DataFrame, min_words: int) -> DataFrame:
    """(window hash, id, k, start, many) of the windows lo to hi of each listed
    block; ``many`` tells that the whole block occurs elsewhere too."""
    kind = dict(joined.dtypes)["id"]

    def run(batches):
        for batch in batches:
            lists = batch.column(3).to_pylist()
            for s in slices(batch.column(2)):
                w = Windows(s, min_words)
                at, row, many = [], [], []
                for r in range(len(s.rows)):
                    for x in lists[s.rows[r]] or []:
                        at.append(np.arange(x["lo"], x["hi"] + 1) + w.first[r])
                        row.append(np.full(x["hi"] - x["lo"] + 1, r))
                        many.append(np.full(x["hi"] - x["lo"] + 1, x["many"]))
                if not at:
                    continue
                at, row = np.concatenate(at), np.concatenate(row)
                take = pa.array(row + s.rows.start)
                hashes = w.full[at]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((at - w.first[row]).astype(np.int32)), pa.array(np.concatenate(many))], names=["window", "id", "k", "start", "many"])

    return joined.select("id", "k", "text", "blocks").mapInArrow(run, f"window bigint, id {kind}, k bigint, start int, many boolean")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(k, lo, hi, later, source): word spans [lo, hi) that occur elsewhere too,
    not yet joined; ``later`` tells a copy from the first occurrence, ``source``
    is the id that has the first occurrence."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    keyed = _keyed(docs, id_col, text_col)
    all_ = scratch.keep(_suffixes(keyed, min_words), "suffixes")
    place = F.xxhash64("k", "pos")
    heads = all_.groupBy("head").agg(F.min(place).alias("a"), F.max(place).alias("b"), (F.min("block") != F.max("block")).alias("mixed"))
    met = scratch.keep(all_.join(heads.where("a <> b").select("head", "mixed"), "head"), "repeated-heads")
    scratch.drop(all_)
    me = F.struct("id", "k", "pos")
    blocks = met.groupBy("head", "block").agg(F.min(me).alias("rep"), (F.min(place) != F.max(place)).alias("many"))
    judged = met.join(blocks, ["head", "block"]).withColumn("is_rep", me.eqNullSafe(F.col("rep")))
    judged = scratch.keep(judged.select("id", "k", "lo", "hi", "mixed", "many", "is_rep", F.col("rep.id").alias("source")), "judged")
    end = (F.col("hi") + min_words).alias("hi")
    whole = judged.where("many and not (mixed and is_rep)").select("k", "lo", end, (~F.col("is_rep")).alias("later"), "source")
    listed = judged.where("mixed and is_rep").groupBy("k").agg(F.collect_list(F.struct("lo", "hi", "many")).alias("blocks"))
    texts = only_ids(keyed, "k", listed.select("k")).dropDuplicates(["k"])
    rows = scratch.keep(_window_rows(texts.join(listed, "k"), min_words), "windows")
    here = F.xxhash64("k", "start")
    firsts = rows.groupBy("window").agg(F.min(F.struct("id", "k", "start")).alias("rep"), F.min(here).alias("a"), F.max(here).alias("b"), F.max("many").alias("again")).where("a <> b or again").select("window", "rep")
    single = rows.join(firsts, "window").select("k", F.col("start").alias("lo"), (F.col("start") + min_words).alias("hi"), (~F.struct("id", "k", "start").eqNullSafe(F.col("rep"))).alias("later"), F.col("rep.id").alias("source"))
    return scratch.keep(whole.union(single), "repeats")


def _joined(parts: list[dict], later: bool) -> list[tuple[int, int, object]]:
    """Touching or overlapping spans of one kind, joined; the source of the first."""
    out: list[tuple[int, int, object]] = []
    for x in sorted((x for x in parts if x["later"] == later), key=lambda x: (x["lo"], x["hi"])):
        if out and x["lo"] <= out[-1][1]:
            a, b, source = out[-1]
            out[-1] = (a, max(b, x["hi"]), source)
        else:
            out.append((x["lo"], x["hi"], x["source"]))
    return out


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("k").agg(F.collect_set(F.struct("lo", "hi", "later", "source")).alias("__parts"))


def spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per maximal repeated span: id, first_word, n_words, later (a copy
    of an earlier place), source (id with the first occurrence)."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    found = repeats(docs, min_words, id_col, text_col, scratch)
    ids = _keyed(docs, id_col, text_col).select("id", "k")
    kind = dict(ids.dtypes)["id"]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"row": [], "first_word": [], "n_words": [], "later": [], "source": []}
            for r, parts in enumerate(batch.column(1).to_pylist()):
                for later in (False, True):
                    for a, b, source in _joined(parts, later):
                        for name, x in zip(out, (r, a, b - a, later, source)):
                            out[name].append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["first_word"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["later"], pa.bool_()), pa.array(out["source"], batch.column(0).type)],
                names=["id", "first_word", "n_words", "later", "source"],
            )

    joined = only_ids(ids, "k", found.select("k")).join(_by_document(found), "k").select("id", "__parts")
    return joined.mapInArrow(run, f"id {kind}, first_word bigint, n_words bigint, later boolean, source {kind}").withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without later copies of repeated spans. Documents without copies
    stay as they are; one that consists of copies alone goes."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    found = _by_document(repeats(docs, min_words, id_col, text_col, scratch).where("later"))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    names = docs.columns
    text_at = names.index(text_col)
    found = scratch.keep(found.withColumnRenamed("k", "__k"), "copies")
    # texts without copies pass by; only those that may have some meet their spans
    near = marked(docs.withColumn("__k", key), "__k", found.select("__k"))
    joined = near.where("__maybe").join(found, "__k", "left")
    untouched = near.where("not __maybe").select(*names).union(joined.where("__parts is null").select(*names))

    def run(batches):
        for batch in batches:
            parts = batch.column(len(names)).to_pylist()
            texts, keep = [], []
            for s in slices(batch.column(text_at)):
                w = Windows(s)
                for r in range(len(s.rows)):
                    lo, hi = w.first[r], w.first[r + 1]
                    raw, base, at, kept = s.text(r), int(s.bounds[r]), 0, []
                    for a, b, _ in _joined(parts[s.rows[r]], True):
                        kept.append(raw[at : int(w.starts[lo + a]) - base])
                        at = int(w.starts[lo + b]) - base if lo + b < hi else len(raw)
                    text = b"".join([*kept, raw[at:]])
                    keep.append(bool(text.strip()))
                    texts.append(text.decode())
            cols = list(batch.columns[: len(names)])
            cols[text_at] = pa.array(texts, batch.column(text_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    cut = joined.where("__parts is not null").select(*names, "__parts").mapInArrow(run, docs.schema)
    return untouched.union(cut)
