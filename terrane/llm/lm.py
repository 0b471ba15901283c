"""Gated recurrent language model in numpy, scoring whole documents.

Training counts every word of the training documents; the counts give the base
score and the model's vocabulary. The network reads the most frequent words and
``shapes`` (classes of rarer words by their bytes); a gated recurrent unit
predicts the next item through a softmax factored into item classes and items
within the class. A rarer word has the probability of its shape times its
smoothed share of the shape's counts, so the model is one distribution over all
words, with one unseen word a shape.

Backpropagation is truncated to windows of ``WINDOW`` steps, while the state is
carried across windows to the end of a document, in training and in scoring.
Texts run side by side in lanes of near-equal length, whole and in order; lanes
that end fall away, and windows lengthen as they do. Training begins on one
task with ``PASSES`` over a bounded sample, which puts all replicas on one
footing, then every partition trains once on all its training documents and the
replicas are averaged, weighted by tokens, in two streaming steps. So ``score``
depends on how the table is partitioned; the counts and ``base_score`` do not.

Counts are pre-aggregated before the shuffle. Frequent words (at most ``HEAD``)
are broadcast; only the rest of a document's words, distinct within it, are
joined to their counts.

Defined results: a null or empty text is the end token alone; texts of any
length are scored whole; a null id counts as the empty string where the split
is made; repeated rows are scored each; with no training text all counts are
zero and scores follow from smoothing; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, drawn, gather, mix, slices, words

HIDDEN = 16
WINDOW = 16
VOCABULARY = 1024
CLASSES = 32
HEAD = 1 << 19
#: Documents of the first, single-task training, and how often it reads them.
WARM_DOCUMENTS = 2048
PASSES = 2
RATE = 0.05
LANES = 512
#: Tokens that go through the network together.
GROUP = 2_000_000
#: Steps between outputs in scoring, where no gradient bounds the window.
SCORE_WINDOW = 64

END = int(mix(np.array([0xE0D], U64)).view(np.int64)[0])
SHAPES = 64


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class for each word from its bytes: ending, script and length."""
    if not len(starts):
        return np.empty(0, np.int64)
    last = data[ends - 1]
    kind = np.zeros(256, np.int64)
    for k, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b".", b",", b"!?", b"*", b"%", b"#", b"&", b"$", b"0123456789", b"|-_/\\:;=+")):
        kind[list(group)] = k + 1
    kind[128:] = 12
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data >= 0x80, out=wide[1:])
    foreign = wide[ends] > wide[starts]
    size = (ends - starts > 7).astype(np.int64)
    return (kind[last] * 2 + foreign) * 2 + size


class Words:
    """Word counts as the workers need them: sorted head, totals, item numbers."""

    def __init__(self, head: list[tuple[int, int, int]], n: int, distinct: int, by_shape: dict[int, tuple[int, int]]):
        rank = sorted(head, key=lambda x: (-x[1], x[0]))
        top = [x for x in rank if x[0] != END][: VOCABULARY - SHAPES - 1]
        self.n, self.distinct = n, distinct
        keys = np.array([x[0] for x in head], np.int64).view(U64) if head else np.empty(0, U64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.array([x[1] for x in head], np.int64)[order] if head else np.empty(0, np.int64)
        self.bits = min(22, max(1, len(self.keys).bit_length() + 1))
        self.radix = np.searchsorted(self.keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))
        #: items: shapes first, the end token, then frequent words
        item = {x[0]: SHAPES + 1 + k for k, x in enumerate(top)} | {END: SHAPES}
        signed = self.keys.view(np.int64).tolist()
        self.items = np.array([item.get(k, -1) for k in signed], np.int64) if head else np.empty(0, np.int64)
        self.size = SHAPES + 1 + len(top)
        freq = np.ones(self.size)
        count = {x[0]: x[1] for x in head}
        self.documents = count.get(END, 0)
        freq[SHAPES] += count.get(END, 0)
        for k, x in enumerate(top):
            freq[SHAPES + 1 + k] += x[1]
        own_n, own_v = np.zeros(SHAPES), np.zeros(SHAPES)
        for x in top:
            own_n[x[2]] += x[1]
            own_v[x[2]] += 1
        #: log10 of the smoothed total of each shape's rarer words
        self.shape_log = np.zeros(SHAPES)
        for s in range(SHAPES):
            total, kinds = by_shape.get(s, (0, 0))
            total, kinds = total - own_n[s], kinds - own_v[s]
            freq[s] += total
            self.shape_log[s] = np.log10(total + kinds + 1)
        self.freq = freq

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 if not in the head, item or -1) of each hash."""
        count, item = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return count, item
        # keys are sorted: those that share their top bits lie together
        top = (h >> U64(64 - self.bits)).astype(np.int64)
        at, stop = self.radix[top], self.radix[top + 1]
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            hit = self.keys[at] == h[left]
            count[left[hit]], item[left[hit]] = self.counts[at[hit]], self.items[at[hit]]
            at = at + 1
            go = ~hit & (at < stop)
            left, at, stop = left[go], at[go], stop[go]
        return count, item


class Network:
    """GRU with item embeddings in gate space and a two-level softmax."""

    def __init__(self, freq: np.ndarray, flat: np.ndarray | None = None):
        v = len(freq)
        order = np.argsort(-freq, kind="stable")
        share = np.sqrt(freq[order])
        n_classes = min(CLASSES, v)
        # classes of equal square-root mass; none larger than four times the mean
        most = 4 * -(-v // n_classes)
        cls, k, held, mass, step = np.zeros(v, np.int64), 0, 0, 0.0, share.sum() / n_classes
        for i, w in zip(order.tolist(), share.tolist()):
            if held and (mass >= step * (k + 1) or held >= most) and k < n_classes - 1:
                k, held = k + 1, 0
            cls[i] = k
            held += 1
            mass += w
        self.cls, self.classes = cls, k + 1
        self.slot = np.zeros(v, np.int64)
        size = np.zeros(self.classes, np.int64)
        for i in order.tolist():
            self.slot[i] = size[cls[i]]
            size[cls[i]] += 1
        self.width, self.held = int(size.max()), size.tolist()
        H = HIDDEN
        shape = {"A": (v, 3 * H), "U": (H, 3 * H), "Wc": (H, self.classes), "bc": (self.classes,), "Wo": (self.classes, H, self.width), "bo": (self.classes, self.width)}
        total = sum(int(np.prod(x)) for x in shape.values())
        self.flat = np.zeros(total, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        self.p: dict[str, np.ndarray] = {}
        for name, x in shape.items():
            n = int(np.prod(x))
            self.p[name] = self.flat[at : at + n].reshape(x)
            at += n
        if flat is None:
            rng = np.random.default_rng(7)
            self.p["A"][:] = rng.normal(0, 0.3, (v, 3 * H))
            self.p["U"][:] = rng.normal(0, H**-0.5, (H, 3 * H))
            self.p["A"][:, H : 2 * H] += 0.5
            mass_c = np.bincount(cls, weights=freq, minlength=self.classes)
            self.p["bc"][:] = np.log(mass_c / mass_c.sum())
            self.p["bo"][:] = -30.0
            self.p["bo"][cls, self.slot] = np.log(freq / mass_c[cls])
            self.p["Wc"][:] = rng.normal(0, 0.02, (H, self.classes))
            self.p["Wo"][:] = rng.normal(0, 0.02, (self.classes, H, self.width))
        self.square: dict[str, np.ndarray] | None = None

    def run(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool):
        """States of a window: x (steps, lanes), reset where a document begins."""
        p, H = self.p, HIDDEN
        steps, lanes = x.shape
        a = p["A"][x]
        hs = np.empty((steps, lanes, H), np.float32)
        saved = [np.empty((steps, lanes, k * H), np.float32) for k in (1, 2, 1, 1)] if keep else None
        any_reset = reset.any(axis=1).tolist()
        for t in range(steps):
            if any_reset[t]:
                h = np.where(reset[t][:, None], np.float32(0), h)
            u = h @ p["U"]
            g = a[t]
            rz = 0.5 * np.tanh(0.5 * (g[:, : 2 * H] + u[:, : 2 * H])) + 0.5
            r, z = rz[:, :H], rz[:, H:]
            n = np.tanh(g[:, 2 * H :] + r * u[:, 2 * H :])
            if keep:
                for store, value in zip(saved, (h, rz, n, u[:, 2 * H :])):
                    store[t] = value
            h = n + z * (h - n)
            hs[t] = h
        return hs, h, saved

    def output(self, hs: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each target; gradients too if asked."""
        p = self.p
        # in the order of classes: each class is then one slice of every array
        order = np.argsort(self.cls[y], kind="stable")
        hs, y = hs[order], y[order]
        c, slot, at = self.cls[y], self.slot[y], np.arange(len(y))
        cut = np.searchsorted(c, np.arange(self.classes + 1)).tolist()
        # states lie in (-1, 1) and weights stay small, so no maximum needs taking off
        logits = hs @ p["Wc"]
        logits += p["bc"]
        log_p = logits[at, c]
        np.exp(logits, out=logits)
        total = logits.sum(axis=1)
        log_p -= np.log(total)
        dh = None
        if grads is not None:
            logits /= total[:, None]
            logits[at, c] -= 1
            grads["Wc"], grads["bc"] = hs.T @ logits, logits.sum(axis=0)
            dh = logits @ p["Wc"].T
            grads["Wo"], grads["bo"] = np.zeros_like(p["Wo"]), np.zeros_like(p["bo"])
        for k in range(self.classes):
            a, b = cut[k], cut[k + 1]
            if a == b:
                continue
            w, own = self.held[k], hs[a:b]
            weight = p["Wo"][k][:, :w]
            lo = own @ weight
            lo += p["bo"][k][:w]
            here = at[: b - a]
            got = lo[here, slot[a:b]]
            np.exp(lo, out=lo)
            total = lo.sum(axis=1)
            log_p[a:b] += got - np.log(total)
            if grads is not None:
                lo /= total[:, None]
                lo[here, slot[a:b]] -= 1
                grads["Wo"][k][:, :w], grads["bo"][k][:w] = own.T @ lo, lo.sum(axis=0)
                dh[a:b] += lo @ weight.T
        out = np.empty_like(log_p)
        out[order] = log_p
        if dh is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def gradients(self, x, y, reset, valid, h):
        """Gradients of a window's summed loss: of all but the embeddings, of the
        embedding rows that it reads, and the carried state."""
        p, H = self.p, HIDDEN
        steps, lanes = x.shape
        hs, last, saved = self.run(x, reset, h, keep=True)
        grads: dict[str, np.ndarray] = {}
        whole = valid.all()  # as in most windows; then nothing needs picking out
        where = slice(None) if whole else np.flatnonzero(valid.ravel())
        _, part = self.output(hs.reshape(-1, H)[where], y.ravel()[where], grads)
        if whole:
            dhs = part.reshape(steps, lanes, H)
        else:
            dhs = np.zeros((steps * lanes, H), np.float32)
            dhs[where] = part
            dhs = dhs.reshape(steps, lanes, H)
        before, rz, n, un = saved
        r, z = rz[..., :H], rz[..., H:]
        # what each step's gradient is multiplied with, for all steps at once
        f_n = (1 - z) * (1 - n * n)
        f_r = un * r * (1 - r)
        f_z = (before - n) * z * (1 - z)
        da, du = np.empty((steps, lanes, 3 * H), np.float32), np.empty((steps, lanes, 3 * H), np.float32)
        back = np.ascontiguousarray(p["U"].T)
        carry = np.zeros((lanes, H), np.float32)
        any_reset = reset.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            dh = dhs[t] + carry
            d, e = da[t], du[t]
            dn = np.multiply(dh, f_n[t], out=d[:, 2 * H :])
            np.multiply(dn, f_r[t], out=d[:, :H])
            np.multiply(dh, f_z[t], out=d[:, H : 2 * H])
            e[:, : 2 * H] = d[:, : 2 * H]
            np.multiply(dn, r[t], out=e[:, 2 * H :])
            carry = e @ back
            carry += dh * z[t]
            if any_reset[t]:
                carry[reset[t]] = 0
        dU = before.reshape(-1, H).T @ du.reshape(-1, 3 * H)
        flat, items = da.reshape(-1, 3 * H)[where], x.ravel()[where]
        order = np.argsort(items, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(items[order]) != 0))
        rows = items[order][first]
        sums = np.add.reduceat(flat[order], first, axis=0)
        grads["U"] = dU
        return grads, (rows, sums), last

    def train_window(self, x, y, reset, valid, h):
        """One step of truncated backpropagation (Adagrad); returns the carried state."""
        grads, (rows, sums), last = self.gradients(x, y, reset, valid, h)
        p = self.p
        if self.square is None:
            self.square = {k: np.full_like(v, 1e-4) for k, v in p.items()}
        scale = np.float32(1 / max(1, valid.sum()))
        for name, g in grads.items():
            g *= scale
            sq = self.square[name]
            sq += g * g
            p[name] -= RATE * g / np.sqrt(sq)
        sums *= scale
        self.square["A"][rows] += sums * sums
        p["A"][rows] -= RATE * sums / np.sqrt(self.square["A"][rows])
        return last


def lanes(sizes: np.ndarray) -> list[list[int]]:
    """Texts dealt out to lanes of near-equal total length, longest first."""
    heap = [(0, k) for k in range(min(LANES, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (load + int(sizes[i]), k))
    return out


def feed(items: np.ndarray, bounds: np.ndarray, window: int = WINDOW):
    """Windows of the texts ``items[bounds]`` (each ends with the end item):
    (x, y, reset, valid, text) by step and lane. Lanes come longest first, and
    a window has only those that still go on: the first of the one before. As
    they become fewer it has more steps, up to sixteen times as many."""
    sizes = np.diff(bounds)
    plan = sorted(((int(sizes[lane].sum()), lane) for lane in lanes(sizes)), key=lambda x: -x[0])
    if not plan:
        return
    load, texts = np.array([n for n, _ in plan]), np.concatenate([lane for _, lane in plan])
    own = gather(items, bounds[texts], sizes[texts])
    text = np.repeat(texts, sizes[texts])
    begin = np.zeros(len(own), bool)
    begin[np.cumsum(sizes[texts]) - sizes[texts]] = True
    before = np.full_like(own, SHAPES)
    before[1:] = own[:-1]
    before[begin] = SHAPES
    first, at = np.cumsum(load) - load, 0
    while at < load[0]:
        going = int(np.searchsorted(-load, -at))
        steps = np.arange(at, min(at + window * min(16, len(load) // going), load[0]))[:, None]
        place = np.minimum(first[:going] + steps, len(own) - 1)
        yield before[place], own[place], begin[place], steps < load[:going], text[place]
        at = int(steps[-1, 0]) + 1


def carried(h: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """The states of the lanes that go on; zeros before the first window."""
    return np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]


def itemised(column, known: Words, detailed: bool = True):
    """Per group of texts: items, bounds, and what the tails need.

    Yields (rows, items, bounds, details) where details are per word (text,
    count, hash, shape) of the rarer words, if ``detailed``."""
    parts: list = []
    held = 0

    def group():
        nonlocal parts, held
        out = (range(parts[0][0].start, parts[-1][0].stop), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), [np.concatenate([p[3][k] for p in parts]) for k in range(4)])
        parts, held = [], 0
        return out

    for s in slices(column):
        h, start, end, row = words(s)
        n = len(s.rows)
        count, item = known.look(h)
        rare = np.flatnonzero(item < 0)
        shape = shapes(s.data, start[rare], end[rare])
        item[rare] = shape
        size = np.bincount(row, minlength=n) + 1
        full = np.full(len(h) + n, SHAPES, np.int32)
        full[np.arange(len(h)) + row] = item
        if not detailed:
            rare = shape = rare[:0]
        parts.append((s.rows, full, size, (row[rare] + s.rows.start, count[rare], h[rare], shape), None))
        held += len(full)
        if held >= GROUP:
            yield group()
    if parts:
        yield group()


def score_texts(column, known: Words, net: Network):
    """Yield per group: rows, items per text, log10 network score per text, details, items, bounds."""
    for rows, items, sizes, details in itemised(column, known):
        bounds = np.append(0, np.cumsum(sizes))
        total = np.zeros(len(sizes))
        h = None
        for x, y, reset, valid, text in feed(items, bounds, SCORE_WINDOW):
            hs, h, _ = net.run(x, reset, carried(h, x), keep=False)
            where = slice(None) if valid.all() else np.flatnonzero(valid.ravel())
            out, _ = net.output(hs.reshape(-1, HIDDEN)[where], y.ravel()[where])
            total += np.bincount(text.ravel()[where], weights=out, minlength=len(sizes))
        yield rows, sizes, total / np.log(10), details, items, bounds


def train_texts(net: Network, items: np.ndarray, bounds: np.ndarray) -> None:
    h = None
    for x, y, reset, valid, _ in feed(items, bounds):
        h = net.train_window(x, y, reset, valid, carried(h, x))


def count_words(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, shape, c): every distinct token of ``texts(text)`` and its count."""

    def run(batches):
        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for s in slices(batch.column(0), 4 << 20):
                h, start, end, _ = words(s)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shapes(s.data, start[first], end[first]).astype(np.int32)), pa.array(n)], names=["h", "shape", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], names=["h", "shape", "c"])

    counted = texts.select("text").mapInArrow(run, "h bigint, shape int, c bigint").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")).where("c > 0")
    return scratch.keep(counted, "counts")


def known_words(counts: DataFrame, most: int = HEAD) -> Words:
    """Totals, and the frequent words as far as ``most`` allows."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    # at most a few hundred levels and SHAPES shapes
    rows = counts.groupBy("shape", level.alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    by_level: dict[int, int] = {}
    by_shape: dict[int, tuple[int, int]] = {}
    for r in rows:
        by_level[r["level"]] = by_level.get(r["level"], 0) + r["v"]
        n, v = by_shape.get(r["shape"], (0, 0))
        by_shape[r["shape"]] = (n + r["n"], v + r["v"])
    least, held = 1 << 30, 0
    for lev in sorted(by_level, reverse=True):
        held += by_level[lev]
        if held > most:
            break
        least = lev
    head = counts.where((level >= least) | (F.col("h") == END)).toArrow()
    cols = [head.column(n).to_pylist() for n in ("h", "c", "shape")]
    n, v = sum(x[0] for x in by_shape.values()), sum(x[1] for x in by_shape.values())
    return Words(list(zip(*cols)), n, v, by_shape)


def train(texts: DataFrame, known: Words) -> np.ndarray:
    """Parameters of a network trained on all rows of ``texts(id, text)``."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def warm(batches):
        k = shared.value
        net = Network(k.freq)
        groups = [(i, np.append(0, np.cumsum(sizes))) for b in batches for _, i, sizes, _ in itemised(b.column(0), k, detailed=False)]
        for _ in range(PASSES):
            for items, bounds in groups:
                train_texts(net, items, bounds)
        yield pa.RecordBatch.from_arrays([pa.array([net.flat.tobytes()], pa.binary())], names=["flat"])

    # a bounded sample on one task: WARM_DOCUMENTS rows by a hash of the id
    sample = drawn(texts.select("id", "text"), WARM_DOCUMENTS, known.documents, "id").select("text").coalesce(1)
    rows = sample.mapInArrow(warm, "flat binary").collect()
    begin = np.frombuffer(rows[0]["flat"], np.float32) if rows else Network(known.freq).flat
    first = spark.sparkContext.broadcast(begin)

    def local(batches):
        k = shared.value
        net, n = Network(k.freq, first.value.copy()), 0
        for batch in batches:
            for _, items, sizes, _ in itemised(batch.column(0), k, detailed=False):
                train_texts(net, items, np.append(0, np.cumsum(sizes)))
                n += len(items)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([(net.flat.astype(np.float64) * n).tobytes()], pa.binary())], names=["n", "flat"])

    def add(batches):
        n, total = 0.0, None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(b, np.float64)
                total = x.copy() if total is None else total + x
                n += a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "flat"])

    schema = "n double, flat binary"
    replicas = texts.select("text").mapInArrow(local, schema)
    groups = max(1, int(replicas.rdd.getNumPartitions() ** 0.5))
    one = replicas.repartition(groups).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).collect()
    return (np.frombuffer(one[0]["flat"], np.float64) / one[0]["n"]).astype(np.float32) if one else begin


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score; learned
    from the rows that meet ``learn``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = count_words(texts, scratch)
    known = known_words(counts)
    shared = spark.sparkContext.broadcast(known)
    params = spark.sparkContext.broadcast(train(texts, known))
    schema = f"key bigint, id {kind}, n_tokens bigint, n_known bigint, logs double, net double, tail array<struct<h: bigint, f: int>>"

    def run(batches):
        from pyspark import TaskContext

        k = shared.value
        net = Network(k.freq, params.value)
        key = TaskContext.get().partitionId() << 40
        end_count = k.look(np.array([END], np.int64).view(U64))[0][0]
        frequent = np.zeros(k.size)  # log10(c + 1) of each frequent item
        frequent[SHAPES:] = np.log10(k.freq[SHAPES:])
        for batch in batches:
            for rows, sizes, value, (row, count, h, shape), items, bounds in score_texts(batch.column(1), k, net):
                n = len(sizes)
                row = row - rows.start
                logs = np.add.reduceat(frequent[items], bounds[:-1])
                heads = np.add.reduceat((items >= SHAPES).astype(np.int64), bounds[:-1]) - (end_count <= 0)
                mine = count >= 0
                logs += np.bincount(row[mine], weights=np.log10(count[mine] + 1), minlength=n)
                heads = heads + np.bincount(row[mine & (count > 0)], minlength=n)
                value = value - np.bincount(row, weights=k.shape_log[shape], minlength=n)
                rare = np.flatnonzero(~mine)
                order = rare[np.lexsort((h[rare], row[rare]))]
                r, x = row[order], h[order]
                new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]))) if len(r) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(r))).astype(np.int32)
                cuts = np.searchsorted(r[new], np.arange(n + 1))
                pairs = pa.StructArray.from_arrays([pa.array(x[new].view(np.int64)), pa.array(times)], names=["h", "f"])
                # the network's log-probabilities of frequent items are whole; a rarer word's count comes in with logs
                own = np.add.reduceat(np.where(items >= SHAPES, frequent[items], 0.0), bounds[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + n)), batch.column(0).slice(rows.start, n), pa.array(sizes.astype(np.int64)), pa.array(heads.astype(np.int64)), pa.array(logs), pa.array(value - own), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)],
                    names=["key", "id", "n_tokens", "n_known", "logs", "net", "tail"],
                )
                key += n

    scored = scratch.keep(base.mapInArrow(run, schema), "scored")
    tail = scored.select("key", F.explode("tail").alias("t")).select("key", F.col("t.h").alias("h"), F.col("t.f").alias("f"))
    met = tail.join(counts.select("h", "c"), "h").groupBy("key").agg(F.sum(F.col("f") * F.log10(F.col("c") + 1.0)).alias("tail_logs"), F.sum("f").alias("tail_known"))
    whole = scored.drop("tail").join(met, "key", "left")
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(known.n).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(known.n + known.distinct + 1)))).alias("base_score"),
        (F.col("net") + logs).alias("score"),
    )
