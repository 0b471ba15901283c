"""Toxicity by the nearest labelled examples in TF-IDF space.

Features are words of letters, A-Z lowered. All words of the examples make the
vocabulary; a word that no example has meets none of them and is left out of a
text's vector. A weight is (1 + ln of the count) x idf x (1 + ``TELLING`` x the
word's correlation with the label among the examples, the root of chi-squared
over their number); document frequencies are counted over all documents. An
example is a unit vector of these; examples with equal vectors are one class
with its label counts, and classes lie in an inverted index of blocks. Words
that many examples have are a dense matrix, and what they add is a matrix
product; for each other word and block of class numbers the greatest weight is
known. A batch of queries bounds each block by these, scores the blocks of the
highest bounds, then every block whose bound reaches the score at which
``neighbours`` examples are found (where most blocks do, a word's postings in
one piece instead of block by block), and settles what is left in double
precision: the exact nearest examples, ties included. Votes weighted by
distance give a raw score, which an isotonic map fitted leave-one-out on the
examples calibrates; the nearest examples' ids come along as evidence.

The examples are a bounded sample (``MAX_EXAMPLES`` labelled rows, by a hash of
the id): a parameter, as the index is broadcast. Of near copies among them (by
word counts, at ``ALIKE`` of the weighted Jaccard measure, of one label) one
stays, so that a copied text's rare words do not look telling. Counting and
scoring read all documents, each in one pass without a shuffle of texts.

Defined results: null, empty and very long texts are scored like any other (a
text with no word of the examples gets the prior, the smoothed rate of the
examples without a word that stands significantly with the label, and no
evidence); of labels repeated for one id the greatest counts, null labels and ids none; with no
labels or one class only, every score is the smoothed rate; repeated rows are
scored alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTERS, U64, Scratch, drawn, forget, reusing, slices, words
from .minhash import BAND, registers

MAX_EXAMPLES = 8192
NEIGHBOURS = 25
BLOCK = 256
TELLING = 200.0
#: Chi-squared from which a word counts as a sign; only the prior depends on it.
SIGN = 40.0
#: Share of two examples' word counts from which they are near copies.
ALIKE = 0.8
#: Words in the dense matrix at most; it takes 4 bytes for each and class.
DENSE = 1024
#: Texts bounded together, texts whose postings are added together (few enough for
#: a core's cache), blocks scored first, and document frequencies summed as one value.
BATCH, ADDED, FIRST, CHUNK = 128, 8, 2, 4096
#: What single precision may be off by, with room to spare.
SLACK = 1e-4


def features(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, count) of a slice."""
    f, _, _, r = words(s, NOT_LETTERS)
    if not len(f):
        return r, f, r
    order = np.lexsort((f, r))
    f, r = f[order], r[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return r[at], f[at], np.diff(np.append(at, len(f)))


def unlike(sets: list[np.ndarray], counts: list[np.ndarray], group: list) -> list[int]:
    """Places of the sets of which no earlier one of the same group is a near
    copy. Bands of registers propose the first set of a bucket."""
    regs = registers(sets)[:, : 8 * BAND]
    seen: dict[tuple, int] = {}
    out = []
    for k, (x, n) in enumerate(zip(sets, counts)):
        keys = [(group[k], a, regs[k, a : a + BAND].tobytes()) for a in range(0, regs.shape[1], BAND)] if len(x) else []
        for first in {seen[key] for key in keys if key in seen}:
            _, i, j = np.intersect1d(x, sets[first], assume_unique=True, return_indices=True)
            both = int(np.minimum(n[i], counts[first][j]).sum())
            if both >= ALIKE * (int(n.sum()) + int(counts[first].sum()) - both):
                break
        else:
            out.append(k)
            for key in keys:
                seen.setdefault(key, k)
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ``start`` to ``start + size`` one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


class Vocabulary:
    """Sorted word hashes; a term is a place among them."""

    def __init__(self, known: np.ndarray):
        self.known, self.size = known, len(known)
        self._at: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_at": None}

    def find(self, f: np.ndarray) -> np.ndarray:
        """The term of each hash, -1 where there is none: by its top 22 bits, then onward."""
        if self._at is None:
            self._at = np.searchsorted(self.known >> U64(42), np.arange((1 << 22) + 1, dtype=U64)).astype(np.int32)
        top = (f >> U64(42)).astype(np.int64)
        at, end = self._at[top], self._at[top + 1]
        out = np.full(len(f), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.known[at[left]] == f[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def terms(self, s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of a slice, sorted."""
        if not self.size:
            none = np.empty(0, np.int64)
            return none, none, none
        f, _, _, r = words(s, NOT_LETTERS)
        t = self.find(f)
        ok = t >= 0
        key = np.sort(r[ok] * self.size + t[ok])
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        r, t = np.divmod(key[at], self.size)
        return r, t, np.diff(np.append(at, len(key)))


def damped(n: np.ndarray) -> np.ndarray:
    return 1 + np.log(n)


def digest(t: np.ndarray, n: np.ndarray) -> bytes:
    return blake2b(t.astype(np.int64).tobytes() + n.astype(np.int64).tobytes(), digest_size=16).digest()


def vectors_of(vocabulary: Vocabulary, s) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """(digest, terms, tf) of each row of a slice; the digest of an empty one is empty."""
    r, t, n = vocabulary.terms(s)
    at = np.searchsorted(r, np.arange(len(s.rows) + 1)).tolist()
    return [(digest(t[a:b], n[a:b]) if b > a else b"", t[a:b], damped(n[a:b])) for a, b in zip(at, at[1:])]


class Index:
    """Classes of examples in blocks, with the greatest weight of each term a block."""

    def __init__(self, vectors: list, positive: np.ndarray, total: np.ndarray, idf: np.ndarray, example: list, tf: list | None = None):
        self.idf = idf
        self.positive, self.total, self.example = positive.astype(float), total.astype(float), example
        n = self.n = len(vectors)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([np.asarray(v, np.int32) for v in vectors]) if n else np.empty(0, np.int32)
        self.levels, code = np.unique(np.concatenate(tf), return_inverse=True) if tf and n else (np.ones(1), np.zeros(len(term), np.int64))
        owner = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)), [len(v) for v in vectors]) if n else np.empty(0, np.uint8)
        self.held = np.bincount(term, minlength=len(idf)).astype(np.int32)
        order = np.argsort(term, kind="stable")
        self.postings = owner[order], code.astype(np.min_scalar_type(len(self.levels)))[order]
        self._matrix: np.ndarray | None = None

    def __getstate__(self):
        """What is sent: postings as (owner, code of tf); the rest is made where it is used."""
        return {k: self.__dict__[k] for k in ("idf", "positive", "total", "example", "n", "blocks", "levels", "held", "postings")} | {"_matrix": None}

    def prepare(self) -> None:
        """Weights, the dense matrix and the cells of the other terms."""
        if self._matrix is not None:
            return
        owner, term = self.postings[0].astype(np.int32), np.repeat(np.arange(len(self.idf), dtype=np.int32), self.held)
        weight = self.idf[term] * self.levels[self.postings[1]]
        weight = weight / np.sqrt(np.bincount(owner, weights=weight**2, minlength=self.n))[owner]
        often = np.argsort(-self.held, kind="stable")[:DENSE]
        often = np.sort(often[self.held[often] > max(BLOCK, self.n // 32)])
        #: row of the dense matrix, or -1
        self.place = np.full(len(self.idf), -1, np.int32)
        self.place[often] = np.arange(len(often))
        dense = self.place[term] >= 0
        matrix = np.zeros((len(often), self.n), np.float32)
        matrix[self.place[term[dense]], owner[dense]] = weight[dense]
        #: the matrix again, in double precision: rows and weights of each class
        order = np.flatnonzero(dense)[np.argsort(owner[dense], kind="stable")]
        self.vector = np.append(0, np.cumsum(np.bincount(owner[dense], minlength=self.n)))
        self.rows, self.weights = self.place[term[order]], weight[order]
        self.owner, self.weight, term = owner[~dense], weight[~dense], term[~dense]
        #: cells: the postings of one term and block
        cell = term.astype(np.int64) * max(self.blocks, 1) + self.owner // BLOCK
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        self.block = self.owner[first] // BLOCK
        self.first = np.append(first, len(cell))
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.cells = np.searchsorted(term[first], np.arange(len(self.idf) + 1))
        self.scratch = np.zeros(len(often))
        self._matrix = matrix

    def unit(self, terms: np.ndarray, tf: np.ndarray | None = None) -> np.ndarray:
        q = self.idf[terms] if tf is None else self.idf[terms] * tf
        return q / np.sqrt((q**2).sum())

    def _sums(self, start: np.ndarray, end: np.ndarray, base: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        """``size`` sums: ``value`` x weight of the postings ``start`` to ``end`` go
        to the places ``base`` + their class."""
        held = end - start
        p = _ranges(start, held)
        to = np.repeat(base, held)
        to += self.owner[p]
        add = np.repeat(value, held)
        add *= self.weight[p]
        return np.bincount(to, weights=add, minlength=size)

    def nearest(self, terms: np.ndarray, k: int, without: int = -1, tf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, tf)], k, [without])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray | None]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each (terms, tf), the (class, cosine, examples) of the classes that
        hold the k nearest examples, ties included, nearest first; one example
        of the class ``without`` doesn't count."""
        self.prepare()
        many = len(queries)
        units = [self.unit(t, tf) for t, tf in queries]
        sizes = np.array([len(t) for t, _ in queries])
        own, to = np.repeat(np.arange(many), sizes), np.append(0, np.cumsum(sizes))
        term, value = np.concatenate([t for t, _ in queries]), np.concatenate(units)
        place = self.place[term]
        in_dense = place >= 0
        q = np.zeros((many, len(self._matrix)), np.float32)
        q[own[in_dense], place[in_dense]] = value[in_dense]
        score = q @ self._matrix
        bound = np.maximum.reduceat(score, np.arange(0, self.n, BLOCK), axis=1).astype(np.float64)
        own, term, value = own[~in_dense], term[~in_dense], value[~in_dense]
        size = self.cells[term + 1] - self.cells[term]
        cell, by = _ranges(self.cells[term], size), np.repeat(np.arange(len(term)), size)
        of, share = own[by], value[by]
        at = of * self.blocks + self.block[cell]
        bound = bound.ravel() + np.bincount(at, weights=share * self.top[cell], minlength=many * self.blocks)
        bound = bound.reshape(many, self.blocks)

        # the blocks of the highest bounds; the class k + 1 from the top there:
        # as many hold k examples besides the one that doesn't count
        first = min(FIRST, self.blocks)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        turn = np.full(bound.shape, -1)
        np.put_along_axis(turn, best, np.arange(first)[None, :], axis=1)
        turn = turn.ravel()[at]
        s = np.flatnonzero(turn >= 0)
        slot = (of[s] * first + turn[s]) * BLOCK - self.block[cell[s]] * BLOCK
        shown = self._sums(self.first[cell[s]], self.first[cell[s] + 1], slot, share[s], many * first * BLOCK).reshape(many, -1)
        inside = (best[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(many, -1)
        shown += np.where(inside < self.n, np.take_along_axis(score, np.minimum(inside, self.n - 1), 1), 0)
        floor = np.partition(shown, -k - 1, axis=1)[:, -k - 1] if shown.shape[1] > k else np.zeros(many)

        # every block whose bound reaches that; where most do, all blocks at once
        now = (bound > 0) & (bound >= floor[:, None] - SLACK)
        wide = 2 * now.sum(axis=1) > self.blocks
        now[wide] = False
        s, w = np.flatnonzero(now.ravel()[at]), np.flatnonzero(wide[own])
        start = np.concatenate([self.first[self.cells[term[w]]], self.first[cell[s]]])
        end = np.concatenate([self.first[self.cells[term[w] + 1]], self.first[cell[s] + 1]])
        own, value = np.concatenate([own[w], of[s]]), np.concatenate([value[w], share[s]])
        if len(w) and len(s):
            order = np.argsort(own, kind="stable")
            start, end, own, value = start[order], end[order], own[order], value[order]
        edges = np.searchsorted(own, np.arange(0, many + ADDED, ADDED))
        out = []
        for i in range(many):
            if i % ADDED == 0:
                part, wave = slice(*edges[i // ADDED : i // ADDED + 2]), min(ADDED, many - i)
                rest = self._sums(start[part], end[part], (own[part] - i) * self.n, value[part], wave * self.n).reshape(wave, self.n)
            other = rest[i % ADDED]
            # a block that was left out has what the matrix adds, which its bound covers
            held = score[i] + other
            here = np.flatnonzero(held >= floor[i] - SLACK if floor[i] > SLACK else held > 0)
            if len(here) > k + 1:
                held = held[here]
                here = here[held >= np.partition(held, -k - 1)[-k - 1] - SLACK]
            # what the matrix adds in double precision, for the classes that are left
            spots, dense = place[to[i] : to[i + 1]], in_dense[to[i] : to[i + 1]]
            spots = spots[dense]
            self.scratch[spots] = units[i][dense]
            held = self.vector[here + 1] - self.vector[here]
            p = _ranges(self.vector[here], held)
            exact = other[here] + np.bincount(np.repeat(np.arange(len(here)), held), weights=self.scratch[self.rows[p]] * self.weights[p], minlength=len(here))
            self.scratch[spots] = 0
            cosine = np.round(exact, 9)
            rank = np.lexsort((here, -cosine))
            rank = rank[cosine[rank] > 0]
            classes, cosine = here[rank], cosine[rank]
            count = self.total[classes] - (classes == (without[i] if without else -1))
            reach = int(np.searchsorted(np.cumsum(count), k))
            if reach < len(classes):
                cut = int(np.searchsorted(-cosine, -cosine[reach], side="right"))
                classes, cosine, count = classes[:cut], cosine[:cut], count[:cut]
            out.append((classes, cosine, count))
        return out


class Model:
    """Vocabulary and index, broadcast to the workers, and calibration; bounded."""

    def __init__(self, shared, none_rate: float, k: int):
        self.shared, self.none_rate, self.k = shared, none_rate, k
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        self._seen: dict[bytes, tuple[float, list]] = {}

    def raws(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, list]]:
        """Raw score and evidence of (terms, tf) texts, none of them empty."""
        index, out = self.shared.value[1], []
        for a in range(0, len(texts), BATCH):
            left = without[a : a + BATCH] if without else None
            for k, (classes, cosine, held) in enumerate(index.nearest_of(texts[a : a + BATCH], self.k, left)):
                positive = index.positive[classes]
                if left:
                    positive = positive - (classes == left[k]) * (index.positive[left[k]] / index.total[left[k]])
                weight = 1 / (1.02 - np.minimum(cosine, 1))
                score = (weight @ positive + 0.5 * self.none_rate) / (weight @ held + 0.5)
                out.append((float(score), [index.example[c] for c in classes[:3].tolist()]))
        return out

    def calibrate(self, index: Index, raw: np.ndarray) -> None:
        """Isotonic map from leave-one-out raw scores to rates, pool-adjacent-violators.
        The index is handed in: ``shared.value`` would load a second copy into the
        driver, which stays there as long as a frame of the model does."""
        order = np.argsort(raw, kind="stable")
        least = min(20.0, max(1.0, index.total.sum() / 20))
        groups: list[list[float]] = []  # positives, total, sum of raw
        for c in order.tolist():
            if not groups or groups[-1][1] >= least:
                groups.append([0.0, 0.0, 0.0])
            for k, x in enumerate((index.positive[c], index.total[c], raw[c] * index.total[c])):
                groups[-1][k] += x
        pools: list[list[float]] = []
        for g in groups:
            pools.append(g)
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        x = np.array([p[2] / p[1] for p in pools])
        y = np.array([(p[0] + self.none_rate) / (p[1] + 1) for p in pools])
        self.knots = (x, np.maximum.accumulate(y))

    def score(self, s) -> list[tuple[float, list]]:
        """(score, evidence) of each row of a slice; equal vectors are scored once."""
        rows = vectors_of(self.shared.value[0], s)
        if len(self._seen) > 50_000:
            self._seen.clear()
        new = {key: (t, tf) for key, t, tf in rows if key and key not in self._seen}
        found = self.raws(list(new.values()))
        for key, (raw, evidence) in zip(new, found):
            value = float(np.interp(raw, *self.knots)) if self.knots is not None else raw
            self._seen[key] = (min(1.0, max(0.0, value)), evidence)
        return [self._seen[key] if key else (self.none_rate, []) for key, _, _ in rows]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_examples: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from ``labels(id, label)`` rows that meet ``learn`` (on the id column)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = drawn(known, max_examples, known.count(), "id")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    scratch = Scratch(docs.sparkSession, "toxicity")
    # at most max_examples rows of two numbers: bounded, so it may be broadcast
    examples = base.join(F.broadcast(sample), "id")

    examples = scratch.keep(examples.select("id", "text", "y").dropDuplicates(["id"]), "examples")

    def vectors(batches):
        forget()
        for batch in batches:
            for s in slices(batch.column(1)):
                r, f, n = features(s)
                cut = pa.array(np.searchsorted(r, np.arange(len(s.rows) + 1)), pa.int32())
                part = slice(s.rows.start, s.rows.stop)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (f.view(np.int64), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(2)[part], *lists], names=["id", "y", "f", "n"])

    # bounded: the examples are
    rows = examples.select("id", "text", "y").mapInArrow(vectors, f"id {kind}, y int, f array<bigint>, n array<int>").toArrow().combine_chunks()
    ids, toxic = rows.column("id").to_pylist(), rows.column("y").to_numpy() > 0
    n_pos, big = float(toxic.sum()), float(len(ids))
    rate = (n_pos + 1) / (big + 2)
    spark = docs.sparkSession
    if not 0 < n_pos < big:
        scratch.drop()
        return Model(spark.sparkContext.broadcast((Vocabulary(np.empty(0, U64)), None)), rate, neighbours)
    lists, counts = rows.column("f").combine_chunks(), rows.column("n").combine_chunks().flatten().to_numpy()
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(U64)
    del rows, lists
    cut = np.append(0, np.cumsum(sizes))
    order = sorted(range(len(ids)), key=ids.__getitem__)
    # near copies count once
    chosen = [order[k] for k in unlike([flat[cut[i] : cut[i + 1]] for i in order], [counts[cut[i] : cut[i + 1]] for i in order], [bool(toxic[i]) for i in order])]
    ids, toxic = [ids[i] for i in chosen], toxic[chosen]
    at = _ranges(cut[chosen], sizes[chosen])
    flat, counts, sizes = flat[at], counts[at], sizes[chosen]
    n_pos, big = float(toxic.sum()), float(len(ids))
    rate = (n_pos + 1) / (big + 2)
    known = np.unique(flat)
    term = np.searchsorted(known, flat).astype(np.int32)
    del flat
    vocabulary = Vocabulary(known)
    n, a = np.bincount(term, minlength=len(known)).astype(float), np.bincount(term, weights=np.repeat(toxic, sizes), minlength=len(known))
    with np.errstate(invalid="ignore", divide="ignore"):
        told = (a * big - n * n_pos) ** 2 / (n * (big - n) * n_pos * (big - n_pos))
    told = np.where(n < big, told, 0.0)
    sign = (told * big >= SIGN) & (a * big > n * n_pos)
    signs = np.bincount(np.repeat(np.arange(len(ids)), sizes), weights=sign[term], minlength=len(ids))
    none = [int((toxic & (signs == 0)).sum()), int((signs == 0).sum())]
    chunks, scanned = -(-len(known) // CHUNK), spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        forget()
        words_ = scanned.value
        df, seen = np.zeros(chunks * CHUNK, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for s in slices(batch.column(0)):
                df += np.bincount(words_.terms(s)[1], minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, chunks)), pa.array([np.array([seen]).tobytes(), *[x.tobytes() for x in df.reshape(chunks, CHUNK)]], pa.binary())], names=["chunk", "n"])

    def added(found):
        sums = sum(np.frombuffer(x, np.int64) for x in found.column("n").to_pylist())
        return pa.table({"chunk": found.column("chunk")[:1], "n": pa.array([sums.tobytes()], pa.binary())})

    # the vocabulary is bounded, hence so is what comes back
    counted = base.select("text").mapInArrow(frequencies, "chunk bigint, n binary").groupBy("chunk").applyInArrow(added, "chunk bigint, n binary").collect()
    df = {r["chunk"]: np.frombuffer(r["n"], np.int64) for r in counted}
    idf = np.log((df[-1][0] + 1) / (np.concatenate([df[k] for k in range(chunks)])[: len(known)] + 1)) + 1
    weight = idf * (1 + TELLING * told)
    scanned.destroy()
    del counted

    cut = np.append(0, np.cumsum(sizes))
    groups: dict[bytes, list] = {}
    for k in range(len(ids)):
        t, c = term[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]
        if not len(t):
            continue
        order = np.argsort(t)
        t, c = t[order], c[order]
        g = groups.setdefault(digest(t, c), [0, 0, ids[k], t, c])
        g[0] += int(toxic[k])
        g[1] += 1
    # classes in the order of their weightiest terms share blocks, which keeps bounds tight
    heaviest = {key: g[3][np.argsort(-weight[g[3]] * damped(g[4]), kind="stable")[:3]].tolist() for key, g in groups.items()}
    ordered_keys = sorted(groups, key=lambda key: (heaviest[key], key))
    ordered = [groups[key] for key in ordered_keys]
    del term, counts, groups
    index = Index([g[3] for g in ordered], np.array([g[0] for g in ordered]), np.array([g[1] for g in ordered]), weight, [g[2] for g in ordered], [damped(g[4]) for g in ordered])
    model = Model(spark.sparkContext.broadcast((vocabulary, index)), (none[0] + rate) / (none[1] + 1), neighbours)
    place = {key: c for c, key in enumerate(ordered_keys)}

    def left_out(batches):
        for batch in batches:
            for s in slices(batch.column(0)):
                found = [(place[key], t, tf) for key, t, tf in vectors_of(model.shared.value[0], s) if key in place]
                raw = model.raws([(t, tf) for _, t, tf in found], [c for c, _, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in found], pa.int64()), pa.array([x for x, _ in raw], pa.float64())], names=["c", "raw"])

    raw = np.zeros(len(ordered))
    for r in examples.select("text").mapInArrow(left_out, "c bigint, raw double").collect():
        raw[r["c"]] = r["raw"]
    model.calibrate(index, raw)
    scratch.drop()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted, evidence (ids of nearest examples)."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, score double, predicted int, evidence array<{kind}>"

    def run(batches):
        forget()
        with reusing():
            for batch in batches:
                for s in slices(batch.column(1)):
                    found = model.score(s)
                    value = np.array([x for x, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(s.rows.start, len(s.rows)), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)), pa.array([e for _, e in found], pa.list_(batch.column(0).type))],
                        names=["id", "score", "predicted", "evidence"],
                    )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        forget()
        with reusing():
            for batch in batches:
                keep = []
                for s in slices(batch.column(at)):
                    keep += [value < 0.5 for value, _ in model.score(s)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
