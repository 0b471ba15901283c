"""Nearest neighbours by an inverted file whose probes are set by measured recall.

Equal vectors are one class. Centroids of cells come from k-means over a bounded
sample of ``SAMPLE`` classes; every class is indexed, in the cell of its nearest
centroid. How many cells a query probes is measured, not fixed: ``TRIALS`` of the
queries are compared with every class, and as many cells are probed, nearest
first, as hold ``RECALL`` of the neighbours found so. Where nothing separates
vectors this comes to all cells, so recall is kept and time is given up.

Cells lie in blocks of bounded size, near cells together; a cell of more rows is
dealt into several blocks. A query is sent once to each block in which it probes
cells, after the block's rows in one sorted stream, with a bound: the distance of
the last neighbour that it would have among the sample's rows in these cells (it
probes further where they hold too few rows). Only rows within the
bound are looked at in double precision and leave the block, so a query costs a
product of small matrices a cell.

What is broadcast is bounded: the sample and the centroids. Measured recall
against brute force is in the README and tests.

Defined results: ids are integers; vectors that are null, zero or hold null or
non-finite components, rows with a null id, and vectors whose dimension isn't
the most frequent one take no part; of rows that repeat an id the least vector
counts; equal vectors are neighbours at distance 0; ties go to the smaller id;
with fewer rows than asked for, a query returns all others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cap_filters import usable
from .common import Scratch, drawn

#: Classes of which centroids and bounds are taken, and cells at most.
SAMPLE, CELLS = 16384, 2048
#: Queries compared with every class, and the share of their neighbours that probed cells hold.
TRIALS, RECALL = 256, 0.98
#: Rows of a block at least and at most, and blocks aimed at between.
LEAST, MOST, BLOCKS = 1024, 65536, 48
#: Queries that meet a block at a time.
CHUNK = 4096
#: Single precision may be off by this share of the squared norms.
SLACK = 1e-5


def _matrix(column) -> np.ndarray:
    """The rows of a list column in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances in single precision; may be off by SLACK of the norms."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)


def kmeans(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of at most ``cells`` cells, those of one region one after another."""
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_apart(x[k : k + 2048], c).argmin(axis=1) for k in range(0, len(x), 2048)])
        held = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c)
    if len(c) > 64:
        return c[np.argsort(_apart(c, kmeans(c, int(len(c) ** 0.5), rounds)).argmin(axis=1), kind="stable")]
    return c


def vectors(table: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that take part, how many, and their dimension."""
    good = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).where(usable("v") & F.col("id").isNotNull())
    dims = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return good, 0, 0
    dim = dims["dim"]
    single = good.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    nodes = scratch.keep(single, "nodes")
    return nodes, nodes.count(), dim


def _placed(classes: DataFrame, shared) -> DataFrame:
    """Classes with their cells."""

    def run(batches):
        c = shared.value[0]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2)).astype(np.float32)
                cell = np.concatenate([_apart(x[k : k + 2048], c).argmin(axis=1) for k in range(0, len(x), 2048)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["rep", "ids", "v", "cell"])

    return classes.select("rep", "ids", "v").mapInArrow(run, f"rep bigint, ids array<bigint>, v {dict(classes.dtypes)['v']}, cell int")


def _probes(placed: DataFrame, trials: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """How many cells hold RECALL of the k nearest classes of the trials, but for the trials themselves."""
    rank = _apart(trials, centroids).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable").astype(np.int32)
    shared = placed.sparkSession.sparkContext.broadcast((trials, rank))

    def run(batches):
        q, rank = shared.value
        best_d, best_r = np.empty((len(q), 0), np.float32), np.empty((len(q), 0), np.int32)
        for batch in batches:
            cell = batch.column(1).to_numpy()
            x = _matrix(batch.column(0)).astype(np.float32) if batch.num_rows else np.empty((0, q.shape[1]), np.float32)
            for a in range(0, len(x), 8192):
                best_d = np.concatenate([best_d, _apart(q, x[a : a + 8192])], axis=1)
                best_r = np.concatenate([best_r, rank[:, cell[a : a + 8192]]], axis=1)
                if best_d.shape[1] > k:
                    at = np.argpartition(best_d, k - 1, axis=1)[:, :k]
                    best_d, best_r = np.take_along_axis(best_d, at, 1), np.take_along_axis(best_r, at, 1)
        t = np.repeat(np.arange(len(q)), best_d.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(best_d.ravel()), pa.array(best_r.ravel())], names=["t", "d", "r"])

    found = placed.select("v", "cell").mapInArrow(run, "t bigint, d float, r int")
    found = found.withColumn("n", F.row_number().over(W.partitionBy("t").orderBy("d", "r"))).where(F.col("n").between(2, k)).select("r")
    r = np.sort(found.toArrow().column("r").to_numpy())  # TRIALS * k numbers at most
    shared.destroy()
    if not len(r):
        return len(centroids)
    return int(r[int(np.ceil(RECALL * len(r))) - 1]) + 1


def _layout(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell, for cells that hold so many rows."""
    most = int(np.clip(held.sum() / BLOCKS, LEAST, MOST))
    first, parts, block, filled = np.zeros(len(held), np.int32), np.ones(len(held), np.int32), 0, 0
    for c, n in enumerate(held.tolist()):
        if filled and filled + n > most:
            block, filled = block + 1, 0
        first[c], parts[c] = block, max(1, -(-n // most))
        filled += n
        if n > most:
            block, filled = block + int(parts[c]), 0
    return first, parts


def _sent(queries: DataFrame, shared, held: np.ndarray, first: np.ndarray, parts: np.ndarray, probes: int, k: int) -> DataFrame:
    """(block, rep, v, bound, radius): queries for each block in which they probe cells."""
    kind, last = dict(queries.dtypes)["v"], first + parts
    blocks = int(last.max())
    scarce = np.sort(held)[:probes].sum() < k

    def run(batches):
        c, some, own = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = _matrix(part.column(1)).astype(np.float32)
                slack = SLACK * ((x * x).sum(axis=1) + max((some * some).sum(axis=1).max(), (c * c).sum(axis=1).max()))
                far = _apart(x, c)
                if scarce:
                    order = far.argsort(axis=1)
                    reach = np.minimum((held[order].cumsum(axis=1) < k).sum(axis=1), len(c) - 1)
                    radius = far[np.arange(len(x)), order[np.arange(len(x)), np.maximum(reach, probes - 1)]] + slack
                else:
                    radius = np.partition(far, probes - 1, axis=1)[:, probes - 1] + slack
                near = np.where((far <= radius[:, None])[:, own], _apart(x, some), np.inf)
                bound = np.partition(near, k - 1, axis=1)[:, k - 1] + 4 * slack if len(some) >= k else np.full(len(x), np.inf)
                goes = np.zeros((len(x), blocks + 1), np.int32)
                q, cell = np.nonzero(far <= radius[:, None])
                np.add.at(goes, (q, first[cell]), 1)
                np.add.at(goes, (q, last[cell]), -1)
                q, block = np.nonzero(goes.cumsum(axis=1))
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), part.column(0).take(take), part.column(1).take(take), pa.array(bound[q].astype(np.float64)), pa.array(radius[q].astype(np.float64))], names=["block", "rep", "v", "bound", "radius"])

    return queries.select("rep", "v").mapInArrow(run, f"block int, rep bigint, v {kind}, bound double, radius double")


class Block:
    """Rows of one block by cell, and what queries find among them."""

    def __init__(self, parts: list[pa.RecordBatch], centroids: np.ndarray):
        t = pa.Table.from_batches(parts).combine_chunks()
        cell = t.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.rep, self.ids = t.column("rep").to_numpy()[order], t.column("ids").combine_chunks().take(pa.array(order))
        self.v = _matrix(t.column("v").combine_chunks())[order]
        self.x = self.v.astype(np.float32)
        self.norm = (self.x * self.x).sum(axis=1)
        cells, start = np.unique(cell[order], return_index=True)
        self.bounds, self.centroids = np.append(start, len(cell)), centroids[cells]

    def find(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """(q, c, ids, d): at most k classes within each query's bound."""
        v, bound, radius = _matrix(batch.column(4)), batch.column(5).to_numpy(), batch.column(6).to_numpy()
        x = v.astype(np.float32)
        norm = (x * x).sum(axis=1)
        probed = _apart(x, self.centroids) <= (radius + SLACK * norm)[:, None]
        left = (bound - norm).astype(np.float32)
        qs, cs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for j, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            q = np.flatnonzero(probed[:, j])
            for at in range(0, len(q) and b - a, 8192):
                to = min(b, a + at + 8192)
                hit, c = np.nonzero(self.norm[a + at : to] - 2 * (x[q] @ self.x[a + at : to].T) <= left[q][:, None])
                qs.append(q[hit])
                cs.append(c + a + at)
        q, c = np.concatenate(qs), np.concatenate(cs)
        d = np.concatenate([np.empty(0), *[((self.v[c[k : k + 65536]] - v[q[k : k + 65536]]) ** 2).sum(axis=1) for k in range(0, len(q), 65536)]])
        order = np.lexsort((self.rep[c], d, q))
        q, c, d = q[order], c[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c, d = q[keep], c[keep], d[keep]
        return pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(q)), pa.array(self.rep[c]), self.ids.take(pa.array(c)), pa.array(np.sqrt(d))], names=["q", "c", "ids", "d"])


def search(placed: DataFrame, queries: DataFrame, shared, held: np.ndarray, probes: int, k: int) -> DataFrame:
    """(q, c, ids, d): for each query class (rep, v) the k nearest classes that its cells hold."""
    spark, kind = placed.sparkSession, dict(placed.dtypes)["v"]
    first, parts = _layout(held)
    cells = spark.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, parts))], "cell int, first int, parts int")
    block = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int").alias("block")
    rows = placed.join(F.broadcast(cells), "cell").select(block, F.lit(0).alias("turn"), "rep", "ids", "v", F.lit(0.0).alias("bound"), F.lit(0.0).alias("radius"), "cell")
    sent = _sent(queries, shared, held, first, parts, probes, k).select("block", F.lit(1).alias("turn"), "rep", F.array().cast("array<bigint>").alias("ids"), F.col("v").cast(kind).alias("v"), "bound", "radius", F.lit(0).alias("cell"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        at, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, turn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(turn) != 0)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if own[a] != at:
                    held, at, block = [], own[a], None
                if not turn[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                block = block or Block(held, shared.value[0])
                for k_ in range(a, b, CHUNK):
                    yield block.find(batch.slice(k_, min(CHUNK, b - k_)), k)

    met = rows.union(sent).repartition("block").sortWithinPartitions("block", "turn")
    found = met.mapInArrow(run, "q bigint, c bigint, ids array<bigint>, d double")
    return found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d", "c"))).where(F.col("n") <= k).drop("n")


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest
    found to every row for which ``is_query`` (on the id column) holds."""
    spark = table.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    nodes, count, dim = vectors(table, scratch, id_col, vec_col)
    if not count:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    # one class more than asked for, and one id more of each: a row is no neighbour of itself
    few = nodes.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    classes = scratch.keep(classes.select("rep", "ids", "v"), "classes")
    asked = nodes.select(F.col("id").alias(id_col), "v").where(is_query).join(classes.select("v", "rep"), "v")
    asked = scratch.keep(asked.select(F.col(id_col).alias("query_id"), "rep", "v"), "asked")
    queries = asked.dropDuplicates(["rep"]).select("rep", "v")
    number = classes.count()
    some = _matrix(drawn(classes.select("rep", "v"), SAMPLE, number, "rep").toArrow().column("v").combine_chunks()).astype(np.float32)
    trials = _matrix(drawn(queries, TRIALS, queries.count(), "rep").toArrow().column("v").combine_chunks()).astype(np.float32).reshape(-1, dim)
    if not len(trials):
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    centroids = kmeans(some, int(min(CELLS, max(1, 2 * number**0.5))))
    own = np.concatenate([_apart(some[a : a + 2048], centroids).argmin(axis=1) for a in range(0, len(some), 2048)])
    shared = spark.sparkContext.broadcast((centroids, some, own))
    placed = scratch.keep(_placed(classes, shared), "placed")
    held = np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        held[r["cell"]] = r["count"]
    probes = _probes(placed, trials, centroids, k + 1)
    found = scratch.keep(search(placed, queries, shared, held, probes, k + 1), "found")
    both = asked.select("query_id", F.col("rep").alias("q")).join(found, "q").select("query_id", F.explode("ids").alias(id_col), F.col("d").alias("score")).where(F.col("query_id") != F.col(id_col))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", id_col))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")
