"""Paths, balls and relevance subgraphs (REC1-REC4, ANA6).

Every level is one join of the frontier with the edges. Levels are cut by
checkpoints in the shared folder, so plans do not grow and a lost executor
costs a re-read. Only emptiness is asked of the cluster between levels.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import INCOMING, Graph


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, in the folder that
    ``spark.checkpoint.dir`` names (a temporary one where that is unset)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="terrane-"))
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.a", "e.b")


def within(g: Graph, start: str, k: int) -> DataFrame:
    """(id, distance) of nodes at most k undirected hops away, the start included."""
    pairs = both_ways(g.edges)
    front = g.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("distance"))
    seen = front = settle(front)
    for level in range(1, k + 1):
        step = front.join(pairs, front.id == pairs.a).select(F.col("b").alias("id")).distinct()
        front = settle(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("distance")))
        if not front.take(1):
            break
        seen = settle(seen.union(front))
    return seen


def find_path(g: Graph, start: str, goal: str | None) -> DataFrame:
    """(path, distance): a shortest directed path, the least by its ids as one text,
    parted by ``>``, among equals (D7); no row if there is none, nor without a goal.
    A node keeps one path: the least that is shortest."""
    edges = g.edges.select("src", "dst").distinct()
    front = settle(g.nodes.where(F.col("id") == start).select("id", F.array("id").alias("path")))
    found = front.where(F.col("id") == F.lit(goal))
    seen = front.select("id")
    while not found.take(1) and front.take(1):  # each level has new nodes, so this ends
        step = front.join(edges, front.id == edges.src).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = settle(step.groupBy("id").agg(F.min_by("path", F.array_join("path", ">")).alias("path")).join(seen, "id", "left_anti"))
        seen = settle(seen.union(front.select("id")))
        found = front.where(F.col("id") == F.lit(goal))
    return found.select("path", (F.size("path") - 1).alias("distance"))


def extract(g: Graph, seeds: DataFrame, max_depth: int = 2, min_relevance: float = 0.1, edge_types: tuple[str, ...] | None = None, include_couplings: bool = True) -> tuple[DataFrame, DataFrame]:
    """Relevance subgraph around ``seeds(id)``: (id, score, depth) and its edges.

    Level by level (D1): a node opens with the best of its first level's
    arrivals if that reaches ``min_relevance``, and else stays closed; a later,
    better arrival raises its score and sets its depth without expanding again.
    Edges are all those between the nodes, whatever was followed."""
    follow = g.edges
    if edge_types is not None:
        follow = follow.where(F.col("edge_type").isin(*edge_types))
    if not include_couplings:
        follow = follow.where(F.col("edge_type") != "IMPLICITLY_COUPLED")
    w = S.decay("edge_type")
    ways = follow.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), (w * INCOMING).alias("w")))).alias("e")).select("e.a", "e.b", "e.w")
    known = g.nodes.select("id")
    front = settle(seeds.select("id").distinct().join(known, "id", "left_semi").select("id", F.lit(1.0).alias("score")))
    open_ = front.select("id", "score", F.lit(0).alias("depth"))
    closed = None
    for level in range(1, max_depth + 1):
        arrivals = settle(front.join(ways, front.id == ways.a).select(F.col("b").alias("id"), (F.col("score") * F.col("w")).alias("score")).groupBy("id").agg(F.max("score").alias("score")))
        new = arrivals.join(open_.select("id"), "id", "left_anti")
        if closed is not None:
            new = new.join(closed, "id", "left_anti")
        new = settle(new.join(known, "id", "left_semi"))
        raised = open_.join(arrivals.withColumnRenamed("score", "came"), "id", "left").select("id", F.greatest("score", F.coalesce("came", F.lit(0.0))).alias("s"), F.when(F.col("came") > F.col("score"), level).otherwise(F.col("depth")).alias("depth")).withColumnRenamed("s", "score")
        front = new.where(F.col("score") >= min_relevance)
        shut = new.where(F.col("score") < min_relevance).select("id")
        closed = settle(shut if closed is None else closed.union(shut))
        open_ = settle(raised.union(front.select("id", "score", F.lit(level).alias("depth"))))
        if not front.take(1):
            break
    ids = open_.select("id")
    edges = g.edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return open_, edges


def ranked(scored: DataFrame) -> DataFrame:
    """Total order of a subgraph: score falling, then depth, then id (D6)."""
    return scored.orderBy(F.desc("score"), "depth", "id")
