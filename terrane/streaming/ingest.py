"""Streams: a JSONL log tail, and discoveries folded into a graph batch by batch (SRC15, ANA9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import build
from ..operators.coupling import upsert_edges
from ..operators.query import first_by
from ..schema import EDGES, NODES


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of a folder's JSONL files: (line, parsed variant or null)."""
    raw = spark.readStream.format("text").load(folder)
    return raw.select(F.col("value").alias("line"), F.try_parse_json("value").alias("entry"))


def fold(spark: SparkSession, discoveries: DataFrame, folder: str, checkpoint: str):
    """Folds a stream of discoveries into nodes and edges under ``folder``: each
    batch writes a new version whole, then names it, so a batch that runs twice
    leaves one result. Returns the query."""

    def one(batch: DataFrame, number: int) -> None:
        g, _ = build(batch)
        before = current(spark, folder, number)
        nodes, edges = g.nodes, g.edges
        if before is not None:
            nodes = before[0].unionByName(nodes)
            edges = before[1].unionByName(edges)
        nodes = first_by(nodes, ["id"], "ordinal")
        nodes.write.mode("overwrite").parquet(f"{folder}/v{number}/nodes")
        upsert_edges(edges).write.mode("overwrite").parquet(f"{folder}/v{number}/edges")
        spark.createDataFrame([(number,)], "version bigint").write.mode("append").parquet(f"{folder}/versions")

    return discoveries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, below: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of the newest version (below a number), None before the first."""
    try:
        versions = spark.read.schema("version bigint").parquet(f"{folder}/versions")
        if below is not None:
            versions = versions.where(F.col("version") < below)
        newest = versions.agg(F.max("version")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if newest is None:
        return None
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/v{newest}/{name}")
    return read("nodes", NODES), read("edges", EDGES)
