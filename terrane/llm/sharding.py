"""Contiguous shards of near-equal byte size.

Rows are put in the order of their id by a range exchange and numbered within
each range; the totals of the ranges (one row per partition) give, by a prefix
sum, the bytes and rows before each range, so that every row knows the bytes
before it without any global sort in one task. A row belongs to the shard in
whose equal share of the bytes its middle byte lies: shards are contiguous in
the order and differ from an equal share by less than one row.

Equal texts are not kept together: a group that holds a third of all rows is
spread over as many shards as its bytes need, as the ``bytes`` law demands.

Defined results: a null text has size 1 (none, plus one) and the crc of no
bytes; a null id sorts first; rows with equal ids follow in the order of size
and crc, and rows equal in all of these are interchangeable; an empty table
gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["id", "size", "text_crc32", "tie"]
    ranges = sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = scratch.keep(ranges, "ranges")
    # one row for each partition of the range exchange: bounded by its count
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("bytes").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    within = W.partitionBy("part").orderBy(*order)
    placed = rows.join(F.broadcast(offsets), "part").select(
        "id",
        "size",
        "text_crc32",
        (F.col("bytes0") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("bytes_before"),
        (F.col("n0") + F.row_number().over(within) - 1).alias("place"),
        "total",
    )
    cut = placed.withColumn("shard", F.expr(f"cast(((2 * bytes_before + size) * {int(shards)}) div (2 * total) as int)"))
    cut = scratch.keep(cut.select("id", "size", "text_crc32", "place", "shard"), "placed")
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
