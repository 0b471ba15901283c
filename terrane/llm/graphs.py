"""Connected components, and an id filter of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: the least node that
    it reaches. Large-star and small-star steps alternate until nothing changes.

    Each step takes the least neighbour by a grouped minimum (combined before
    the shuffle) and joins it back, so a hub's neighbours are never collected.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sign = _sign(now)
    for _ in range(most_rounds):
        if not sign[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, "small-star")
        scratch.drop(now, large)
        was, sign, now = sign, _sign(after), after
        if sign == was:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select("u").union(now.select(F.col("v").alias("u"))).distinct()
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("component")), "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def _sign(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of an edge list."""
    # sums of 31-bit pieces cannot overflow a long before 2**32 rows; the rest wraps by xor
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0x7FFFFFFF))), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


#: Most bits of an id filter: 2**26 bits are 8 MB.
FILTER_BITS = 26


def only_ids(rows: DataFrame, column: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` whose ``column`` may be among ``ids`` (their first column)."""
    return marked(rows, column, ids, bits).where("__maybe").drop("__maybe")


def marked(rows: DataFrame, column: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``__maybe``: false where ``column`` is surely not among ``ids``.

    A one-hash filter of fixed size is built by a grouped bitmap aggregate and
    broadcast: at most 2**bits bits, however many ids there are. It never rules
    out a row that belongs; what it lets through beside is for the join that
    follows, which thus shuffles little more than the rows it is about.
    """
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(1 << bits)) + 1
    maps = ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("__part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("__bits"))
    own = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << bits)) + 1
    placed = rows.withColumn("__slot", own).withColumn("__part", F.expr("bitmap_bucket_number(__slot)")).withColumn("__at", F.expr("bitmap_bit_position(__slot)"))
    hit = F.expr("coalesce(shiftright(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) % 2 = 1, false)")
    return placed.join(F.broadcast(maps), "__part", "left").withColumn("__maybe", hit).drop("__part", "__bits", "__slot", "__at")
