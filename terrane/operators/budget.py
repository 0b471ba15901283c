"""Selection within a token budget (SCL3, SCL5, SCL6, SRT4, SRT5, RND9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import Graph


def estimated(g: Graph, scored: DataFrame, count=S.tokens_approx) -> DataFrame:
    """``scored(id, score, depth)`` with the node's token estimate; ``count``
    turns a text column into tokens (a vocabulary's UDF may take its place)."""
    info = g.nodes.select("id", "display_name", F.coalesce(F.size("attributes"), F.lit(0)).alias("n_attributes"), F.col("business_context").isNotNull().alias("has_context"))
    tokens = S.node_tokens("score", count("display_name"), F.greatest(F.col("n_attributes"), F.lit(0)), F.col("has_context"))
    return scored.join(info, "id").select("id", "score", "depth", tokens.alias("tokens"))


def _running(rows: DataFrame, amount: Column, *order) -> DataFrame:
    """``rows`` with ``__used``: a running sum in ``order`` without sorting all
    rows in one task. Range partitions are summed first, then each adds what
    came before it; the totals are one row per partition."""
    parts = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    from .traverse import settle

    parts = settle(parts)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("__part").agg(F.sum(amount).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select("__part", "__base")
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return parts.join(F.broadcast(totals), "__part").withColumn("__used", F.col("__base") + F.sum(amount).over(within))


def select_nodes(priced: DataFrame, budget: int) -> DataFrame:
    """The longest prefix, best first, that fits with the document's own tokens.
    Every estimate is positive, so the sum only rises: prefix and filter agree."""
    used = _running(priced, F.col("tokens"), F.desc("score"), F.asc("depth"), F.asc("id"))
    return used.where(F.col("__used") + S.DOCUMENT_TOKENS <= budget).select("id", "score", "depth", "tokens", F.col("__used").alias("used"))


def select_edges(edges: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
    """Edges between kept nodes, first come, as far as the rest of the budget goes."""
    spent = kept.agg(F.coalesce(F.max("used"), F.lit(0))).first()[0]
    room = max(0, (budget - spent - S.DOCUMENT_TOKENS) // S.EDGE_TOKENS)
    ids = kept.select("id")
    inside = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return inside.orderBy("ordinal", "src", "dst", "edge_type").limit(int(room))


def document_tokens(priced: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, tokens): the estimate of a whole document (AGG15)."""
    n = priced.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    e = edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", (F.col("t") + S.DOCUMENT_TOKENS + F.col("edges") * S.EDGE_TOKENS).alias("tokens"))


def fits(priced: DataFrame, edges: DataFrame, budget: int) -> bool:
    return document_tokens(priced, edges).first()["tokens"] <= budget


def vocabulary_counter(name: str = "cl100k_base"):
    """A counter by a tiktoken vocabulary where one is available, else the approximation (D12)."""
    try:
        import tiktoken

        tiktoken.get_encoding(name)
    except Exception:  # no vocabulary and no network
        return S.tokens_approx
    import pandas as pd

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.get_encoding(name)
        return pd.Series([len(enc.encode_ordinary(t or "")) for t in texts])

    return lambda c: counted(S.col(c))
