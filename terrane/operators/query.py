"""Filters, neighbourhoods and counts over a graph (FLT, JN1-JN7, AGG1-AGG3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import FilterError
from ..functions import scalars as S
from ..schema import Graph

ACCESS_TYPES = ("READS", "WRITES", "READS_SHARED", "WRITES_SHARED", "PUBLISHES", "SUBSCRIBES", "USES")
DEPENDENCY_TYPES = ("CALLS", "READS", "WRITES", "PUBLISHES", "USES")


def get_node(g: Graph, id_: str) -> DataFrame:
    return g.nodes.where(F.col("id") == id_)


def nodes_by_type(g: Graph, node_type: str) -> DataFrame:
    return g.nodes.where(F.col("node_type") == node_type)


def edges_by_type(g: Graph, edge_type: str) -> DataFrame:
    return g.edges.where(F.col("edge_type") == edge_type)


def edges_from(g: Graph, id_: str, *types: str) -> DataFrame:
    out = g.edges.where(F.col("src") == id_)
    return out.where(F.col("edge_type").isin(*types)) if types else out


def edges_to(g: Graph, id_: str, *types: str) -> DataFrame:
    out = g.edges.where(F.col("dst") == id_)
    return out.where(F.col("edge_type").isin(*types)) if types else out


def has_edge_between(g: Graph, src: str, dst: str) -> bool:
    return bool(g.edges.where((F.col("src") == src) & (F.col("dst") == dst)).select(F.lit(1)).take(1))


def find_by_attribute(g: Graph, key: str, value: object) -> DataFrame:
    return g.nodes.where(S.attr_equals(key, value))


def find_by_name(g: Graph, text: str) -> DataFrame:
    """Case-insensitive substring of the display name; % and _ are literal."""
    return g.nodes.where(F.contains(F.lower("display_name"), F.lit(text.lower())))


def traverse(g: Graph, id_: str, direction: str = "both", types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes one hop away, once per edge: outgoing first, then incoming (JN1)."""
    sides = {"out": ("src", "dst"), "in": ("dst", "src")}
    parts = []
    for k, name in enumerate(("out", "in") if direction == "both" else (direction,)):
        here, there = sides[name]
        e = g.edges.where(F.col(here) == id_)
        if types is not None:
            e = e.where(F.col("edge_type").isin(*types))
        parts.append(e.select(F.col(there).alias("id"), F.lit(k).alias("side"), F.col("ordinal").alias("edge_ordinal"), "edge_type").join(g.nodes.withColumnRenamed("ordinal", "node_ordinal"), "id"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def neighbors(g: Graph, id_: str) -> DataFrame:
    return traverse(g, id_)


def services_accessing(g: Graph, resource: str) -> DataFrame:
    return traverse(g, resource, "in", ACCESS_TYPES)


def dependencies(g: Graph, id_: str) -> DataFrame:
    return traverse(g, id_, "out", DEPENDENCY_TYPES)


def dependents(g: Graph, id_: str) -> DataFrame:
    return traverse(g, id_, "in", ("CALLS",))


def implicit_couplings(g: Graph) -> DataFrame:
    """(src, src_name, dst, dst_name, reason) of coupling edges (JN6)."""
    name = g.nodes.select("id", "display_name")
    e = edges_by_type(g, "IMPLICITLY_COUPLED").select("src", "dst", "reason")
    return e.join(name.toDF("src", "src_name"), "src").join(name.toDF("dst", "dst_name"), "dst").select("src", "src_name", "dst", "dst_name", "reason")


def induced(g: Graph, ids: DataFrame) -> Graph:
    """The subgraph on ``ids(id)``; unknown ids are ignored (JN7). Edges that
    end outside go in two semi-joins, so no node columns are shuffled."""
    ids = ids.select("id").distinct()
    nodes = g.nodes.join(ids, "id", "left_semi")
    edges = g.edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return Graph(nodes, edges, g.meta)


def filter_environment(g: Graph, environment: str, check: bool = True) -> Graph:
    """Nodes whose environment is the one asked for, in any case; raises if none is."""
    nodes = g.nodes.where(F.lower(S.attr("environment")) == environment.lower())
    if check and not nodes.select("id").take(1):
        raise FilterError(f"no node in environment {environment!r}")
    return induced(g, nodes)


def service_seeds(g: Graph, text: str, check: bool = True) -> DataFrame:
    """(position, wanted, id) for "a, b": by display name in any case or exact
    id name; the first inserted node wins; raises if one is missing (FLT11)."""
    wanted = [(k, w) for k, w in enumerate(x.strip() for x in text.split(",")) if w]
    asked = g.spark.createDataFrame(wanted, "position int, wanted string")
    service = nodes_by_type(g, "service").select("id", "ordinal", "name", F.lower("display_name").alias("lower_name"))
    # the request is what the caller typed: a handful of rows
    small = F.broadcast(asked.withColumn("lower_wanted", F.lower("wanted")))
    by_display = service.join(small, F.col("lower_name") == F.col("lower_wanted"))
    by_id = service.join(small, F.col("name") == F.col("wanted"))
    hit = by_display.union(by_id).groupBy("position", "wanted").agg(F.min_by("id", F.struct("ordinal", "id")).alias("id"))
    if check:
        missing = asked.join(hit, ["position", "wanted"], "left_anti").collect()
        if missing:
            raise FilterError("no service " + ", ".join(repr(r["wanted"]) for r in missing))
    return hit


def counts_by_type(g: Graph) -> DataFrame:
    return g.nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def edge_counts_by_type(g: Graph) -> DataFrame:
    return g.edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def degrees(g: Graph) -> DataFrame:
    """(id, outgoing, incoming, degree); a loop counts on both sides (AGG3).
    Ends are counted in one pass over the edges, combined before the shuffle."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count("*").alias("degree"))


def accessors(g: Graph) -> DataFrame:
    """(resource, accessors): distinct accessing services by display name (AGG8)."""
    e = g.edges.where(F.col("edge_type").isin(*[t for t in ACCESS_TYPES if t != "USES"])).select("src", F.col("dst").alias("resource"))
    names = g.nodes.select(F.col("id").alias("src"), "display_name")
    return e.join(names, "src").groupBy("resource").agg(F.countDistinct("display_name").alias("accessors"))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
