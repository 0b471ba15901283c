"""Discoveries to nodes and edges (UPS1-UPS15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions import scalars as S
from ..schema import BUSINESS_CONTEXT, Graph
from .coupling import checked, upsert_edges

#: kind -> (node type, attribute that holds the sub type, prefix rule for unnamed)
_RESOURCE = {"database_access": ("database", "db_type"), "queue_operation": ("queue", "queue_type"), "cloud_resource": ("cloud_resource", "resource_type")}


#: What nodes keep of the discovery that makes them.
_KEPT = ("ordinal", "repo", "name", "sub_type", "language", "framework", "entry_point", "source_file", "source_line", "deployment")


def _segment(c: Column) -> Column:
    """A name fit for an id: colons would break it, so they become dashes (G14)."""
    return F.substring(F.replace(c, F.lit(":"), F.lit("-")), 1, 256)


def _attributes(**cols: Column) -> Column:
    """A map of string attributes without the missing ones."""
    items = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("k"), F.to_json(F.struct(c.alias("v"))).alias("j"))) for k, c in cols.items()]))
    return F.transform_values(F.map_from_entries(items), lambda k, j: F.variant_get(F.parse_json(j), "$.v", "variant"))


def services(discoveries: DataFrame) -> DataFrame:
    """Service nodes: one per name over all repos, the first wins (UPS1, UPS2)."""
    d = discoveries.where("kind = 'service' and name is not null")
    per = d.groupBy("name").agg(F.min_by(F.struct(*_KEPT), "ordinal").alias("r"))
    r = F.col("r")
    ns = F.coalesce(r["repo"], F.lit("unknown"))
    attributes = _attributes(
        language=r["language"], entry_point=r["entry_point"], framework=r["framework"], repo_url=r["repo"], deployment_method=r["deployment"]["deployment_method"],
        terraform_workspace=r["deployment"]["terraform_workspace"], environment=r["deployment"]["environment"], stack_name=r["deployment"]["stack_name"],
    )
    return _node_columns(per, r["ordinal"], F.lit("service"), ns, F.col("name"), attributes, r["source_file"], r["source_line"])


def resources(discoveries: DataFrame) -> DataFrame:
    """Database, queue and cloud nodes: one per type and name, the first wins
    (D5); what has no name is ``<sub type>-unknown`` (UPS5-UPS8)."""
    d = discoveries.where(F.col("kind").isin(*_RESOURCE))
    named = d.withColumn("node_type", S.lookup("kind", {k: v[0] for k, v in _RESOURCE.items()})).withColumn("resource", resource_name())
    per = named.groupBy("node_type", "resource").agg(F.min_by(F.struct(*_KEPT), "ordinal").alias("r"))
    r = F.col("r")
    sub = lambda t: F.when(F.col("node_type") == t, r["sub_type"])
    attributes = _attributes(db_type=sub("database"), queue_type=sub("queue"), resource_type=sub("cloud_resource"), table_name=F.when(F.col("node_type") == "database", r["name"]), environment=r["deployment"]["environment"], deployment_method=r["deployment"]["deployment_method"])
    return _node_columns(per.withColumnRenamed("resource", "name"), r["ordinal"], F.col("node_type"), F.coalesce(r["repo"], F.lit("unknown")), F.col("name"), attributes, r["source_file"], r["source_line"])


def resource_name() -> Column:
    return F.coalesce(F.col("name"), F.concat("sub_type", F.lit("-unknown")))


def _node_columns(df: DataFrame, ordinal: Column, kind: Column, ns: Column, name: Column, attributes: Column, file: Column, line: Column) -> DataFrame:
    space, short = _segment(F.replace(ns, F.lit("/"), F.lit("-"))), _segment(name)
    return df.select(
        ordinal.alias("ordinal"), S.node_id(kind, space, short).alias("id"), kind.alias("node_type"), space.alias("namespace"), short.alias("name"), name.alias("display_name"), attributes.alias("attributes"),
        F.lit(None).cast(BUSINESS_CONTEXT).alias("business_context"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        F.lit("javascript_parser").alias("source"), F.lit(None).cast("string").alias("commit_sha"), file.alias("source_file"), line.cast("int").alias("source_line"),
    )


def api_calls(discoveries: DataFrame) -> DataFrame:
    """(repo, api_calls): each repo's calls in order, as an attribute would hold them (UPS4)."""
    c = discoveries.where("kind = 'api_call'")
    return c.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "target", "method", "source_file"))), lambda x: F.struct(x["target"].alias("target"), x["method"].alias("method"), x["source_file"].alias("source"))).alias("api_calls"))


def repo_services(discoveries: DataFrame) -> DataFrame:
    """(repo, service): the service that a repo's findings belong to, its first."""
    return discoveries.where("kind = 'service'").groupBy("repo").agg(F.min_by("name", "ordinal").alias("service"))


def edges(discoveries: DataFrame, nodes: DataFrame) -> DataFrame:
    """CALLS from imports of known services (order-free, D4) and access edges (UPS3, UPS5-UPS7)."""
    svc = nodes.where("node_type = 'service'").select(F.col("display_name").alias("service"), F.col("id").alias("src"))
    mine = discoveries.join(repo_services(discoveries), "repo").join(svc, "service")
    at = F.array_compact(F.array(F.when(F.col("source_file").isNotNull(), F.concat_ws(":", "source_file", F.col("source_line").cast("string")))))
    calls = mine.where("kind = 'import' and not coalesce(is_relative, false)").join(svc.toDF("module", "dst"), "module").select("ordinal", "src", "dst", F.lit("CALLS").alias("edge_type"), at.alias("evidence"))
    res = nodes.where("node_type <> 'service'").select(F.col("node_type").alias("rt"), F.col("display_name").alias("rn"), F.col("id").alias("dst"))
    op = F.lower(F.col("operation"))
    kinds = (
        F.when(F.col("kind") == "database_access", F.when(op == "readwrite", F.array(F.lit("READS"), F.lit("WRITES"))).when(op == "write", F.array(F.lit("WRITES"))).otherwise(F.array(F.lit("READS"))))
        .when(F.col("kind") == "queue_operation", F.when(op == "subscribe", F.array(F.lit("SUBSCRIBES"))).otherwise(F.array(F.lit("PUBLISHES"))))
        .otherwise(F.array(F.lit("USES")))
    )
    touch = mine.where(F.col("kind").isin(*_RESOURCE)).withColumn("rt", S.lookup("kind", {k: v[0] for k, v in _RESOURCE.items()})).withColumn("rn", resource_name())
    access = touch.join(res, ["rt", "rn"]).select("ordinal", "src", "dst", F.explode(kinds).alias("edge_type"), at.alias("evidence"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return calls.union(access).select("ordinal", "src", "dst", "edge_type", none("double", "confidence"), none("string", "reason"), "evidence", none("string", "http_method"), none("string", "endpoint_path"), none("timestamp", "discovered_at"), F.lit(False).alias("confirmed"))


def build(discoveries: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of a discoveries table, and rejected edges (D3)."""
    found = services(discoveries).unionByName(resources(discoveries))
    calls = api_calls(discoveries).join(repo_services(discoveries), "repo").select(F.col("service").alias("display_name"), F.to_json("api_calls").alias("j"))
    extra = F.when(F.col("j").isNotNull() & (F.col("node_type") == "service"), F.map_concat("attributes", F.create_map(F.lit("api_calls"), F.parse_json("j")))).otherwise(F.col("attributes"))
    nodes = found.join(calls, "display_name", "left").withColumn("attributes", extra).select(*found.columns)
    good, rejects = checked(edges(discoveries, nodes), nodes)
    return Graph(nodes, upsert_edges(good)), rejects


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new nodes by id: attributes of the new win, the display name and
    creation stay, annotations are replaced if the new has any (UPS11)."""
    o = old.select("id", F.struct(*old.columns).alias("o"))
    n = new.select("id", F.struct(*new.columns).alias("n"))
    both = o.join(n, "id", "full_outer")
    a, b = F.col("o.attributes"), F.col("n.attributes")
    empty = F.create_map().cast("map<string,variant>")
    merged = F.map_concat(F.map_filter(F.coalesce(a, empty), lambda k, v: ~F.map_contains_key(F.coalesce(b, empty), k)), F.coalesce(b, empty))
    pick = {"attributes": merged, "business_context": F.coalesce("n.business_context", "o.business_context"), "updated_at": F.greatest("n.updated_at", "o.updated_at")}
    return both.select("id", *[pick.get(c, F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in old.columns if c != "id"]).select(*old.columns)


def add_nodes(g: Graph, new: DataFrame) -> Graph:
    """Strict insert: raises on an id that is there already or twice (UPS10)."""
    both = g.nodes.select("id").unionAll(new.select("id")).groupBy("id").count().where("count > 1")
    bad = both.take(1)
    if bad:
        raise GraphError(f"node {bad[0]['id']!r} exists already")
    return Graph(g.nodes.unionByName(new), g.edges, g.meta)


def add_edges(g: Graph, new: DataFrame) -> Graph:
    """Strict insert: raises on a repeated key or an end that is missing (UPS12)."""
    key = ["src", "dst", "edge_type"]
    twice = g.edges.select(*key).unionAll(new.select(*key)).groupBy(*key).count().where("count > 1").take(1)
    if twice:
        raise GraphError(f"edge {twice[0]['src']} -> {twice[0]['dst']} exists already")
    _, rejects = checked(new, g.nodes)
    bad = rejects.take(1)
    if bad:
        raise GraphError(f"edge {bad[0]['src']} -> {bad[0]['dst']}: {bad[0]['why']}")
    return Graph(g.nodes, g.edges.unionByName(new), g.meta)


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Without the nodes ``ids(id)`` and their edges (UPS14)."""
    ids = ids.select("id")
    edges_ = g.edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti")
    return Graph(g.nodes.join(ids, "id", "left_anti"), edges_, g.meta)


__all__ = ["add_edges", "add_nodes", "build", "remove_nodes", "upsert_nodes"]
