"""Further registered queries: functions of ids and texts, file rules, owners by
path, graph edits, answers, and graphs built of discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import build, coupling, gaps, incremental, query, repos
from ..schema import DISCOVERIES, Graph
from . import render
from .catalogue import RELEVANT, START, _subgraph, on_graph, register, table


@register(
    """ SELECT id, split_part(id, ':', 1) AS kind, split_part(id, ':', 2) AS namespace, split_part(id, ':', 3) AS short, TRUE AS valid, node_type <> 'service' AS renamed_valid, TRUE AS name_valid, FALSE AS id_as_name,
translate(id, ':-/', '___') AS plain, display_name || '&lt;x&gt; ''()''' AS label, CAST(ceil(length(display_name) / 4.0) AS BIGINT) AS tokens FROM n"""
)
@on_graph
def id_functions(g: Graph) -> DataFrame:
    """Ids made, cut and checked; names made fit for diagrams."""
    made = S.node_id("node_type", S.id_part("id", 1), "name")
    label = S.escape_label(F.concat("display_name", F.lit('<x> "[]"')))
    return g.nodes.select(
        made.alias("id"), S.id_part("id", 0).alias("kind"), S.id_part("id", 1).alias("namespace"), S.id_part("id", 2).alias("short"), S.valid_id("id").alias("valid"), S.valid_id(F.replace("id", F.lit("service"), F.lit("thing"))).alias("renamed_valid"),
        S.valid_segment("name").alias("name_valid"), S.valid_segment("id").alias("id_as_name"), S.sanitize("id").alias("plain"), label.alias("label"), S.tokens_approx("display_name").alias("tokens"),
    )


_REASONS = """, r AS (SELECT p_partkey AS k, risk, CASE risk WHEN 'High' THEN 'Both services write to shared resource ''' || p_name || ''' - potential race conditions'
  WHEN 'Medium' THEN 'Services share resource ''' || p_name || ''' (one writes, one reads) - schema changes affect both' ELSE 'Services share read access to ''' || p_name || ''' - changes to data may affect both' END AS reason
  FROM part, (VALUES ('High'), ('Medium'), ('Low')) t(risk))"""


@register(
    _REASONS
    + """ SELECT k, risk, reason, CASE WHEN contains(lower(reason), 'high') OR contains(lower(reason), 'multiple writers') THEN 'High' WHEN contains(lower(reason), 'medium') OR contains(lower(reason), 'write') THEN 'Medium' ELSE 'Low' END AS guessed,
coalesce(nullif(regexp_extract(reason, 'shared ([^ ,)]+)', 1), ''), nullif(regexp_extract(reason, 'via ([^ ,)]+)', 1), ''), '-') AS resource, CASE risk WHEN 'High' THEN 0.95::DOUBLE WHEN 'Medium' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM r"""
)
def coupling_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons written for each risk, and what is read back from them."""
    risks = F.explode(F.array(*[F.lit(r) for r in ("High", "Medium", "Low")]))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", risks.alias("risk")).withColumn("reason", S.coupling_reason("risk", "p_name"))
    return r.select("k", "risk", "reason", S.risk_from_reason("reason").alias("guessed"), S.resource_from_reason("reason").alias("resource"), S.confidence("risk").cast("double").alias("confidence"))


@register(" SELECT s_suppkey AS k, 'q-' || s_name AS queue, CASE WHEN s_suppkey % 3 = 0 THEN 'org' END AS owner, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS repo FROM supplier")
def name_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue names of URLs; owner and repository of texts that hold both, or not."""
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("org/"), "s_name")).when(k % 3 == 1, F.concat(F.lit("org/x/"), "s_name")).otherwise(F.concat(F.lit("/"), "s_name"))
    both = S.owner_repo(text)
    return table(spark, sf_dir, "supplier").select(k.alias("k"), S.queue_name(F.concat(F.lit("https://sqs.example/123/q-"), "s_name")).alias("queue"), both["owner"].alias("owner"), both["repo"].alias("repo"))


@register(
    """ SELECT p_partkey AS k, p_size % 5 IN (0, 1, 2) AS parsed, p_size % 7 = 3 AS skipped, CASE p_size % 5 WHEN 0 THEN 'js' WHEN 1 THEN 'py' WHEN 2 THEN 'tf' WHEN 3 THEN 'md' ELSE '' END AS ext,
p_brand LIKE 'Brand#1%' OR p_brand LIKE '%5' AS excluded FROM part"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a survey reads: by extension, by folder, by the repository's globs."""
    size = F.col("p_size")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".js", ".PY", ".tf", ".md", "")]), (size % 5 + 1).cast("int"))
    path = F.concat(F.when(size % 7 == 3, F.lit("web/node_modules/")).otherwise(F.lit("web/src/")), F.lit("f"), ext)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), incremental.is_parseable(path).alias("parsed"), repos.ignored(path).alias("skipped"), incremental.extension(path).alias("ext"), repos.excluded("p_brand", ["Brand#1*", "*5"]).alias("excluded"))


@register(f" SELECT 'node' AS what, id AS a, display_name AS b FROM n WHERE id = '{START}' UNION ALL SELECT 'queue', id, display_name FROM n WHERE node_type = 'queue' UNION ALL SELECT 'edge', src, dst FROM e WHERE edge_type = 'PUBLISHES'")
@on_graph
def lookups(g: Graph) -> DataFrame:
    node = query.get_node(g, START).union(query.nodes_by_type(g, "queue"))
    what = F.when(F.col("node_type") == "queue", "queue").otherwise("node")
    return node.select(what.alias("what"), F.col("id").alias("a"), F.col("display_name").alias("b")).union(query.edges_by_type(g, "PUBLISHES").select(F.lit("edge"), "src", "dst"))


@register(" SELECT src, s.display_name AS src_name, dst, d.display_name AS dst_name, ev AS reason FROM e JOIN n s ON s.id = src JOIN n d ON d.id = dst WHERE edge_type = 'CALLS'")
@on_graph
def implicit_couplings(g: Graph) -> DataFrame:
    """The view of coupling edges, over calls that stand for them."""
    e = g.edges.where("edge_type = 'CALLS'").withColumn("edge_type", F.lit("IMPLICITLY_COUPLED")).withColumn("reason", F.col("evidence")[0])
    return query.implicit_couplings(Graph(g.nodes, e))


def _in_repositories(g: Graph) -> Graph:
    """Parts are declared in a file of the folder of the customer with their key, if any."""
    file = F.concat(F.lit("live/"), F.replace("name", F.lit("part"), F.lit("customer")), F.lit("/terraform/main.tf"))
    return Graph(g.nodes.withColumn("source_file", F.when(F.col("node_type") == "database", file)), g.edges)


@register(" SELECT d.id AS res, s.id AS owner FROM n d JOIN n s ON s.name = 'customer-' || CAST(d.key AS VARCHAR) WHERE d.node_type = 'database'")
@on_graph
def terraform_path_owner(g: Graph) -> DataFrame:
    return coupling.terraform_owners(_in_repositories(g))


@register(
    """, acc AS (SELECT DISTINCT dst AS res, src AS svc, edge_type IN ('WRITES', 'PUBLISHES') AS w FROM e WHERE edge_type <> 'CALLS' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
excl AS (SELECT res, min(svc) AS owner FROM acc WHERE w GROUP BY res HAVING count(DISTINCT svc) = 1), tf AS (SELECT d.id AS res, s.id AS owner FROM n d JOIN n s ON s.name = 'customer-' || CAST(d.key AS VARCHAR) WHERE d.node_type = 'database')
SELECT a.res, coalesce(tf.owner, excl.owner) AS owner, CASE WHEN tf.owner IS NOT NULL THEN 'terraform_path' ELSE 'exclusive_writer' END AS rule, CASE WHEN tf.owner IS NOT NULL THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence
FROM (SELECT DISTINCT res FROM acc) a LEFT JOIN tf USING (res) LEFT JOIN excl USING (res) WHERE coalesce(tf.owner, excl.owner) IS NOT NULL"""
)
@on_graph
def ownership_by_path(g: Graph) -> DataFrame:
    """Ownership where the first rule, the folder of the declaring file, can hold."""
    g = _in_repositories(g)
    return coupling.ownership(g, coupling.access_map(g))


@register(" SELECT 'node' AS what, count(*) AS n FROM n WHERE node_type <> 'queue' UNION ALL SELECT 'edge', count(*) FROM e WHERE dst NOT IN (SELECT id FROM n WHERE node_type = 'queue')")
@on_graph
def removed_queues(g: Graph) -> DataFrame:
    """The graph without its queues and their edges."""
    left = build.remove_nodes(g, query.nodes_by_type(g, "queue"))
    return left.nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "n").union(left.edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n"))


@register(" SELECT id, 'second ' || CAST(key AS VARCHAR) AS purpose, owner, CASE WHEN gotchas THEN 3 ELSE 1 END AS gotchas, 'a note' AS note FROM n WHERE node_type = 'service'")
@on_graph
def applied_answers(g: Graph) -> DataFrame:
    """Answers to each service's questions: the last purpose, a gotcha, a note."""
    svc = g.nodes.where("node_type = 'service'")
    key = F.element_at(F.split("name", "-"), 2)
    said = [("purpose", F.lit("first"), 0), ("purpose", F.concat(F.lit("second "), key), 1), ("gotcha", F.lit("watch out"), 2), ("note", F.lit("a note"), 3)]
    answers = svc.select(F.col("id").alias("node_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("annotation"), x.alias("answer"), F.lit(k).alias("seq")) for a, x, k in said])).alias("x")).select("node_id", "x.*")
    c = F.col("business_context")
    return gaps.apply_answers(svc, answers).select("id", c["purpose"].alias("purpose"), c["owner"].alias("owner"), F.size(c["gotchas"]).alias("gotchas"), c["notes"]["note_1"].alias("note"))


@register(
    RELEVANT
    + """, s AS (SELECT translate(id, ':-/', '___') AS i, * FROM n WHERE id IN (SELECT id FROM sub))
SELECT '        ' || i || CASE node_type WHEN 'service' THEN '[' || display_name || '<br/>' || language || '/' || framework || ']' WHEN 'database' THEN '[(' || display_name || '<br/>' || brand || ')]' ELSE '[>' || display_name || '<br/>stream]' END AS line FROM s
UNION ALL SELECT '    ' || translate(src, ':-/', '___') || ' -->|' || edge_type || '| ' || translate(dst, ':-/', '___') FROM e WHERE src IN (SELECT id FROM sub) AND dst IN (SELECT id FROM sub)"""
)
@on_graph
def mermaid_subgraph(g: Graph) -> DataFrame:
    scored, edges = _subgraph(g)
    return render.mermaid(g, edges, scored).where("part in (1, 4)").select("line")


def _discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as repositories: each is a service, imports the next supplier's,
    calls an API, writes a queue that its nation reads too, and uses a bucket."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    name = F.concat(F.lit("svc-"), text)
    rows = {
        "service": {"name": name, "language": F.lit("python"), "entry_point": F.lit("app.py")},
        "import": {"module": F.concat(F.lit("svc-"), (k + 1).cast("string")), "is_relative": F.lit(False)},
        "api_call": {"target": F.concat(F.lit("https://api/"), text), "method": F.lit("GET")},
        "queue_operation": {"name": F.concat(F.lit("q-"), F.col("s_nationkey").cast("string")), "sub_type": F.lit("sqs"), "operation": F.when(k % 2 == 0, "Publish").otherwise("Subscribe")},
        "cloud_resource": {"sub_type": F.lit("s3")},
        "database_access": {"name": F.lit("shared-table"), "sub_type": F.lit("dynamodb"), "operation": F.when(k % 3 == 0, "ReadWrite").otherwise("Read")},
    }
    out = None
    empty = spark.createDataFrame([], DISCOVERIES)
    for n, (kind, cols) in enumerate(rows.items()):
        fixed = {"ordinal": k * 10 + n, "repo": F.concat(F.lit("org/r"), text), "kind": F.lit(kind), "source_file": F.lit("app.py"), "source_line": F.lit(n + 1)}
        given = fixed | cols
        part = table(spark, sf_dir, "supplier").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
        out = part if out is None else out.union(part)
    return out


_BUILT = """, s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS t, s_nationkey AS q FROM supplier)"""


@register(
    _BUILT
    + """ SELECT 'svc-' || a.t AS src, 'svc-' || b.t AS dst, 'CALLS' AS edge_type, 'app.py:2' AS evidence FROM s a JOIN s b ON b.k = a.k + 1
UNION ALL SELECT 'svc-' || t, 'q-' || CAST(q AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'PUBLISHES' ELSE 'SUBSCRIBES' END, 'app.py:4' FROM s UNION ALL SELECT 'svc-' || t, 's3-unknown', 'USES', 'app.py:5' FROM s
UNION ALL SELECT 'svc-' || t, 'shared-table', 'READS', 'app.py:6' FROM s UNION ALL SELECT 'svc-' || t, 'shared-table', 'WRITES', 'app.py:6' FROM s WHERE k % 3 = 0"""
)
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of discoveries: calls by imports, queues, unnamed cloud resources, tables read and written."""
    g, _ = build.build(_discoveries(spark, sf_dir))
    name = g.nodes.select("id", "display_name")
    e = g.edges.join(name.toDF("src", "s"), "src").join(name.toDF("dst", "d"), "dst")
    return e.select(F.col("s").alias("src"), F.col("d").alias("dst"), "edge_type", F.array_join("evidence", ",").alias("evidence"))


@register(
    _BUILT
    + """ SELECT 'service:org-r' || t || ':svc-' || t AS id, 'python' AS language, 'https://api/' || t AS called FROM s
UNION ALL SELECT 'queue:org-r' || CAST(min(k) AS VARCHAR) || ':q-' || CAST(q AS VARCHAR), NULL, NULL FROM s GROUP BY q
UNION ALL SELECT 'cloud_resource:org-r' || CAST(min(k) AS VARCHAR) || ':s3-unknown', NULL, NULL FROM s HAVING count(*) > 0 UNION ALL SELECT 'database:org-r' || CAST(min(k) AS VARCHAR) || ':shared-table', NULL, NULL FROM s HAVING count(*) > 0"""
)
def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of discoveries: the first repository names a shared resource, calls are an attribute."""
    g, _ = build.build(_discoveries(spark, sf_dir))
    called = F.variant_get(F.col("attributes")["api_calls"], "$[0].target", "string")
    return g.nodes.select("id", S.attr("language").alias("language"), called.alias("called"))
