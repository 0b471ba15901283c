"""Markdown, JSON and diagram renderings (RND1-RND7) as ordered line tables.

Each renderer returns rows (sort keys, line); ``text`` joins them on the driver
for one document, which is the sink's nature, while the lines themselves are
made by joins and expressions over all nodes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import scalars as S
from ..operators.instructions import instructions
from ..schema import Graph

FORMATS = {"md": "markdown", "markdown": "markdown", "json": "json", "mmd": "mermaid", "mermaid": "mermaid"}
SECTIONS = (("service", "Services"), ("database", "Databases"), ("queue", "Queues"), ("cloud_resource", "Cloud Resources"), ("api", "APIs"))
DIAGRAM_SECTIONS = {"cloud_resource": "Resources"}
CLASSES = (("service", "service", "fill:#4a86e8,stroke:#333,stroke-width:2px,color:white"), ("database", "database", "fill:#f1c232,stroke:#333,stroke-width:2px"), ("queue", "queue", "fill:#6aa84f,stroke:#333,stroke-width:2px,color:white"), ("cloud_resource", "resource", "fill:#9fc5e8,stroke:#333,stroke-width:2px"))


def format_name(name: str) -> str:
    """The format of a name or alias, in any case (RND7)."""
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise EngineError(f"unknown format {name!r}") from None


def text(lines: DataFrame) -> str:
    order = [c for c in lines.columns if c != "line"]
    return "\n".join(r["line"] for r in lines.orderBy(*order).select("line").collect()) + "\n"


def _rank(kind: Column | str = "node_type") -> Column:
    return S.lookup(kind, {k: n for n, (k, _) in enumerate(SECTIONS)})


def _head(g: Graph, title: str, nodes: DataFrame) -> DataFrame:
    """Title and section headings of the types that occur."""
    top = g.spark.range(1).select(F.lit(-1).alias("section"), F.lit(-1).cast("bigint").alias("ordinal"), F.lit("").alias("id"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("k"), F.lit(f"# {title}\n").alias("line"))
    names = S.lookup("node_type", {k: f"## {n}\n" for k, n in SECTIONS})
    heads = nodes.select("node_type").distinct().select(_rank().alias("section"), F.lit(-1).cast("bigint").alias("ordinal"), F.lit("").alias("id"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("k"), names.alias("line"))
    return top.union(heads)


def _lines(nodes: DataFrame, part: int, line: Column, when: Column | None = None) -> DataFrame:
    rows = nodes if when is None else nodes.where(when)
    return rows.select(_rank().alias("section"), "ordinal", "id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("k"), line.alias("line"))


def _tabled(rows: DataFrame, part: int, title: str, header: str, rule: str, line: Column, k: str = "k") -> DataFrame:
    """A titled table of rows per node, closed by an empty line."""
    body = rows.select("section", "ordinal", "id", F.lit(part).alias("part"), F.col(k).cast("bigint").alias("k"), line.alias("line"))
    edge = rows.select("section", "ordinal", "id").distinct()
    top = "\n".join(x for x in (title, header, rule) if x)
    first = edge.select("section", "ordinal", "id", F.lit(part).alias("part"), F.lit(-1).cast("bigint").alias("k"), F.lit(top).alias("line"))
    last = edge.select("section", "ordinal", "id", F.lit(part).alias("part"), F.lit((1 << 63) - 1).alias("k"), F.lit("").alias("line"))
    return first.union(body).union(last)


def markdown(g: Graph, staleness_days: int = 0, as_of: Column | None = None, business_context: bool = True, evidence: bool = True, max_evidence: int = 3) -> DataFrame:
    """The whole graph (RND1)."""
    n = g.nodes
    a = S.attr
    as_of = F.lit(None).cast("timestamp") if as_of is None else as_of
    is_ = lambda t: F.col("node_type") == t
    c = F.col("business_context")
    bold = lambda name, v: F.concat(F.lit(f"**{name}**: "), v, F.lit("\n"))
    out = _head(g, "Ecosystem Knowledge Graph", n)
    out = out.union(_lines(n, 1, F.concat(F.lit("### "), F.col("display_name"), F.lit("\n"))))
    language = F.concat(F.lit("**Type**: Service | **Language**: "), F.coalesce(a("language"), F.lit("unknown")), F.coalesce(F.concat(F.lit(" | **Framework**: "), a("framework")), F.lit("")), F.lit("\n"))
    kind = F.coalesce(F.when(is_("database"), a("db_type")).when(is_("queue"), a("queue_type")).otherwise(a("resource_type")), F.lit("unknown"))
    out = out.union(_lines(n, 2, F.when(is_("service"), language).otherwise(bold("Type", kind)), ~is_("api")))
    out = out.union(_lines(n, 2, bold("Path", F.concat(F.lit("`"), a("path"), F.lit("`"))), is_("api") & a("path").isNotNull())).union(_lines(n, 3, bold("Method", a("method")), is_("api") & a("method").isNotNull()))
    out = out.union(_lines(n, 4, bold("Repository", a("repo_url")), is_("service") & a("repo_url").isNotNull()))
    out = out.union(_lines(n, 5, bold("Table Name", a("table_name")), is_("database") & (a("table_name") != F.col("display_name"))))
    out = out.union(_lines(n, 6, bold("ARN", F.concat(F.lit("`"), a("arn"), F.lit("`"))), ~is_("service") & ~is_("api") & a("arn").isNotNull()))
    if staleness_days:
        out = out.union(_lines(n, 7, F.concat(F.lit("⚠️ **Status**: Stale ("), S.staleness("updated_at", as_of), F.lit(") - May be outdated\n")), ~is_("api") & S.is_stale("updated_at", staleness_days, as_of)))
    if business_context:
        for k, name in enumerate(("purpose", "owner", "history")):
            out = out.union(_lines(n, 8 + k, bold(name.title(), c[name]), is_("service") & c[name].isNotNull()))
        listed = F.concat(F.lit("**Gotchas**:\n"), F.array_join(F.transform(c["gotchas"], lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
        out = out.union(_lines(n, 11, listed, is_("service") & (F.size(c["gotchas"]) > 0)))
    me = n.select("id", "node_type", _rank().alias("section"), "ordinal")
    name = n.select(F.col("id").alias("other"), F.col("display_name").alias("other_name"))
    e = g.edges.select("src", "dst", "edge_type", "reason", F.col("ordinal").alias("k"), (S.evidence_text("evidence", max_evidence) if evidence else F.lit("-")).alias("ev"))
    outgoing = me.join(e.withColumnRenamed("src", "id").withColumnRenamed("dst", "other"), "id").join(name, "other")
    incoming = me.join(e.withColumnRenamed("dst", "id").withColumnRenamed("src", "other"), "id").join(name, "other")
    cell = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    owner = incoming.where("edge_type = 'OWNS' and node_type in ('database', 'api')").groupBy("section", "ordinal", "id").agg(F.min_by("other_name", "k").alias("o"))
    out = out.union(owner.select("section", "ordinal", "id", F.lit(12).alias("part"), F.lit(0).cast("bigint").alias("k"), bold("Owner", F.col("o")).alias("line")))
    out = out.union(_tabled(outgoing.where("node_type = 'service'"), 13, "**Dependencies**:", "| Target | Relationship | Evidence |", "|--------|--------------|----------|", cell("other_name", S.edge_label("edge_type"), "ev")))
    out = out.union(_tabled(incoming.where("node_type = 'service' and edge_type = 'CALLS'"), 14, "**Dependents**:", "| Source | Relationship |", "|--------|--------------|", cell("other_name", F.lit("Calls"))))
    pair = outgoing.union(incoming.select(*outgoing.columns)).where("node_type = 'service' and edge_type = 'IMPLICITLY_COUPLED'")
    out = out.union(_tabled(pair, 15, "**Implicit Couplings**:", "", "", F.concat(F.lit("- `"), F.col("other_name"), F.lit("` - "), F.coalesce("reason", F.lit("shared resource")))))
    mode = F.when(F.col("edge_type").isin("READS", "READS_SHARED"), "READ").otherwise("WRITE")
    out = out.union(_tabled(incoming.where("node_type = 'database' and edge_type in ('READS', 'WRITES', 'READS_SHARED', 'WRITES_SHARED')"), 16, "**Accessed By**:", "| Service | Access Type | Evidence |", "|---------|-------------|----------|", cell("other_name", mode, "ev")))
    for part, kind_, type_, title in ((17, "queue", "PUBLISHES", "Publishers"), (18, "queue", "SUBSCRIBES", "Subscribers"), (19, "cloud_resource", "USES", "Used By")):
        who = incoming.where((F.col("node_type") == kind_) & (F.col("edge_type") == type_)).groupBy("section", "ordinal", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "other_name"))), lambda x: x["other_name"]), ", ").alias("names"))
        out = out.union(who.select("section", "ordinal", "id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("k"), bold(title, F.col("names")).alias("line")))
    out = out.union(_lines(n, 99, F.lit("---\n")))
    pairs = e.where("edge_type = 'IMPLICITLY_COUPLED'").join(name.toDF("src", "a"), "src").join(name.toDF("dst", "b"), "dst")
    why = F.coalesce("reason", F.lit("shared resource"))
    row = cell(F.concat("a", F.lit(" ↔ "), "b"), S.resource_from_reason(why), S.risk_from_reason(why), why)
    summary = pairs.select(F.lit(len(SECTIONS)).alias("section"), F.lit(0).cast("bigint").alias("ordinal"), F.lit("").alias("id"), "k", row.alias("l"))
    return out.union(_tabled(summary, 1, "## Implicit Couplings (Risk Summary)\n", "| Services | Shared Resource | Risk | Reason |", "|----------|-----------------|------|--------|", F.col("l")))


def markdown_subgraph(g: Graph, scored: DataFrame, edges: DataFrame, business_context: bool = True) -> DataFrame:
    """A relevance subgraph, best first; APIs belong to their services (RND2)."""
    a = S.attr
    s = scored.join(g.nodes, "id").where("node_type <> 'api'").withColumn("ordinal", (F.lit(1_000_000_000) * (1 - F.col("score"))).cast("bigint"))
    out = _head(g, "Relevant Context", s)
    head = F.concat(F.lit("### "), F.col("display_name"), F.lit(" ["), S.relevance_tag("score"), F.lit("] (relevance: "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%)\n"))
    out = out.union(_lines(s, 1, head))
    near = F.col("score") > 0.5
    out = out.union(_lines(s, 2, F.lit("*Exists in ecosystem*\n"), ~near))
    kind = F.when(F.col("node_type") == "service", F.concat(F.lit("**Language**: "), a("language"))).when(F.col("node_type") == "database", F.concat(F.lit("**Type**: "), a("db_type"))).when(F.col("node_type") == "queue", F.concat(F.lit("**Type**: "), a("queue_type")))
    out = out.union(_lines(s, 3, kind, near & kind.isNotNull()))
    if business_context:
        out = out.union(_lines(s, 4, F.concat(F.lit("**Purpose**: "), F.col("business_context.purpose")), near & F.col("business_context.purpose").isNotNull()))
    me = s.where(near).select("id", _rank().alias("section"), "ordinal")
    name = g.nodes.select(F.col("id").alias("other"), F.col("display_name").alias("other_name"))
    ways = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("→").alias("arrow"), "edge_type", F.col("ordinal").alias("k")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("←").alias("arrow"), "edge_type", F.col("ordinal").alias("k")))).alias("e")).select("e.*")
    related = me.join(ways, "id").join(name, "other")
    out = out.union(_tabled(related, 5, "\n**Relationships in context**:", "", "", F.concat_ws(" ", F.lit("-"), "arrow", S.edge_label("edge_type"), "other_name")))
    return out.union(_lines(s, 99, F.lit("---\n")))


def node_label(staleness_days: int = 0, as_of: Column | None = None, attributes: bool = True) -> Column:
    """Escaped name, a warning if stale, and language, database or queue type (API14)."""
    a = S.attr
    as_of = F.lit(None).cast("timestamp") if as_of is None else as_of
    stale = F.when(S.is_stale("updated_at", staleness_days, as_of), " ⚠️").otherwise("") if staleness_days else F.lit("")
    if not attributes:
        return F.concat(S.escape_label("display_name"), stale)
    kind = F.col("node_type")
    more = F.when(kind == "service", F.concat_ws("/", a("language"), F.when(a("language").isNotNull(), a("framework")))).when(kind == "database", a("db_type")).when(kind == "queue", a("queue_type"))
    return F.concat(S.escape_label("display_name"), stale, F.when(F.length(more) > 0, F.concat(F.lit("<br/>"), more)).otherwise(""))


def mermaid(g: Graph, edges: DataFrame | None = None, scored: DataFrame | None = None, direction: str = "LR", styles: bool = True, staleness_days: int = 0, as_of: Column | None = None, attributes: bool = True) -> DataFrame:
    """A flowchart of the graph, or of a subgraph if ``scored`` is given (RND4, RND5)."""
    n = g.nodes if scored is None else g.nodes.join(scored.select("id"), "id", "left_semi")
    e = g.edges if edges is None else edges
    sub = scored is not None
    label = node_label(staleness_days, as_of, attributes)
    plain = F.col("display_name") if not sub else label
    wrap = lambda x, l, r: F.concat(F.lit(l), x, F.lit(r))
    kind = F.col("node_type")
    shape = F.when(kind == "service", wrap(label, "[", "]")).when(kind == "database", wrap(label, "[(", ")]") if sub else wrap(label, '[("', '")]')).when(kind == "queue", wrap(label, "[>" if sub else ">", "]")).when(kind == "cloud_resource", wrap(plain, "{{", "}}")).otherwise(wrap(plain, "([", "])"))
    row = lambda section, ordinal, part, line: (section.alias("section"), ordinal.cast("bigint").alias("ordinal"), F.lit(part).alias("part"), line.alias("line"))
    lit = F.lit
    out = g.spark.range(1).select(*row(lit(-1), lit(0), 0, lit(f"flowchart {direction}")))
    out = out.union(n.select(*row(_rank(), F.col("ordinal"), 1, F.concat(lit("        "), S.sanitize("id"), shape))))
    types = n.select("node_type").distinct()
    title = S.lookup("node_type", {k: "    subgraph " + DIAGRAM_SECTIONS.get(k, t) for k, t in SECTIONS})
    out = out.union(types.select(*row(_rank(), lit(-1), 0, title))).union(types.select(*row(_rank(), lit(0), 2, lit("    end"))))
    arrow = F.when(F.col("edge_type") == "IMPLICITLY_COUPLED", "-.->").otherwise("-->")
    out = out.union(g.spark.range(1).select(*row(lit(10), lit(-1), 3, lit(""))))
    out = out.union(e.select(*row(lit(10), F.col("ordinal"), 4, F.concat(lit("    "), S.sanitize("src"), lit(" "), arrow, lit("|"), S.diagram_label("edge_type"), lit("| "), S.sanitize("dst")))))
    if styles:
        classes = g.spark.createDataFrame([("", 0), *[(f"    classDef {c} {s}", k + 1) for k, (_, c, s) in enumerate(CLASSES)]], "line string, ordinal bigint")
        out = out.union(classes.select(*row(lit(11), F.col("ordinal"), 5, F.col("line"))))
        for k, (t, c, _) in enumerate(CLASSES):
            ids = n.where(kind == t).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", S.sanitize("id").alias("i")))), lambda x: x["i"]).alias("ids")).where(F.size("ids") > 0)
            out = out.union(ids.select(*row(lit(12), lit(k), 6, F.concat(lit("    class "), F.array_join("ids", ","), lit(f" {c}")))))
    return out


def json_nodes(g: Graph, scored: DataFrame | None = None, staleness_days: int = 0, as_of: Column | None = None) -> DataFrame:
    """(id, node): one JSON object a node, with relevance, instructions and staleness where they apply."""
    n = g.nodes.join(instructions(g), "id", "left")
    n = n if scored is None else n.join(scored.select("id", "score"), "id")
    as_of = F.lit(None).cast("timestamp") if as_of is None else as_of
    attributes = F.to_json(F.to_variant_object("attributes"))
    parts = [F.col("id"), F.col("node_type").alias("type"), F.col("display_name").alias("name")]
    if scored is not None:
        parts.append(F.col("score").alias("relevance"))
    parts += [F.parse_json(F.coalesce(attributes, F.lit("{}"))).alias("attributes"), F.col("business_context"), F.col("instructions").alias("llm_instructions")]
    if staleness_days:
        parts.append(F.struct(S.is_stale("updated_at", staleness_days, as_of).alias("is_stale"), S.age_days("updated_at", as_of).alias("age_days"), S.staleness("updated_at", as_of).alias("description")).alias("staleness"))
    return n.select("ordinal", "id", F.to_json(F.struct(*parts)).alias("node"))


def json_edges(edges: DataFrame) -> DataFrame:
    meta = F.struct("confidence", "reason", "evidence", "http_method", "endpoint_path", "discovered_at", "confirmed")
    return edges.select("ordinal", F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"), meta.alias("metadata"))).alias("edge"))


def json_document(g: Graph, generated_at: str, scored: DataFrame | None = None, edges: DataFrame | None = None, query: dict | None = None, **options) -> str:
    """The whole document; it is assembled on the driver, as a single file is (RND3)."""
    import json

    nodes = [json.loads(r["node"]) for r in json_nodes(g, scored, **options).orderBy("ordinal", "id").collect()]
    links = [json.loads(r["edge"]) for r in json_edges(g.edges if edges is None else edges).orderBy("ordinal").collect()]
    by_type: dict[str, int] = {}
    for x in nodes:
        by_type[x["type"]] = by_type.get(x["type"], 0) + 1
    return json.dumps({"$schema": "graph-v1", "version": "1.0.0", "generated_at": generated_at, "query": query or {"type": "full" if scored is None else "subgraph"}, "nodes": nodes, "edges": links, "summary": {"total_nodes": len(nodes), "total_edges": len(links), "by_type": by_type}}, ensure_ascii=False, indent=2)


def budgeted(g: Graph, scored: DataFrame, edges: DataFrame, budget: int, fmt: str = "markdown") -> str:
    """A subgraph rendered from the nodes and edges that fit the budget (RND6, G1)."""
    from ..operators.budget import estimated, select_edges, select_nodes

    kept = select_nodes(estimated(g, scored), budget)
    inside = select_edges(edges, kept, budget)
    fmt = format_name(fmt)
    if fmt == "json":
        return json_document(g, "", kept, inside, {"type": "budgeted", "budget": budget})
    return text(mermaid(g, inside, kept)) if fmt == "mermaid" else text(markdown_subgraph(g, kept, inside))
