"""Context gaps, interview questions and annotations (ANA7, SCL21, AGG9, JN13, JN14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .query import degrees

GAP_ACCESS = ("READS", "WRITES", "READS_SHARED", "WRITES_SHARED", "PUBLISHES", "SUBSCRIBES")
QUESTION_KINDS = {"missing_purpose": ("purpose", 9), "missing_owner": ("owner", 7), "high_centrality": ("purpose", 8), "implicit_coupling": ("note", 7), "shared_without_owner": ("owner", 8), "complex_without_gotchas": ("gotcha", 5)}


@dataclass(frozen=True)
class GapConfig:
    missing_purpose: float = 0.3
    missing_owner: float = 0.2
    centrality_from: int = 5
    most_centrality: float = 0.2
    coupling: float = 0.15
    shared_resource: float = 0.25
    complexity_from: int = 3
    without_gotchas: float = 0.1


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(c) == 0, F.lit(True))


def coupled_names(g: Graph) -> DataFrame:
    """(id, coupled): sorted distinct names of coupled services, either way."""
    e = g.edges.where("edge_type = 'IMPLICITLY_COUPLED'")
    ways = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*")
    names = g.nodes.select(F.col("id").alias("other"), "display_name")
    return ways.join(names, "other").groupBy("id").agg(F.array_sort(F.collect_set("display_name")).alias("coupled"))


def gaps(g: Graph, config: GapConfig = GapConfig()) -> DataFrame:
    """(node_id, score, reasons array<struct<idx, kind, detail>>) where score > 0, capped at 1."""
    reason = lambda idx, kind, when, weight, detail: F.when(when, F.struct(F.lit(idx).alias("idx"), F.lit(kind).alias("kind"), detail.alias("detail"), weight.cast("double").alias("weight")))
    deg = degrees(g)
    node = g.nodes.select("id", "node_type", "display_name", "business_context")
    service = node.where("node_type = 'service'").join(deg, "id", "left").join(coupled_names(g), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    c = F.col("business_context")
    d = F.col("degree")
    central = F.lit(config.most_centrality) * F.least(d / F.lit(10.0), F.lit(1.0))
    no_gotchas = F.coalesce(F.size(c["gotchas"]) <= 0, F.lit(True))
    own = F.array_compact(
        F.array(
            reason(0, "missing_purpose", _blank(c["purpose"]), F.lit(config.missing_purpose), F.lit("no purpose documented")),
            reason(1, "missing_owner", _blank(c["owner"]), F.lit(config.missing_owner), F.lit("no owner documented")),
            reason(2, "high_centrality", d >= config.centrality_from, central, F.concat(d.cast("string"), F.lit(" connections"))),
            reason(3, "implicit_coupling", F.size("coupled") > 0, F.lit(config.coupling), F.array_join("coupled", ", ")),
            reason(4, "complex_without_gotchas", no_gotchas & (d >= config.complexity_from), F.lit(config.without_gotchas), F.concat(d.cast("string"), F.lit(" dependencies"))),
        )
    )
    services = service.select(F.col("id").alias("node_id"), own.alias("reasons"))
    names = g.nodes.select(F.col("id").alias("src"), F.col("display_name").alias("accessor"))
    access = g.edges.where(F.col("edge_type").isin(*GAP_ACCESS)).select("src", F.col("dst").alias("id")).join(names, "src").groupBy("id").agg(F.array_sort(F.collect_set("accessor")).alias("accessors"))
    owned = g.edges.where("edge_type = 'OWNS'").select(F.col("dst").alias("id"))
    shared = node.where("node_type in ('database', 'queue')").join(access.where(F.size("accessors") > 1), "id").join(owned, "id", "left_anti")
    resources = shared.select(F.col("id").alias("node_id"), F.array(reason(0, "shared_without_owner", F.lit(True), F.lit(config.shared_resource), F.array_join("accessors", ", "))).alias("reasons"))
    both = services.union(resources)
    total = F.aggregate("reasons", F.lit(0.0), lambda a, x: a + x["weight"])
    return both.select("node_id", F.least(F.lit(1.0), total).alias("score"), "reasons").where("score > 0")


def questions(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """(priority, node_id, kind, annotation, question, context) per gap reason,
    priority falling, then score, then id, then reason (SRT3)."""
    found = gaps(g) if found is None else found
    name = g.nodes.select(F.col("id").alias("node_id"), "display_name")
    out_names = g.edges.select("src", F.col("dst").alias("id"), "ordinal").join(g.nodes.select("id", F.col("display_name").alias("n")), "id").groupBy(F.col("src").alias("node_id")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ordinal", "n"))), 1, 5), lambda x: x["n"]).alias("deps"))
    callers = g.edges.where("edge_type = 'CALLS'").select(F.col("src").alias("id"), F.col("dst").alias("node_id"), "ordinal").join(g.nodes.select("id", F.col("display_name").alias("n")), "id").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "n"))), lambda x: x["n"]).alias("callers"))
    deg = degrees(g).select(F.col("id").alias("node_id"), "outgoing", "incoming")
    q = found.select("node_id", "score", F.explode("reasons").alias("r")).select("node_id", "score", "r.idx", "r.kind", "r.detail")
    q = q.join(name, "node_id").join(out_names, "node_id", "left").join(callers, "node_id", "left").join(deg, "node_id", "left")
    n = F.concat(F.lit("'"), F.col("display_name"), F.lit("'"))
    kind = F.col("kind")
    text = (
        F.when(kind == "missing_purpose", F.concat(F.lit("What is "), n, F.lit(" for, and which problem does it solve?")))
        .when(kind == "missing_owner", F.concat(F.lit("Who is responsible for "), n, F.lit("?")))
        .when(kind == "high_centrality", F.concat(F.lit("Why is "), n, F.lit(" so connected, and what core capability does it provide?")))
        .when(kind == "implicit_coupling", F.concat(n, F.lit(" shares resources with "), F.col("detail"), F.lit(". Is this intended, and how is it coordinated?")))
        .when(kind == "shared_without_owner", F.concat(F.lit("Which service owns "), n, F.lit(", used by "), F.col("detail"), F.lit("?")))
        .otherwise(F.concat(F.lit("Which gotchas of "), n, F.lit(" should a newcomer know?")))
    )
    context = (
        F.when(kind == "missing_purpose", F.when(F.size("deps") > 0, F.concat(n, F.lit(" depends on: "), F.array_join("deps", ", "))).otherwise(F.concat(n, F.lit(" has no documented dependencies"))))
        .when(kind == "missing_owner", F.lit("Ownership tells whom to ask and to page"))
        .when(kind == "high_centrality", F.concat(n, F.lit(" has "), F.col("detail"), F.lit("; called by: "), F.coalesce(F.array_join("callers", ", "), F.lit("no direct callers"))))
        .when(kind == "implicit_coupling", F.concat(F.lit("Coupled through shared resources with "), F.col("detail")))
        .when(kind == "shared_without_owner", F.lit("Shared data needs an owner for its schema"))
        .otherwise(F.concat(n, F.lit(" has "), F.coalesce("outgoing", F.lit(0)).cast("string"), F.lit(" outgoing and "), F.coalesce("incoming", F.lit(0)).cast("string"), F.lit(" incoming connections")))
    )
    from ..functions.scalars import lookup

    priority = F.least(F.lit(10), F.greatest(F.lit(1), lookup("kind", {k: p for k, (_, p) in QUESTION_KINDS.items()})))
    annotation = lookup("kind", {k: a for k, (a, _) in QUESTION_KINDS.items()})
    return q.select(priority.alias("priority"), "node_id", "kind", annotation.alias("annotation"), text.alias("question"), context.alias("context"), "score", "idx").orderBy(F.desc("priority"), F.desc("score"), "node_id", "idx")


def merge_context(old: Column, new: Column) -> Column:
    """``new`` keeps what it has and takes the rest from ``old``: scalars that are
    missing, gotchas in order without repeats, notes with its own preferred (AGG9)."""
    pick = lambda f: F.coalesce(new[f], old[f]).alias(f)
    none = F.array().cast("array<string>")
    gotchas = F.array_distinct(F.concat(F.coalesce(new["gotchas"], none), F.coalesce(old["gotchas"], none)))
    no_notes = F.create_map().cast("map<string,string>")
    mine, other = F.coalesce(new["notes"], no_notes), F.coalesce(old["notes"], no_notes)
    notes = F.map_concat(F.map_filter(other, lambda k, v: ~F.map_contains_key(mine, k)), mine)
    merged = F.struct(pick("purpose"), pick("owner"), pick("history"), gotchas.alias("gotchas"), notes.alias("notes"))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(merged)


def merge_annotations(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` nodes with the annotations that ``old`` nodes of the same id had (JN13)."""
    before = old.select("id", F.col("business_context").alias("__old"))
    return new.join(before, "id", "left").withColumn("business_context", merge_context(F.col("__old"), F.col("business_context"))).select(*new.columns)


def apply_answers(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """``nodes`` with ``answers(node_id, annotation, answer, seq)``: the last
    purpose, owner and history, every gotcha, notes under the next free keys."""
    last = lambda a: F.max_by(F.when(F.col("annotation") == a, F.col("answer")), F.when(F.col("annotation") == a, F.col("seq")))
    listed = lambda a: F.transform(F.array_sort(F.collect_list(F.when(F.col("annotation") == a, F.struct("seq", "answer")))), lambda x: x["answer"])
    said = answers.groupBy(F.col("node_id").alias("id")).agg(last("purpose").alias("p"), last("owner").alias("o"), last("history").alias("h"), listed("gotcha").alias("g"), listed("note").alias("n"))
    c = F.col("business_context")
    none = F.array().cast("array<string>")
    notes = F.coalesce(c["notes"], F.create_map().cast("map<string,string>"))
    start = F.size(notes)
    added = F.map_from_entries(F.transform(F.col("n"), lambda x, i: F.struct(F.concat(F.lit("note_"), (start + i + 1).cast("string")), x)))
    changed = F.struct(
        F.coalesce("p", c["purpose"]).alias("purpose"), F.coalesce("o", c["owner"]).alias("owner"), F.coalesce("h", c["history"]).alias("history"),
        F.concat(F.coalesce(c["gotchas"], none), F.col("g")).alias("gotchas"),
        F.map_concat(F.map_filter(notes, lambda k, v: ~F.map_contains_key(added, k)), added).alias("notes"),
    )
    return nodes.join(said, "id", "left").withColumn("business_context", F.when(F.col("g").isNotNull(), changed).otherwise(c)).select(*nodes.columns)


class Interview:
    """A session over a collected list of questions; answers become rows (API19)."""

    def __init__(self, asked: list, provider=None):
        self.asked, self.provider, self.at, self.given = asked, provider, 0, []

    @property
    def complete(self) -> bool:
        return self.at >= len(self.asked)

    def current(self):
        return None if self.complete else self.asked[self.at]

    def answer(self, text: str) -> None:
        q = self.asked[self.at]
        self.given.append((q["node_id"], q["annotation"], text, len(self.given)))
        self.at += 1

    def skip(self) -> None:
        self.at += 1

    def suggest(self) -> str | None:
        """A draft by the provider, a callable of (system, prompt)."""
        q = self.current()
        return None if q is None or self.provider is None else self.provider("You help to document a software ecosystem.", f"{q['question']}\n{q['context']}")

    def answers(self, spark) -> DataFrame:
        return spark.createDataFrame(self.given, "node_id string, annotation string, answer string, seq int")


def conversation_text(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): each conversation's turns in order as ``role: text`` lines (SCL25)."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


__all__ = ["GapConfig", "Interview", "apply_answers", "conversation_text", "gaps", "merge_annotations", "merge_context", "questions"]
