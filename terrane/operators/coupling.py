"""Access map, ownership, couplings and shared access (ANA1-ANA5, JN9-JN12)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import EDGE_RULES, Graph
from .query import first_by
from .traverse import settle

RESOURCES = ("database", "queue", "cloud_resource")
#: Accessors of a resource that meet in one task; larger resources are dealt out in blocks.
PAIR_BLOCK = 2000
#: Accessors above which a resource is a hub, and services of one class that meet in one task.
HUB, CLASS_BLOCK = 64, 256
#: Pairs of class members that a task writes, about, and tasks at most.
TASK_PAIRS, TASKS = 1 << 21, 20_000


def access_map(g: Graph) -> DataFrame:
    """(svc, res, reads, writes, evidence): one row per service and resource it
    touches; evidence is all of it, in the order of the edges (D10, D13)."""
    node = g.nodes.select("id", "node_type")
    e = g.edges.withColumn("mode", S.access_mode("edge_type")).where(F.col("mode").isin("read", "write"))
    typed = e.join(node.where("node_type = 'service'").select(F.col("id").alias("src")), "src", "left_semi").join(node.where(F.col("node_type").isin(*RESOURCES)).select(F.col("id").alias("dst")), "dst", "left_semi")
    items = F.array_sort(F.collect_list(F.struct("ordinal", "edge_type", "evidence")))
    return typed.groupBy(F.col("src").alias("svc"), F.col("dst").alias("res")).agg(
        F.bool_or(F.col("mode") == "read").alias("reads"),
        F.bool_or(F.col("mode") == "write").alias("writes"),
        F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>"))))).alias("evidence"),
    )


def declared_owners(g: Graph) -> DataFrame:
    """(res, owner) from OWNS edges; the last edge wins."""
    return g.edges.where("edge_type = 'OWNS'").groupBy(F.col("dst").alias("res")).agg(F.max_by("src", F.struct("ordinal", "src")).alias("owner"))


def naming_owners(g: Graph) -> DataFrame:
    """(res, owner): the first service whose name lies within the resource's name.

    A containment join would compare everything with everything. Instead each
    distinct resource name yields its substrings of the lengths that service names
    have, and those meet the first service of each name in an equi-join."""
    service = g.nodes.where("node_type = 'service'").select(F.col("id").alias("owner"), "ordinal", F.col("display_name").alias("name")).where(F.length("name") > 0)
    # distinct lengths of names: a name has 256 bytes at most, so these are few numbers
    lengths = sorted(r["n"] for r in service.select(F.length("name").alias("n")).distinct().collect())
    res = g.nodes.where(F.col("node_type").isin(*RESOURCES)).select(F.col("id").alias("res"), F.col("display_name").alias("text"))
    first = service.groupBy("name").agg(F.min(F.struct("ordinal", "owner")).alias("first"))
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))
    parts = F.array_distinct(F.flatten(F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("text")), starts)))
    texts = res.select("text").distinct()
    named = texts.select("text", F.explode(parts).alias("name")).join(first, "name").groupBy("text").agg(F.min("first").alias("first"))
    return res.join(named, "text").groupBy("res").agg(F.min("first").alias("first")).select("res", F.col("first.owner").alias("owner"))


def terraform_owners(g: Graph) -> DataFrame:
    """(res, owner) for resources declared in a .tf file: the directory above
    ``terraform`` or ``infra`` that is a service's name; the first such hit."""
    res = g.nodes.where(F.col("node_type").isin(*RESOURCES) & F.col("source_file").endswith(".tf")).select(F.col("id").alias("res"), F.posexplode(F.split("source_file", "/")).alias("at", "part"), F.split("source_file", "/").alias("parts"))
    hit = res.where(F.col("part").isin("terraform", "infra") & (F.col("at") > 0)).select("res", "at", F.element_at("parts", F.col("at")).alias("folder"))
    service = g.nodes.where("node_type = 'service'").select(F.col("id").alias("owner"), "ordinal", F.explode(F.array_distinct(F.array("display_name", "name"))).alias("folder"))
    return hit.join(service, "folder").groupBy("res").agg(F.min_by("owner", F.struct("at", "ordinal", "owner")).alias("owner"))


def exclusive_writers(access: DataFrame) -> DataFrame:
    """(res, owner): resources that one service alone writes (AGG7)."""
    return access.where("writes").groupBy("res").agg(F.countDistinct("svc").alias("n"), F.min("svc").alias("owner")).where("n = 1").select("res", "owner")


def ownership(g: Graph, access: DataFrame) -> DataFrame:
    """(res, owner, rule, confidence) of resources without a declared owner: the
    first rule that holds of terraform path, naming, exclusive writer (ANA2)."""
    rules = [("terraform_path", 0.9, terraform_owners(g)), ("naming", 0.7, naming_owners(g)), ("exclusive_writer", 0.6, exclusive_writers(access))]
    found = None
    for rank, (rule, sure, owners) in enumerate(rules):
        part = owners.select("res", "owner", F.lit(rule).alias("rule"), F.lit(sure).alias("confidence"), F.lit(rank).alias("rank"))
        found = part if found is None else found.union(part)
    touched = access.select("res").distinct()
    open_ = touched.join(declared_owners(g), "res", "left_anti")
    return first_by(found.join(open_, "res", "left_semi"), ["res"], "rank").select("res", "owner", "rule", "confidence")


def all_owners(g: Graph, access: DataFrame) -> DataFrame:
    return declared_owners(g).union(ownership(g, access).select("res", "owner"))


def shared_pairs(access: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(svc_a, svc_b, res, risk) for each resource that two services share.

    One row per service and resource goes in; resources with one accessor drop
    out first. The k accessors of a hub are dealt into blocks that meet two at a
    time under a key of their own, so a hub spreads over many tasks."""
    per = access.select("svc", "res", "writes")
    shared = per.groupBy("res").agg(F.count("*").alias("k")).where("k > 1")
    dealt = per.join(shared, "res").withColumn("blocks", F.ceil(F.col("k") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("svc"), F.col("blocks")).cast("int"))
    lanes = F.sequence(F.lit(0), F.col("blocks") - 1)
    sides = dealt.withColumn("other", F.explode(lanes)).select("svc", "res", "writes", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a = sides.select("res", "lo", "hi", F.col("svc").alias("svc_a"), F.col("writes").alias("wa"), F.col("own").alias("own_a"))
    b = sides.select("res", "lo", "hi", F.col("svc").alias("svc_b"), F.col("writes").alias("wb"), F.col("own").alias("own_b"))
    # within two different blocks only pairs across them, as pairs inside one meet in its own lane
    met = a.join(b, ["res", "lo", "hi"]).where("svc_a < svc_b and (lo = hi or own_a <> own_b)")
    return met.select("svc_a", "svc_b", "res", S.risk(F.col("wa"), F.col("wb")).alias("risk"))


def _listed(pairs: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items): what each pair shares, the riskiest and least resource first."""
    item = F.struct((-S.risk_rank("risk")).alias("r"), "res", F.coalesce("res_name", F.lit("unknown")).alias("res_name"))
    return pairs.join(names, "res", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _told(items: DataFrame, *keys: str) -> DataFrame:
    risk = S.lookup((-F.col("items")[0]["r"]).cast("int"), {3: "High", 2: "Medium", 1: "Low"})
    out = items.withColumn("risk", risk).withColumn("resources", F.array_sort(F.transform("items", lambda x: x["res"])))
    return out.select(*keys, "risk", "resources", S.coupling_reason("risk", F.col("items")[0]["res_name"]).alias("reason"))


class Coupled(NamedTuple):
    """Couplings not yet written out: pairs that share a rarer resource, and
    classes of services that touch the same hubs alike."""

    found: DataFrame  #: (svc_a, svc_b, risk, resources, reason, x, bx, y, by, wide): all that such a pair shares; wide if its classes are in ``told``
    told: DataFrame  #: (pid_a, pid_b, risk, resources, reason): what any two members of two classes share, at least
    members: DataFrame  #: (svc, pid, block)
    classes: DataFrame  #: (pid, blocks, n); pid is the least member


def coupled(g: Graph, access: DataFrame) -> Coupled:
    """What two classes share is worked out once for all their members, and merged
    with what pairs of them share of rarer resources. As large as the input and
    the pairs of classes, not the pairs of members."""
    names = g.nodes.select(F.col("id").alias("res"), F.col("display_name").alias("res_name"))
    per = access.select("svc", "res", "writes")
    counted = settle(per.join(per.groupBy("res").agg(F.count("*").alias("k")), "res").where("k > 1"))
    profile = counted.where(F.col("k") > HUB).groupBy("svc").agg(F.array_sort(F.collect_list(F.struct("res", "writes"))).alias("profile"))
    classes = profile.groupBy("profile").agg(F.min("svc").alias("pid"), F.ceil(F.count("*") / CLASS_BLOCK).alias("blocks"), F.count("*").alias("n"))
    classes = settle(classes)
    members = settle(profile.join(classes, "profile").select("svc", "pid", F.pmod(F.xxhash64("svc"), "blocks").alias("block")))
    touched = classes.select(F.col("pid").alias("svc"), "n", F.explode("profile").alias("p")).select("svc", "n", "p.res", "p.writes")
    within = touched.where("n > 1").select(F.col("svc").alias("svc_a"), F.col("svc").alias("svc_b"), "res", S.risk(F.col("writes"), F.col("writes")).alias("risk"))
    both = settle(_listed(shared_pairs(touched).union(within), names, ["svc_a", "svc_b"]).toDF("pid_a", "pid_b", "items"))
    # pairs that share a rarer resource
    direct = _listed(shared_pairs(counted.where(F.col("k") <= HUB)), names, ["svc_a", "svc_b"])
    direct = direct.join(members.toDF("svc_a", "x", "bx"), "svc_a", "left").join(members.toDF("svc_b", "y", "by"), "svc_b", "left")
    direct = direct.join(both.withColumnRenamed("items", "more"), (F.least("x", "y") == F.col("pid_a")) & (F.greatest("x", "y") == F.col("pid_b")) & F.col("x").isNotNull() & F.col("y").isNotNull(), "left")
    merged = F.when(F.col("more").isNull(), F.col("items")).otherwise(F.array_sort(F.concat("items", "more")))
    at = ("svc_a", "svc_b", "x", "bx", "y", "by", "wide")
    found = _told(direct.select(*at[:-1], F.col("more").isNotNull().alias("wide"), merged.alias("items")), *at)
    told = settle(_told(both, "pid_a", "pid_b"))
    return Coupled(settle(found), told, members, classes.select("pid", "blocks", "n"))


_PAIR = ("svc_a", "svc_b", "risk", "resources", "reason")


def couplings(g: Graph, access: DataFrame) -> DataFrame:
    """(svc_a, svc_b, risk, resources, reason): pairs with a < b; risk is the
    greatest over shared resources, the reason that of the least such resource (D2).

    Pairs of members of two classes are written last: a block of one class meets a
    block of the other as one row with two lists, dealt to tasks of some
    ``TASK_PAIRS`` pairs each, so the pairs themselves are never shuffled. Pairs
    that share a rarer resource too are left out there, by the block."""
    c = coupled(g, access)
    classes = c.classes
    told = c.told.join(classes.toDF("pid_a", "blocks_a", "na"), "pid_a").join(classes.toDF("pid_b", "blocks_b", "nb"), "pid_b")
    pairs = told.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    lanes = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = told.withColumn("block_a", lanes("blocks_a")).withColumn("block_b", lanes("blocks_b")).where("pid_a <> pid_b or block_a <= block_b")
    lists = settle(c.members.groupBy("pid", "block").agg(F.collect_list("svc").alias("svcs")))
    place = ["pid_a", "block_a", "pid_b", "block_b"]
    turned = (F.col("x") > F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("bx") > F.col("by")))
    side = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    known = c.found.where("wide").select(side("x", "y").alias("pid_a"), side("bx", "by").alias("block_a"), side("y", "x").alias("pid_b"), side("by", "bx").alias("block_b"), F.struct(side("svc_a", "svc_b").alias("one"), side("svc_b", "svc_a").alias("two")).alias("pair"))
    cells = dealt.join(lists.toDF("pid_a", "block_a", "ones"), ["pid_a", "block_a"]).join(lists.toDF("pid_b", "block_b", "twos"), ["pid_b", "block_b"])
    cells = cells.join(known.groupBy(*place).agg(F.collect_list("pair").alias("known")), place, "left").repartition(min(TASKS, pairs // TASK_PAIRS + 1), *place)
    wide = cells.withColumn("one", F.explode("ones"))
    met = F.array_compact(F.transform("known", lambda p: F.when(p["one"] == F.col("one"), p["two"])))
    rest = F.when(F.col("known").isNull(), F.col("twos")).otherwise(F.array_except("twos", met))
    wide = wide.select("pid_a", "block_a", "pid_b", "block_b", "risk", "resources", "reason", "one", F.explode(rest).alias("two"))
    wide = wide.where("pid_a <> pid_b or block_a < block_b or one < two")
    return c.found.select(*_PAIR).union(wide.select(F.least("one", "two").alias("svc_a"), F.greatest("one", "two").alias("svc_b"), "risk", "resources", "reason"))


def riskiest(g: Graph, access: DataFrame, k: int) -> DataFrame:
    """``high_risk`` of all couplings without writing them out.

    Class pairs are ranked by what they share and their least pair of members: k of
    them have k pairs at least as good as any of the rest. Of such a class pair, k
    pairs can be made of the k + 1 least members of each side, and no other is as
    good. Where one of these shares a rarer resource too, its row in ``found`` is
    the better; only the k best of these matter, so only they are left out."""
    c = coupled(g, access)
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("svc"))
    few = c.members.withColumn("at", nth("pid", "block")).where(F.col("at") <= k + 1)
    few = settle(few.withColumn("at", nth("pid")).where(F.col("at") <= k + 1))
    second = few.where("at = 2").select(F.col("pid").alias("pid_a"), F.col("svc").alias("second"))
    least = F.when(F.col("pid_a") == F.col("pid_b"), F.col("second")).otherwise(F.col("pid_b"))
    top = c.told.join(second, "pid_a", "left").orderBy(F.desc(S.risk_rank("risk")), F.desc(F.size("resources")), "pid_a", least).limit(k)
    wide = top.join(few.select(F.col("svc").alias("one"), F.col("pid").alias("pid_a")), "pid_a").join(few.select(F.col("svc").alias("two"), F.col("pid").alias("pid_b")), "pid_b").where("pid_a <> pid_b or one < two")
    wide = wide.select(F.least("one", "two").alias("svc_a"), F.greatest("one", "two").alias("svc_b"), "risk", "resources", "reason")
    found = settle(high_risk(c.found.select(*_PAIR), k))
    return high_risk(found.union(wide.join(found.select("svc_a", "svc_b"), ["svc_a", "svc_b"], "left_anti").select(*_PAIR)), k)


def shared_access(access: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst, edge_type, evidence) of accessors that are not the owner (ANA4)."""
    other = access.join(owners, "res").where("svc <> owner")
    read = other.where("reads").select(F.col("svc").alias("src"), F.col("res").alias("dst"), F.lit("READS_SHARED").alias("edge_type"), "evidence")
    write = other.where("writes").select(F.col("svc").alias("src"), F.col("res").alias("dst"), F.lit("WRITES_SHARED").alias("edge_type"), "evidence")
    return read.union(write)


def checked(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rejects carry ``why``: a missing end or a type that does not fit (UPS15, D3)."""
    kind = nodes.select("id", "node_type")
    typed = edges.join(kind.toDF("src", "src_type"), "src", "left").join(kind.toDF("dst", "dst_type"), "dst", "left")
    fits_src = S.lookup("edge_type", {t: ",".join(r[0]) for t, r in EDGE_RULES.items()})
    fits_dst = S.lookup("edge_type", {t: ",".join(r[1]) for t, r in EDGE_RULES.items()})
    why = (
        F.when(F.col("src_type").isNull(), "missing source")
        .when(F.col("dst_type").isNull(), "missing target")
        .when(fits_src.isNull(), "unknown edge type")
        .when(~F.array_contains(F.split(fits_src, ","), F.col("src_type")), "source type")
        .when(~F.array_contains(F.split(fits_dst, ","), F.col("dst_type")), "target type")
    )
    judged = typed.withColumn("why", why)
    names = edges.columns
    return judged.where("why is null").select(*names), judged.where("why is not null").select(*names, "why")


_COUPLED = "IMPLICITLY_COUPLED"


def _owned_and_shared(g: Graph, access: DataFrame) -> DataFrame:
    """OWNS edges where none is declared, and shared access."""
    owners = settle(ownership(g, access))
    nothing = F.array().cast("array<string>")
    own = owners.select(F.col("owner").alias("src"), F.col("res").alias("dst"), F.lit("OWNS").alias("edge_type"), "confidence", F.concat(F.lit("inferred by "), F.col("rule")).alias("reason"), nothing.alias("evidence"))
    everyone = declared_owners(g).union(owners.select("res", "owner"))
    shared = shared_access(access, everyone).select("src", "dst", "edge_type", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason"), "evidence")
    return own.union(shared)


def _coupling_edges(g: Graph, access: DataFrame) -> DataFrame:
    return couplings(g, access).select(F.col("svc_a").alias("src"), F.col("svc_b").alias("dst"), F.lit(_COUPLED).alias("edge_type"), S.confidence("risk").alias("confidence"), "reason", F.col("resources").alias("evidence"))


def inferred_edges(g: Graph) -> DataFrame:
    """All edges that the analysis adds, before checking: OWNS where none is
    declared, shared access, couplings (ANA5)."""
    access = settle(access_map(g))
    return _owned_and_shared(g, access).union(_coupling_edges(g, access))


def apply(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph with inferred edges, and the rejects; existing edges of the
    same key are replaced by the newer, with evidence of both (UPS13, D13).

    Couplings join services of the graph, so they pass every check, and each pair
    is there once: unless the graph has some already, they are added as they come."""
    access = settle(access_map(g))
    good, rejects = checked(_owned_and_shared(g, access), g.nodes)
    last = F.lit(1 << 62).cast("bigint")
    whole = lambda df: df.select(
        last.alias("ordinal"), "src", "dst", "edge_type", "confidence", "reason", "evidence",
        F.lit(None).cast("string").alias("http_method"), F.lit(None).cast("string").alias("endpoint_path"), F.lit(None).cast("timestamp").alias("discovered_at"), F.lit(False).alias("confirmed"),
    )
    added, pairs = whole(good), whole(_coupling_edges(g, access))
    if g.edges.where(F.col("edge_type") == _COUPLED).take(1):
        return Graph(g.nodes, upsert_edges(g.edges.unionByName(added).unionByName(pairs)), g.meta), rejects
    return Graph(g.nodes, upsert_edges(g.edges.unionByName(added)).unionByName(pairs), g.meta), rejects


def counts_after_apply(g: Graph) -> DataFrame:
    """(edge_type, n) of the edges that ``apply`` leaves, without writing the pairs
    of class members: these are counted by the sizes of their classes."""
    access = settle(access_map(g))
    good, _ = checked(_owned_and_shared(g, access), g.nodes)
    key = ["src", "dst", "edge_type"]
    rest = g.edges.where(~F.col("edge_type").eqNullSafe(F.lit(_COUPLED))).select(*key).union(good.select(*key)).distinct()
    c = coupled(g, access)
    n = c.classes.select("pid", "n")
    told = c.told.join(n.toDF("pid_a", "na"), "pid_a").join(n.toDF("pid_b", "nb"), "pid_b")
    wide = told.select(F.when(F.col("pid_a") == F.col("pid_b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb")).alias("n"))
    rare = c.found.select(F.when(F.col("wide"), 0).otherwise(1).cast("bigint").alias("n"))
    # edges of the kind that are there already and that the analysis does not find
    old = g.edges.where(F.col("edge_type") == _COUPLED).select("src", "dst").distinct()
    pid = c.members.select("svc", "pid")
    old = old.join(c.found.select(F.col("svc_a").alias("src"), F.col("svc_b").alias("dst")), ["src", "dst"], "left_anti")
    old = old.join(pid.toDF("src", "x"), "src", "left").join(pid.toDF("dst", "y"), "dst", "left")
    old = old.join(c.told.select("pid_a", "pid_b", F.lit(True).alias("met")), (F.least("x", "y") == F.col("pid_a")) & (F.greatest("x", "y") == F.col("pid_b")) & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("src") < F.col("dst")), "left")
    kept = old.where("met is null").select(F.lit(1).cast("bigint").alias("n"))
    pairs = wide.union(rare).union(kept).agg(F.sum("n").alias("n")).where("n > 0")
    return rest.groupBy("edge_type").agg(F.count("*").alias("n")).union(pairs.select(F.lit(_COUPLED), "n"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, edge_type): the last in order, evidence of all."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "edge_type", "evidence", "ordinal")]
    items = F.array_sort(F.collect_list(F.struct("ordinal", "evidence")))
    out = edges.groupBy("src", "dst", "edge_type").agg(
        F.min("ordinal").alias("ordinal"),
        F.max_by(F.struct(*rest), "ordinal").alias("last"),
        F.array_distinct(F.flatten(F.transform(items, lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>"))))).alias("evidence"),
    )
    return out.select("ordinal", "src", "dst", "edge_type", *[F.col(f"last.{c}").alias(c) for c in rest], "evidence").select(*edges.columns)


def high_risk(found: DataFrame, k: int) -> DataFrame:
    """The k riskiest pairs: risk, then number of resources, then ids."""
    return found.orderBy(F.desc(S.risk_rank("risk")), F.desc(F.size("resources")), "svc_a", "svc_b").limit(k)


