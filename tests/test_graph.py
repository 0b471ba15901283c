import pytest
from pyspark.sql import functions as F

from terrane.errors import FilterError, GraphError, IdError
from terrane.functions import scalars as S
from terrane.operators import build, budget, coupling, gaps, incremental, instructions, query, repos, traverse
from terrane.plans import render
from terrane.sources import graph_files

from .graphs import A, B, C, DB, abc, graph


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_hops(spark):
    g = abc(spark)
    assert ids(query.traverse(g, A, "out")) == [DB, B]
    assert ids(query.traverse(g, B, "in")) == [A]
    assert len(ids(query.traverse(g, B))) == 3
    assert ids(query.traverse(g, A, "out", ("CALLS",))) == [B]
    assert ids(query.dependents(g, B)) == [A]
    assert ids(query.services_accessing(g, DB)) == [A, B]
    assert query.has_edge_between(g, A, B) and not query.has_edge_between(g, B, A)


def test_paths(spark):
    g = abc(spark)
    assert traverse.find_path(g, A, C).first()["path"] == [A, B, C]
    assert traverse.find_path(g, C, A).count() == 0
    assert traverse.find_path(g, A, A).first()["distance"] == 0
    assert {r["id"]: r["distance"] for r in traverse.within(g, C, 2).collect()} == {C: 0, B: 1, A: 2, DB: 2}
    assert traverse.within(g, "service:ns:none", 2).count() == 0


def test_relevance(spark):
    g = abc(spark)
    seed = g.nodes.where(F.col("id") == A)
    nodes, edges = traverse.extract(g, seed)
    got = {r["id"]: (round(r["score"], 6), r["depth"]) for r in nodes.collect()}
    assert got == {A: (1.0, 0), B: (0.8, 1), DB: (0.75, 1), C: (0.64, 2)}
    assert edges.count() == 4
    assert [r["id"] for r in traverse.ranked(nodes).collect()] == [A, B, DB, C]
    nodes, edges = traverse.extract(g, seed, max_depth=1)
    assert (nodes.count(), edges.count()) == (3, 3)
    assert traverse.extract(g, seed, min_relevance=0.7)[0].count() == 3
    assert ids(traverse.extract(g, seed, edge_types=("CALLS",))[0]) == [A, B, C]
    assert traverse.extract(g, seed.where("false"))[0].count() == 0
    pair = graph(spark, [(A, "a"), (B, "b")], [(A, B, "IMPLICITLY_COUPLED")])
    assert traverse.extract(pair, pair.nodes.where(F.col("id") == A))[0].count() == 2
    assert traverse.extract(pair, pair.nodes.where(F.col("id") == A), include_couplings=False)[0].count() == 1


def test_induced_and_filters(spark):
    g = abc(spark)
    sub = query.induced(g, spark.createDataFrame([(A,), (B,), ("x",)], "id string"))
    assert (sub.nodes.count(), sub.edges.count()) == (2, 1)
    env = graph(spark, [("service:n:api", "prod-api", {"environment": "production", "n": 1}), ("database:n:db", "prod-db", {"environment": "PRODUCTION", "n": 1.5}), ("service:n:st", "staging-api", {"environment": "staging", "n": "1"})], [("service:n:api", "database:n:db", "READS"), ("service:n:st", "database:n:db", "READS")])
    cut = query.filter_environment(env, "Production")
    assert (cut.nodes.count(), cut.edges.count()) == (2, 1)
    with pytest.raises(FilterError):
        query.filter_environment(env, "nowhere")
    assert ids(query.find_by_attribute(env, "n", 1)) == ["service:n:api"]
    assert ids(query.find_by_attribute(env, "n", "1")) == ["service:n:st"]
    assert ids(query.find_by_attribute(env, "n", 1.5)) == ["database:n:db"]
    assert ids(query.find_by_name(env, "PROD-")) == ["database:n:db", "service:n:api"]
    assert ids(query.service_seeds(env, " PROD-api , st")) == ["service:n:api", "service:n:st"]
    with pytest.raises(FilterError):
        query.service_seeds(env, "nobody")


def shared(spark, *modes):
    nodes = [(f"service:ns:s{k}", f"s{k}") for k in range(len(modes))] + [(DB, "table")]
    return graph(spark, nodes, [(f"service:ns:s{k}", DB, m, [f"f{k}.js:1"]) for k, m in enumerate(modes)])


@pytest.mark.parametrize(("modes", "risks"), [(("WRITES", "READS", "READS"), ["Low", "Medium", "Medium"]), (("WRITES", "WRITES"), ["High"]), (("READS", "READS"), ["Low"]), (("READS",), [])])
def test_risk(spark, modes, risks):
    g = shared(spark, *modes)
    for block in (1, 2000):
        pairs = coupling.shared_pairs(coupling.access_map(g), block)
        assert sorted(r["risk"] for r in pairs.collect()) == risks


def test_ownership(spark):
    g = shared(spark, "WRITES", "READS", "READS")
    access = coupling.access_map(g)
    assert [(r["owner"], r["rule"]) for r in coupling.ownership(g, access).collect()] == [("service:ns:s0", "exclusive_writer")]
    assert ids(coupling.shared_access(access, coupling.all_owners(g, access)), "src") == ["service:ns:s1", "service:ns:s2"]
    after, rejects = coupling.apply(g)
    assert {r["edge_type"]: r["n"] for r in query.edge_counts_by_type(after).collect()} == {"WRITES": 1, "READS": 2, "OWNS": 1, "READS_SHARED": 2, "IMPLICITLY_COUPLED": 3}
    assert rejects.count() == 0
    again, _ = coupling.apply(after)
    key = ("src", "dst", "edge_type")
    assert sorted(again.edges.select(*key).collect()) == sorted(after.edges.select(*key).collect())
    named = graph(spark, [("service:n:user", "user"), ("service:n:order", "order"), ("database:n:t", "user-table", None, None, None, None), ("database:n:tf", "x", None, None, None, "repos/order/terraform/main.tf")], [])
    assert {r["res"]: r["owner"] for r in coupling.naming_owners(named).collect()} == {"database:n:t": "service:n:user"}
    assert {r["res"]: r["owner"] for r in coupling.terraform_owners(named).collect()} == {"database:n:tf": "service:n:order"}


def test_checked(spark):
    g = graph(spark, [(A, "a"), ("cloud_resource:n:b", "b")], [(A, "cloud_resource:n:b", "OWNS"), (A, "cloud_resource:n:b", "USES"), (A, "x:y:z", "CALLS"), (A, A, "NOPE")])
    good, bad = coupling.checked(g.edges, g.nodes)
    assert ids(good, "edge_type") == ["USES"]
    assert {r["edge_type"]: r["why"] for r in bad.collect()} == {"OWNS": "target type", "CALLS": "missing target", "NOPE": "unknown edge type"}


def test_gaps(spark):
    full = {"purpose": "p", "owner": "o", "gotchas": ["g"]}
    nodes = [("service:n:hub", "hub"), ("service:n:ok", "ok", None, full), *[(f"service:n:u{k}", f"u{k}", None, full) for k in range(5)], (DB, "shared"), ("queue:n:q", "q")]
    edges = [(f"service:n:u{k}", "service:n:hub", "CALLS") for k in range(5)] + [("service:n:u0", DB, "READS"), ("service:n:u1", DB, "WRITES"), ("service:n:u0", "queue:n:q", "PUBLISHES"), ("service:n:u1", "queue:n:q", "SUBSCRIBES"), ("service:n:u0", "queue:n:q", "OWNS"), ("service:n:u2", "service:n:u3", "IMPLICITLY_COUPLED")]
    found = {r["node_id"]: (round(r["score"], 6), [x["kind"] for x in r["reasons"]]) for r in gaps.gaps(graph(spark, nodes, edges)).collect()}
    assert found["service:n:hub"] == (0.7, ["missing_purpose", "missing_owner", "high_centrality", "complex_without_gotchas"])
    assert "service:n:ok" not in found and "queue:n:q" not in found
    assert found[DB] == (0.25, ["shared_without_owner"])
    assert found["service:n:u2"] == (0.15, ["implicit_coupling"])
    asked = gaps.questions(graph(spark, nodes, edges)).collect()
    assert [q["priority"] for q in asked] == sorted((q["priority"] for q in asked), reverse=True)
    assert asked[0]["node_id"] == "service:n:hub" and asked[0]["kind"] == "missing_purpose"


def test_annotations(spark):
    g = graph(spark, [(A, "a", None, {"purpose": "new", "gotchas": ["x", "y"], "notes": {"k": "mine"}}), (B, "b")], [])
    old = graph(spark, [(A, "a", None, {"purpose": "old", "owner": "o", "gotchas": ["y", "z"], "notes": {"k": "theirs", "m": "n"}}), (B, "b", None, {"owner": "w"})], [])
    got = {r["id"]: r["business_context"] for r in gaps.merge_annotations(g.nodes, old.nodes).collect()}
    assert (got[A]["purpose"], got[A]["owner"], got[A]["gotchas"], got[A]["notes"]) == ("new", "o", ["x", "y", "z"], {"k": "mine", "m": "n"})
    assert got[B]["owner"] == "w"
    session = gaps.Interview([{"node_id": A, "annotation": a, "question": "q", "context": "c"} for a in ("owner", "note", "gotcha", "purpose")], lambda s, p: p.upper())
    assert session.suggest() == "Q\nC"
    for text in ("me", "remember", "beware"):
        session.answer(text)
    session.skip()
    assert session.complete
    c = {r["id"]: r["business_context"] for r in gaps.apply_answers(g.nodes, session.answers(spark)).collect()}
    assert (c[A]["purpose"], c[A]["owner"], c[A]["gotchas"], c[A]["notes"]) == ("new", "me", ["x", "y", "beware"], {"k": "mine", "note_2": "remember"})
    assert c[B] is None


def test_scalars(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    now = at("2024-02-01 00:00:00")
    stale = lambda t: one(spark, S.is_stale(at(t), 7, now))
    assert not stale("2024-01-31 00:00:00") and stale("2024-01-22 00:00:00")
    assert not stale("2024-01-25 00:00:01") and stale("2024-01-24 23:00:00")
    assert not one(spark, S.is_stale(at("2000-01-01"), 0, now))
    for day, text in (("2024-01-31 12:00:00", "today"), ("2024-01-31 00:00:00", "yesterday"), ("2024-01-28", "4 days ago"), ("2024-01-25", "1 week ago"), ("2024-01-11", "3 weeks ago"), ("2024-01-02", "1 month ago"), ("2023-11-01", "3 months ago")):
        assert one(spark, S.staleness(at(day), now)) == text
    assert one(spark, S.escape_label(F.lit('a"[b]{c}<d>'))) == "a'(b)(c)&lt;d&gt;"
    assert one(spark, S.sanitize(F.lit("a:b-c/d.e"))) == "a_b_c_d.e"
    assert one(spark, S.evidence_text(F.array(*[F.lit(x) for x in "abcde"]))) == "`a`, `b`, `c` +2 more"
    assert one(spark, S.risk_from_reason(S.coupling_reason(F.lit("High"), F.lit("t")))) == "Medium"
    assert one(spark, S.id_part(F.lit("service:n:a:b"), 2)) == "a:b"
    assert one(spark, S.valid_segment(F.lit("é" * 129))) is False
    assert S.make_id("service", "n", "a") == "service:n:a"
    with pytest.raises(IdError):
        S.make_id("service", "n", "a:b")
    assert one(spark, S.owner_repo(F.lit("a/b")))["repo"] == "b" and one(spark, S.owner_repo(F.lit("a/b/c"))) is None
    for text, want in (("Must use TLS", "MUST use TLS"), ("always lock", "MUST lock"), ("a key is required", "MUST ensure a key"), ("dont delete", "DO NOT delete"), ("Never retry", "DO NOT retry"), ("do not scan", "DO NOT scan"), ("slow", "DO NOT violate: slow")):
        assert one(spark, instructions.gotcha(F.lit(text))) == want


def test_budget(spark):
    g = graph(spark, [(f"service:n:s{k}", f"service number {k}") for k in range(40)], [(f"service:n:s{k}", f"service:n:s{k + 1}", "CALLS") for k in range(39)])
    scored = g.nodes.select("id", (1 - F.col("ordinal") / 50).alias("score"), F.lit(1).alias("depth"))
    priced = budget.estimated(g, scored)
    rows = sorted(priced.collect(), key=lambda r: (-r["score"], r["depth"], r["id"]))
    for total in (100, 500, 1500, 10_000):
        want, used = [], 0
        for r in rows:
            if used + r["tokens"] + 100 > total:
                break
            used += r["tokens"]
            want.append(r["id"])
        kept = budget.select_nodes(priced, total)
        assert ids(kept) == sorted(want)
        n = budget.select_edges(g.edges, kept, total).count()
        assert n == min(max(0, len(want) - 1), max(0, (total - used - 100) // 30))


def test_instructions(spark):
    a = {"language": "Python", "framework": "flask", "deployment_method": "terraform", "environment": "prod"}
    g = graph(spark, [(A, "a", a, {"gotchas": ["must x"]}), (B, "b", {"deployment_method": "sam"}, {"purpose": "pays"}), (DB, "db"), ("queue:n:q", "q")], [(A, B, "CALLS"), (A, DB, "READS"), (A, DB, "WRITES"), (A, "queue:n:q", "PUBLISHES")])
    got = {r["id"]: r["instructions"] for r in instructions.instructions(g).collect()}
    assert got[A]["code_style"].startswith("Flask") and "-var-file=prod.tfvars" in got[A]["deployment"] and got[A]["gotchas"] == ["MUST x"]
    assert got[A]["dependencies"].asDict() == {"services": ["b (pays)"], "databases": ["db (read/write access)"], "queues": ["q (publish on events)"]}
    assert got[B]["deployment"] == "sam build && sam deploy --stack-name b-stack" and got[B]["dependencies"] is None


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, hash string")
    assert {r["path"]: r["change"] for r in incremental.snapshot_changes(old, new).collect()} == {"a": "deleted", "b": "modified", "d": "added"}
    lines = spark.createDataFrame([("M\tindex.js",), ("A\tnew.ts",), ("R100\told.py\tnext.py",), ("C75\ta.tf\tb.tf",), ("D\tgone.yaml",), ("M\tREADME.md",)], "value string")
    assert sorted((r["path"], r["change"]) for r in incremental.name_status_changes(lines).collect()) == [("b.tf", "added"), ("gone.yaml", "deleted"), ("index.js", "modified"), ("new.ts", "added"), ("next.py", "added"), ("old.py", "deleted")]
    blanks = spark.createDataFrame([("A\tsrc/a file.py",), ("R100\told one.py\tnew one.py",)], "value string")
    assert sorted((r["path"], r["change"]) for r in incremental.name_status_changes(blanks).collect()) == [("new one.py", "added"), ("old one.py", "deleted"), ("src/a file.py", "added")]
    state = spark.createDataFrame([("r1", "a", True), ("r2", "a", False), ("r3", "a", True)], "repo string, commit_sha string, survey_successful boolean")
    now = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b"), ("r4", "z")], "repo string, commit_sha string")
    assert {r["repo"]: r["why"] for r in incremental.needs_survey(now, state).collect()} == {"r2": "failed", "r3": "changed", "r4": "never surveyed"}


def test_repos(spark):
    names = spark.createDataFrame([("org/api-prod",), ("org/api-staging",), ("x",)], "repo string")
    got = {r["repo"]: (r["environment"], r["aws_account_id"]) for r in repos.environments(names, [("production", ["*-prod"], "1"), ("any", ["org/*"], None)]).collect()}
    assert got == {"org/api-prod": ("production", "1"), "org/api-staging": ("any", None), "x": (None, None)}
    files = spark.createDataFrame([("r", "package.json", '{"devDependencies": {"typescript": "1"}}'), *[("r", f"src/f{k}.py", "") for k in range(2)], ("r", "node_modules/a.tf", ""), ("r", "node_modules/b.tf", ""), ("r", "src/main.py", "")], "repo string, path string, content string")
    assert {(r["language"], r["confidence"]) for r in repos.languages(files).collect()} == {("typescript", 0.95), ("python", 0.7)}
    assert repos.entry_points(files).first()["entry_point"] == "src/main.py"


def test_upserts(spark):
    g = abc(spark)
    with pytest.raises(GraphError):
        build.add_nodes(g, g.nodes.limit(1))
    with pytest.raises(GraphError):
        build.add_edges(g, g.edges.limit(1))
    gone = build.remove_nodes(g, spark.createDataFrame([(B,)], "id string"))
    assert (gone.nodes.count(), gone.edges.count()) == (3, 1)
    new = graph(spark, [(A, "renamed", {"k": "v"}), ("service:ns:d", "D")], [])
    merged = {r["id"]: r for r in build.upsert_nodes(g.nodes, new.nodes).select("id", "display_name", S.attr("k").alias("k")).collect()}
    assert len(merged) == 5 and merged[A]["display_name"] == "Service A" and merged[A]["k"] == "v"


def test_json_round_trip(spark, tmp_path):
    g = graph(spark, [(A, "a", {"n": 1, "s": "x", "l": [1, "b"]}, {"purpose": "p"}), (DB, "db")], [(A, DB, "READS", ["f:1"])])
    graph_files.save(g, str(tmp_path / "g.json"))
    back = graph_files.load(spark, str(tmp_path / "g.json"))
    assert graph_files.to_json(back) == graph_files.to_json(g)
    assert ids(query.find_by_attribute(back, "n", 1)) == [A]
    graph_files.save_parquet(g, str(tmp_path / "p"))
    assert graph_files.to_json(graph_files.load_parquet(spark, str(tmp_path / "p"))) == graph_files.to_json(g)
    with pytest.raises(GraphError):
        graph_files.from_json(spark, '{"nodes": [{"id": "service:a:b"}], "edges": [{"source": "service:a:b", "target": "x", "type": "CALLS"}]}')


def test_renderers(spark):
    g = graph(spark, [(A, "Service A", {"language": "python", "framework": "flask"}, {"purpose": "sells", "gotchas": ["g"]}, "2024-01-01"), (B, "Service B"), (DB, "Users DB", {"db_type": "dynamodb"}), ("queue:n:q", "Q")], [(A, B, "CALLS", ["a.js:1"]), (A, DB, "READS"), (B, DB, "WRITES"), (A, B, "IMPLICITLY_COUPLED"), (A, "queue:n:q", "PUBLISHES")])
    md = render.text(render.markdown(g, 7, F.lit("2024-02-01").cast("timestamp")))
    for part in ("# Ecosystem Knowledge Graph", "## Services", "### Service A", "**Language**: python | **Framework**: flask", "**Purpose**: sells", "| Service B | Calls | `a.js:1` |", "⚠️ **Status**: Stale (1 month ago)", "| Service B | WRITE | - |", "**Publishers**: Service A", "## Implicit Couplings (Risk Summary)", "- `Service B` - shared resource"):
        assert part in md, part
    assert md.index("## Services") < md.index("## Databases") < md.index("## Queues")
    mm = render.text(render.mermaid(g))
    for part in ("flowchart LR", "        service_ns_svc_a[Service A<br/>python/flask]", '[("Users DB<br/>dynamodb")]', "-.->|COUPLED|", "    class database_ns_users_db database", "queue_n_q>Q]"):
        assert part in mm, part
    nodes, edges = traverse.extract(g, g.nodes.where(F.col("id") == A))
    sub = render.text(render.markdown_subgraph(g, nodes, edges))
    assert "### Service A [HIGH] (relevance: 100%)" in sub and "- → Calls Service B" in sub and "*Exists in ecosystem*" not in sub.split("### Service B")[0]
    assert "[>Q]" in render.text(render.mermaid(g, edges, nodes)) and "CALLS" in render.budgeted(g, nodes, edges, 10_000, "mmd")
    import json

    doc = json.loads(render.json_document(g, "now", staleness_days=7, as_of=F.lit("2024-02-01").cast("timestamp")))
    assert doc["summary"] == {"total_nodes": 4, "total_edges": 5, "by_type": {"service": 2, "database": 1, "queue": 1}}
    assert doc["nodes"][0]["staleness"]["is_stale"] and doc["nodes"][0]["attributes"] == {"framework": "flask", "language": "python"}
    assert "# Relevant Context" in render.budgeted(g, nodes, edges, 10_000)
    with pytest.raises(Exception):
        render.format_name("pdf")


def test_long_gotchas_stay_whole(spark):
    from terrane.operators.instructions import gotcha

    text = "must " + "x" * 150_000
    got = spark.createDataFrame([(text,)], "t string").select(gotcha(F.col("t")).alias("g")).first()["g"]
    assert got == "MUST " + "x" * 150_000
