"""Ties and empty answers as the SQL has them; steps that stay bounded on large tables."""

import random

import pyarrow as pa
import pytest

from terrane.functions import parsers
from terrane.operators import coupling, query, traverse
from terrane.plans import catalogue
from terrane.schema import Graph

from .graphs import A, B, C, abc, graph


def test_path_ties_are_settled_by_the_joined_ids(spark):
    a, a1 = "service:ns:a", "service:ns:a1"
    g = graph(spark, [(x, x) for x in (A, a, a1, C)], [(A, a, "CALLS"), (A, a1, "CALLS"), (a, C, "CALLS"), (a1, C, "CALLS")])
    assert traverse.find_path(g, A, C).first()["path"] == [A, a1, C]  # as "a1" is less than "a>"


def test_no_path_without_a_goal(spark):
    start = catalogue.START
    lone = graph(spark, [(start, "one"), (B, "b")], [(B, start, "CALLS")])
    calls, goal = catalogue._goals(lone)
    assert goal is None and traverse.find_path(calls, start, goal).count() == 0
    met = graph(spark, [(start, "one"), (B, "b")], [(start, B, "CALLS"), (B, start, "CALLS")])
    assert traverse.find_path(*catalogue._path_args(met)).first()["path"] == [start, B]
    assert traverse.find_path(Graph(abc(spark).nodes, abc(spark).edges), A, None).count() == 0


@pytest.mark.parametrize("path,line", [("app.py", "client.get_item(TableName='t%d')"), ("a.js", "client.send(new GetItemCommand({ TableName: 't%d' }))")])
def test_discoveries_go_back_in_bounded_batches(path, line):
    text = "\n".join(line % k for k in range(3000))
    files = pa.RecordBatch.from_pydict({"repo_index": [1, 2, 3, 4], "repo": ["a", "b", "c", None], "path": [path] * 3 + [None], "content": [text, text, text, None]})
    arrow = pa.schema([("repo", pa.string()), ("name", pa.string()), ("source_line", pa.int32()), ("__repo_index", pa.int64()), ("__position", pa.int32())])
    sizes, rows = [], []
    for b in parsers._found(iter([files, files]), ("python", "javascript"), arrow):
        sizes.append(b.num_rows)
        rows += b.to_pylist()
    assert len(rows) == 18000 and max(sizes) <= parsers.FOUND_ROWS
    assert {(r["repo"], r["name"], r["source_line"], r["__position"]) for r in rows} == {(x, f"t{k}", k + 1, k) for x in "abc" for k in range(3000)}


def _hubs(spark, seed):
    """Services that share hubs and rarer resources, and their couplings by brute force."""
    r = random.Random(seed)
    svc, res = [f"service:ns:s{k}" for k in range(26)], [f"database:ns:r{k}" for k in range(12)]
    touches = {(s, x, r.choice(["READS", "WRITES"]) if k > 1 else "READS") for k, x in enumerate(res) for s in svc if r.random() < (0.8 if k < 3 else 0.12)}
    touches = {(s, x, t) for s, x, t in touches if s != svc[-1]}
    pairs = {}
    for s, x, t in touches:
        for s2, x2, t2 in touches:
            if x == x2 and s < s2:
                pairs.setdefault((s, s2), []).append((1 + (t == "WRITES") + (t2 == "WRITES"), x))
    want = [(*p, {3: "High", 2: "Medium", 1: "Low"}[max(v)[0]], sorted(x for _, x in v)) for p, v in pairs.items()]
    return graph(spark, [(x, x) for x in svc + res], sorted(touches)), sorted(want, key=lambda w: (-max(pairs[w[:2]])[0], -len(w[3]), w[:2]))


@pytest.mark.parametrize("seed", [1, 2])
def test_couplings_and_the_riskiest_of_them(spark, monkeypatch, seed):
    monkeypatch.setattr(coupling, "HUB", 8)
    monkeypatch.setattr(coupling, "CLASS_BLOCK", 2)
    monkeypatch.setattr(coupling, "TASK_PAIRS", 20)
    g, want = _hubs(spark, seed)
    access = coupling.access_map(g)
    rows = lambda df: [(r["svc_a"], r["svc_b"], r["risk"], r["resources"]) for r in df.collect()]
    assert sorted(rows(coupling.couplings(g, access))) == sorted(want)
    monkeypatch.setattr(coupling, "couplings", None)  # the riskiest are found without writing all
    for k in (1, 7, 60, 1000):
        assert rows(coupling.riskiest(g, access, k)) == want[:k]


def test_counts_after_apply_are_those_of_the_applied_graph(spark, monkeypatch):
    monkeypatch.setattr(coupling, "HUB", 8)
    g, want = _hubs(spark, 3)
    there = [(want[0][0], want[0][1]), (want[-1][0], want[-1][1]), (want[0][1], want[0][0]), (want[0][0], "service:ns:s25")]
    old = graph(spark, [], [(a, b, "IMPLICITLY_COUPLED") for a, b in there * 2]).edges
    counts = lambda df: {r[0]: r[1] for r in df.collect()}
    for edges, more in ((g.edges, 0), (g.edges.union(old), 2)):
        applied, rejects = coupling.apply(Graph(g.nodes, edges))
        all_ = counts(query.edge_counts_by_type(applied))
        assert rejects.count() == 0 and all_["IMPLICITLY_COUPLED"] == len(want) + more
        with monkeypatch.context() as m:
            m.setattr(coupling, "couplings", None)  # no pairs are written
            assert counts(coupling.counts_after_apply(Graph(g.nodes, edges))) == all_


def test_naming_looks_at_each_distinct_name_once(spark):
    names = ["orders-db", "orders", "db", "odd", "", None]
    services = [(f"service:ns:s{k}", x) for k, x in enumerate(["rders", "db", "db", "o", "zzz", "", None, "rders"])]
    resources = [(f"database:ns:r{k}", names[k % 6]) for k in range(24)]
    g = graph(spark, services + resources, [])
    found = coupling.naming_owners(g)
    first = lambda text: next((i for i, n in services if n and text and n in text), None)
    assert {r["res"]: r["owner"] for r in found.collect()} == {i: o for i, n in resources if (o := first(n))}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "Generate explode" in line)
    assert any("Aggregate [text" in line for line in plan[at + 1 : at + 4]), plan
