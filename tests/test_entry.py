"""The entry imports without a session, and its queries have SQL with the same columns."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).parent.parent


def test_imports_without_a_session():
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 50, done.stderr


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["coupling_pairs", "gap_scores", "extract_subgraph_nodes", "shortest_path_nodes", "budget_edges", "snapshot_changes", "mermaid_export", "build_graph", "ownership_by_path", "build_edges"])
def test_agrees_with_its_sql(spark, duck, name):
    from terrane.plans import catalogue

    got = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())
