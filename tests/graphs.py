"""Small graphs for tests."""

import json

from pyspark.sql import functions as F

from terrane.schema import EDGES, NODES, Graph


def graph(spark, nodes, edges):
    """nodes: (id, display name[, attributes[, context[, updated_at[, source_file]]]]); edges: (src, dst, type[, evidence])."""
    rows = []
    for k, n in enumerate(nodes):
        n = (*n, *[None] * (6 - len(n)))
        kind, space, name = n[0].split(":", 2)
        rows.append((k, n[0], kind, space, name, n[1], json.dumps(n[2] or {}), json.dumps(n[3]) if n[3] else None, n[4], n[5]))
    df = spark.createDataFrame(rows, "ordinal long, id string, node_type string, namespace string, name string, display_name string, a string, c string, u string, source_file string")
    context = "purpose string, owner string, history string, gotchas array<string>, notes map<string,string>"
    df = df.select("ordinal", "id", "node_type", "namespace", "name", "display_name", F.from_json("a", "map<string,variant>").alias("attributes"), F.from_json("c", context).alias("business_context"), F.lit(None).cast("timestamp").alias("created_at"), F.col("u").cast("timestamp").alias("updated_at"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("commit_sha"), "source_file", F.lit(None).cast("int").alias("source_line"))
    e = [(k, x[0], x[1], x[2], None, None, list(x[3]) if len(x) > 3 else [], None, None, None, False) for k, x in enumerate(edges)]
    assert len(df.columns) == len(spark.createDataFrame([], NODES).columns)
    return Graph(df, spark.createDataFrame(e, EDGES))


A, B, C, DB = "service:ns:svc-a", "service:ns:svc-b", "service:ns:svc-c", "database:ns:users-db"


def abc(spark):
    return graph(spark, [(A, "Service A"), (B, "Service B"), (C, "Service C"), (DB, "Users DB")], [(A, B, "CALLS"), (B, C, "CALLS"), (A, DB, "READS"), (B, DB, "WRITES")])
