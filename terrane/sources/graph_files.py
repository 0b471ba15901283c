"""Graph files: JSON documents and the Parquet layout (SRC1, SRC2, SNK1, SNK2)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..schema import EDGES, NODES, Graph

_NODE = "struct<id:string,type:string,display_name:string,attributes:map<string,variant>,business_context:struct<purpose:string,owner:string,history:string,gotchas:array<string>,notes:map<string,string>>,created_at:timestamp,updated_at:timestamp,source:string,commit_sha:string,source_file:string,source_line:int>"
_EDGE = "struct<source:string,target:string,type:string,confidence:double,reason:string,evidence:array<string>,http_method:string,endpoint_path:string,discovered_at:timestamp,confirmed:boolean>"


def _graph(documents: DataFrame) -> Graph:
    """A graph of one-row ``documents(metadata, nodes, edges)``."""
    n = documents.select(F.posexplode("nodes").alias("ordinal", "n"))
    e = documents.select(F.posexplode("edges").alias("ordinal", "e"))
    part = lambda k: F.element_at(F.split("n.id", ":", 3), k)
    nodes = n.select(F.col("ordinal").cast("bigint"), "n.id", F.col("n.type").alias("node_type"), part(2).alias("namespace"), part(3).alias("name"), "n.display_name", "n.attributes", "n.business_context", "n.created_at", "n.updated_at", "n.source", "n.commit_sha", "n.source_file", "n.source_line")
    edges = e.select(F.col("ordinal").cast("bigint"), F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("edge_type"), "e.confidence", "e.reason", "e.evidence", "e.http_method", "e.endpoint_path", "e.discovered_at", "e.confirmed")
    return Graph(nodes, edges)


def check(g: Graph) -> Graph:
    """Raises on repeated ids or keys and on edges that end nowhere."""
    twice = g.nodes.groupBy("id").count().where("count > 1").take(1)
    if twice:
        raise GraphError(f"node {twice[0]['id']!r} occurs twice")
    key = g.edges.groupBy("src", "dst", "edge_type").count().where("count > 1").take(1)
    if key:
        raise GraphError(f"edge {key[0]['src']} -> {key[0]['dst']} occurs twice")
    ids = g.nodes.select("id")
    for end in ("src", "dst"):
        lost = g.edges.join(ids.toDF(end), end, "left_anti").take(1)
        if lost:
            raise GraphError(f"edge end {lost[0][end]!r} is no node")
    return g


def load(spark: SparkSession, path: str) -> Graph:
    """A graph from one JSON document."""
    return check(_graph(spark.read.schema(f"nodes array<{_NODE}>, edges array<{_EDGE}>").json(path, multiLine=True)))


def from_json(spark: SparkSession, text: str) -> Graph:
    doc = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", f"nodes array<{_NODE}>, edges array<{_EDGE}>").alias("d")).select("d.*")
    return check(_graph(doc))


def to_rows(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(ordinal, json) rows of nodes and of edges, without missing fields."""
    attributes = F.to_variant_object("attributes")
    node = F.struct("id", F.col("node_type").alias("type"), "display_name", attributes.alias("attributes"), "business_context", "created_at", "updated_at", "source", "commit_sha", "source_file", "source_line")
    edge = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"), "confidence", "reason", "evidence", "http_method", "endpoint_path", "discovered_at", "confirmed")
    return g.nodes.select("ordinal", "id", F.to_json(node).alias("json")), g.edges.select("ordinal", F.to_json(edge).alias("json"))


def to_json(g: Graph) -> str:
    """One pretty document, assembled on the driver as a single file is."""
    nodes, edges = to_rows(g)
    pick = lambda df, *order: [json.loads(r["json"]) for r in df.orderBy(*order).collect()]
    return json.dumps({"metadata": {"version": "1.0.0", **g.meta}, "nodes": pick(nodes, "ordinal", "id"), "edges": pick(edges, "ordinal", "json")}, ensure_ascii=False, indent=2)


def save(g: Graph, path: str) -> None:
    temporary = f"{path}.part"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(to_json(g))
    os.replace(temporary, path)


def save_parquet(g: Graph, folder: str) -> None:
    """The native layout: nodes by type and edges by type, so type filters prune."""
    g.nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{folder}/edges")


def load_parquet(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges"))
