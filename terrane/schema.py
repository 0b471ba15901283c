"""Schemas, enumerations and rule tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

NODE_TYPES = ("service", "api", "database", "queue", "cloud_resource")
SOURCES = ("javascript_parser", "python_parser", "terraform_parser", "cloudformation_parser", "manual", "interview")

BUSINESS_CONTEXT = "struct<purpose:string,owner:string,history:string,gotchas:array<string>,notes:map<string,string>>"
NODES = f"ordinal bigint, id string, node_type string, namespace string, name string, display_name string, attributes map<string,variant>, business_context {BUSINESS_CONTEXT}, created_at timestamp, updated_at timestamp, source string, commit_sha string, source_file string, source_line int"
EDGES = "ordinal bigint, src string, dst string, edge_type string, confidence double, reason string, evidence array<string>, http_method string, endpoint_path string, discovered_at timestamp, confirmed boolean"
DEPLOYMENT = "struct<deployment_method:string,terraform_workspace:string,environment:string,stack_name:string,tags:map<string,string>>"
DISCOVERIES = f"ordinal bigint, repo string, kind string, name string, sub_type string, operation string, detection_method string, module string, is_relative boolean, imported_items array<string>, target string, method string, language string, framework string, entry_point string, source_file string, source_line int, deployment {DEPLOYMENT}"

_ANY = NODE_TYPES
_DATA = ("database",)
#: edge type -> (allowed source types, allowed target types, relevance decay, markdown label, diagram label)
EDGE_RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...], float, str, str]] = {
    "CALLS": (("service",), ("service", "api"), 0.8, "Calls", "CALLS"),
    "OWNS": (("service",), ("api", "database", "queue"), 0.9, "Owns", "OWNS"),
    "READS": (("service",), _DATA, 0.75, "Reads", "READS"),
    "WRITES": (("service",), _DATA, 0.75, "Writes", "WRITES"),
    "PUBLISHES": (("service",), ("queue",), 0.65, "Publishes", "PUBLISHES"),
    "SUBSCRIBES": (("service",), ("queue",), 0.65, "Subscribes", "SUBSCRIBES"),
    "USES": (("service",), ("cloud_resource",), 0.6, "Uses", "USES"),
    "READS_SHARED": (("service",), ("database", "queue"), 0.7, "Reads (shared)", "READS_SHARED"),
    "WRITES_SHARED": (("service",), ("database", "queue"), 0.7, "Writes (shared)", "WRITES_SHARED"),
    "IMPLICITLY_COUPLED": (("service",), ("service",), 0.5, "Implicitly Coupled", "COUPLED"),
}
EDGE_TYPES = tuple(EDGE_RULES)
#: An incoming edge carries this share of what an outgoing one would.
INCOMING = 0.7
READ_TYPES = ("READS", "READS_SHARED", "SUBSCRIBES", "USES")
WRITE_TYPES = ("WRITES", "WRITES_SHARED", "PUBLISHES")
RISKS = {"High": 0.95, "Medium": 0.8, "Low": 0.6}


@dataclass(frozen=True)
class Graph:
    """A property graph: two frames and a little metadata (API5)."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def edge_rules(spark: SparkSession) -> DataFrame:
    """The rules as a ten-row table: edge_type, sources, targets, decay, labels, directional (SCL16)."""
    rows = [(t, list(s), list(d), w, a, b, t != "IMPLICITLY_COUPLED") for t, (s, d, w, a, b) in EDGE_RULES.items()]
    return spark.createDataFrame(rows, "edge_type string, source_types array<string>, target_types array<string>, decay double, label string, diagram_label string, directional boolean")
