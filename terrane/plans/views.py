"""The driver's tables seen as a graph: suppliers and customers are
services, parts are databases, event types are queues.

All joins are equi-joins on keys; nothing is windowed over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BUSINESS_CONTEXT, Graph

AS_OF = "2024-02-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(**cols):
    keys = F.array(*[F.lit(k) for k in cols])
    return F.map_from_arrays(keys, F.array(*[F.variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant") for c in cols.values()]))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    shipped = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("updated_at"))
    key = F.col("key")
    gotchas = F.when(key % 5 == 0, F.array(F.lit("must rotate keys"), F.lit("avoid full scans"))).otherwise(F.array().cast("array<string>"))
    context = F.struct(F.when(key % 3 != 0, F.concat(F.lit("purpose "), key.cast("string"))).alias("purpose"), F.when(key % 4 != 0, F.concat(F.lit("team-"), (key % 7).cast("string"))).alias("owner"), F.lit(None).cast("string").alias("history"), gotchas.alias("gotchas"), F.create_map().cast("map<string,string>").alias("notes"))
    fixed = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(key % 31 as int), 0, 0, 0)")
    sup = _table(spark, sf_dir, "supplier").join(shipped, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    sup = sup.select(F.col("s_suppkey").alias("key"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name").alias("display_name"), F.lit("python").alias("language"), F.col("r_name").alias("environment"), F.lit(0).alias("block"), "updated_at")
    cus = _table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    cus = cus.select(F.col("c_custkey").alias("key"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("display_name"), F.lower("c_mktsegment").alias("language"), F.col("r_name").alias("environment"), F.lit(1).alias("block"), F.lit(None).cast("timestamp").alias("updated_at"))
    svc = sup.union(cus)
    method = F.element_at(F.array(F.lit("terraform"), F.lit("sam"), F.lit("cloudformation")), (key % 3 + 1).cast("int"))
    framework = F.element_at(F.array(F.lit("fastapi"), F.lit("flask")), (key % 2 + 1).cast("int"))
    services = svc.select(
        (F.col("block") * F.lit(1_000_000_000_000) + key).alias("ordinal"), F.concat(F.lit("service:tpch:"), F.col("name")).alias("id"), F.lit("service").alias("node_type"), F.lit("tpch").alias("namespace"), "name", "display_name",
        _map(language=F.col("language"), environment=F.col("environment"), framework=framework, deployment_method=method).alias("attributes"), context.cast(BUSINESS_CONTEXT).alias("business_context"),
        F.lit(None).cast("timestamp").alias("created_at"), F.coalesce("updated_at", fixed).alias("updated_at"),
    )
    part = _table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    name = F.concat(F.lit("part-"), key.cast("string"))
    databases = part.select(
        (F.lit(2_000_000_000_000) + key).alias("ordinal"), F.concat(F.lit("database:tpch:"), name).alias("id"), F.lit("database").alias("node_type"), F.lit("tpch").alias("namespace"), name.alias("name"), F.col("p_name").alias("display_name"),
        _map(db_type=F.col("p_brand"), type=F.col("p_type"), size=F.col("p_size")).alias("attributes"), F.lit(None).cast(BUSINESS_CONTEXT).alias("business_context"), F.lit(None).cast("timestamp").alias("created_at"), fixed.alias("updated_at"),
    )
    seen = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("updated_at"), F.min("event_id").alias("key"))
    queues = seen.select(
        (F.lit(3_000_000_000_000) + key).alias("ordinal"), F.concat(F.lit("queue:events:"), F.col("event_type")).alias("id"), F.lit("queue").alias("node_type"), F.lit("events").alias("namespace"), F.col("event_type").alias("name"), F.col("event_type").alias("display_name"),
        _map(queue_type=F.lit("stream")).alias("attributes"), F.lit(None).cast(BUSINESS_CONTEXT).alias("business_context"), F.lit(None).cast("timestamp").alias("created_at"), F.col("updated_at").cast("timestamp").alias("updated_at"),
    )
    rest = (F.lit("manual").alias("source"), F.lit(None).cast("string").alias("commit_sha"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("int").alias("source_line"))
    return services.union(databases).union(queues).select("*", *rest)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    svc = lambda kind, c: F.concat(F.lit(f"service:tpch:{kind}-"), F.col(c).cast("string"))
    li = _table(spark, sf_dir, "lineitem").where("l_quantity >= 48")
    access = li.select(svc("supplier", "l_suppkey").alias("src"), F.concat(F.lit("database:tpch:part-"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("l_returnflag") == "R", "WRITES").otherwise("READS").alias("edge_type"), F.concat_ws("-", F.lit("order"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ev"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    orders = _table(spark, sf_dir, "orders")
    nxt = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next_cust"))
    calls = orders.where("o_orderpriority like '1%'").select("o_orderkey", "o_custkey").join(nxt, "o_orderkey").where("o_custkey <> next_cust")
    calls = calls.select(svc("customer", "o_custkey").alias("src"), svc("customer", "next_cust").alias("dst"), F.lit("CALLS").alias("edge_type"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("ev"), (F.lit(1_000_000_000_000) + F.col("o_orderkey")).alias("ordinal"))
    ev = _table(spark, sf_dir, "events")
    queue = ev.select(svc("customer", "user_id").alias("src"), F.concat(F.lit("queue:events:"), F.col("event_type")).alias("dst"), F.when(F.col("event_type").isin("purchase", "signup"), "PUBLISHES").otherwise("SUBSCRIBES").alias("edge_type"), F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("ev"), (F.lit(2_000_000_000_000) + F.col("event_id")).alias("ordinal"))
    raw = access.union(calls).union(queue)
    one = raw.groupBy("src", "dst", "edge_type").agg(F.min("ordinal").alias("ordinal"), F.array(F.min("ev")).alias("evidence"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return one.select("ordinal", "src", "dst", "edge_type", none("double", "confidence"), none("string", "reason"), "evidence", none("string", "http_method"), none("string", "endpoint_path"), none("timestamp", "discovered_at"), F.lit(False).alias("confirmed"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


#: The same projection for DuckDB: nodes n, edges e.
SQL = """
WITH RECURSIVE place AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
svc AS (
  SELECT s_suppkey AS key, 'supplier-' || CAST(s_suppkey AS VARCHAR) AS name, s_name AS display_name, 'python' AS language, r_name AS environment, 0 AS block, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS upd
  FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL
  SELECT c_custkey, 'customer-' || CAST(c_custkey AS VARCHAR), c_name, lower(c_mktsegment), r_name, 1, NULL FROM customer JOIN place ON c_nationkey = n_nationkey),
n AS (
  SELECT block * 1000000000000 + key AS ordinal, 'service:tpch:' || name AS id, 'service' AS node_type, name, display_name, key, language, environment,
    CASE WHEN key % 2 = 0 THEN 'fastapi' ELSE 'flask' END AS framework, CASE key % 3 WHEN 0 THEN 'terraform' WHEN 1 THEN 'sam' ELSE 'cloudformation' END AS method,
    CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS INTEGER) AS size, 4 AS n_attr,
    CASE WHEN key % 3 <> 0 THEN 'purpose ' || CAST(key AS VARCHAR) END AS purpose, CASE WHEN key % 4 <> 0 THEN 'team-' || CAST(key % 7 AS VARCHAR) END AS owner, key % 5 = 0 AS gotchas,
    coalesce(CAST(upd AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(key % 31 AS INTEGER))) AS updated_at FROM svc
  UNION ALL
  SELECT 2000000000000 + p_partkey, 'database:tpch:part-' || CAST(p_partkey AS VARCHAR), 'database', 'part-' || CAST(p_partkey AS VARCHAR), p_name, p_partkey, NULL, NULL, NULL, NULL, p_brand, p_size, 3, NULL, NULL, FALSE, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 31 AS INTEGER)) FROM part
  UNION ALL
  SELECT 3000000000000 + min(event_id), 'queue:events:' || event_type, 'queue', event_type, event_type, min(event_id), NULL, NULL, NULL, NULL, NULL, NULL, 1, NULL, NULL, FALSE, CAST(max(ts) AS TIMESTAMP) FROM events GROUP BY event_type),
raw AS (
  SELECT 'service:tpch:supplier-' || CAST(l_suppkey AS VARCHAR) AS src, 'database:tpch:part-' || CAST(l_partkey AS VARCHAR) AS dst, CASE WHEN l_returnflag = 'R' THEN 'WRITES' ELSE 'READS' END AS edge_type,
    'order-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS ev, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem WHERE l_quantity >= 48
  UNION ALL
  SELECT 'service:tpch:customer-' || CAST(a.o_custkey AS VARCHAR), 'service:tpch:customer-' || CAST(b.o_custkey AS VARCHAR), 'CALLS', 'order-' || CAST(a.o_orderkey AS VARCHAR), 1000000000000 + a.o_orderkey
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority LIKE '1%' AND a.o_custkey <> b.o_custkey
  UNION ALL
  SELECT 'service:tpch:customer-' || CAST(user_id AS VARCHAR), 'queue:events:' || event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'PUBLISHES' ELSE 'SUBSCRIBES' END, 'event-' || CAST(event_id AS VARCHAR), 2000000000000 + event_id FROM events),
e AS (SELECT src, dst, edge_type, min(ordinal) AS ordinal, min(ev) AS ev FROM raw GROUP BY 1, 2, 3)
"""
