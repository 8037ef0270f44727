"""Adapters: star-schema tables as a typed dependency graph, bindings and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, type, status``; retired customers, planned parts and planned orders occur."""
    order_status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "current").otherwise("planned")
    parts = (
        ("region", "r_regionkey", "data", F.lit("confirmed")),
        ("nation", "n_nationkey", "data", F.lit("confirmed")),
        ("supplier", "s_suppkey", "artifact", F.when(F.col("s_acctbal") < 0, "null").otherwise("current")),
        ("customer", "c_custkey", "artifact", F.when(F.col("c_acctbal") < 0, "deprecated").otherwise("current")),
        ("part", "p_partkey", "code", F.when(F.col("p_size") == 1, "planned").otherwise("current")),
        ("orders", "o_orderkey", "claim", order_status),
    )
    return reduce(DataFrame.union, (table(spark, sf_dir, t).select(key(t, k).alias("id"), F.lit(kind).alias("type"), status.alias("status")) for t, k, kind, status in parts))


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'data' AS type, 'confirmed' AS status FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'data', 'confirmed' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'artifact', CASE WHEN s_acctbal < 0 THEN 'null' ELSE 'current' END FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'artifact', CASE WHEN c_acctbal < 0 THEN 'deprecated' ELSE 'current' END FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'code', CASE WHEN p_size = 1 THEN 'planned' ELSE 'current' END FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'claim', CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'current' ELSE 'planned' END FROM orders
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, rel``: foreign keys as relations; ``reads`` points from dependent to input, ``tried_before`` annotates."""
    line = table(spark, sf_dir, "lineitem")
    parts = (
        table(spark, sf_dir, "nation").select(key("region", "n_regionkey"), key("nation", "n_nationkey"), F.lit("produces")),
        table(spark, sf_dir, "customer").select(key("nation", "c_nationkey"), key("customer", "c_custkey"), F.lit("produces")),
        table(spark, sf_dir, "supplier").select(key("nation", "s_nationkey"), key("supplier", "s_suppkey"), F.lit("produces")),
        table(spark, sf_dir, "orders").select(key("customer", "o_custkey"), key("orders", "o_orderkey"), F.lit("supports")),
        line.select(key("orders", "l_orderkey"), key("part", "l_partkey"), F.lit("reads")).distinct(),
        line.select(key("supplier", "l_suppkey"), key("orders", "l_orderkey"), F.lit("tried_before")).distinct(),
    )
    return reduce(DataFrame.union, parts).toDF("src", "dst", "rel")


EDGES_SQL = """edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'produces' AS rel FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'produces' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'produces' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'supports' FROM orders
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'reads' FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'orders:' || l_orderkey, 'tried_before' FROM lineitem
), deps AS (
  SELECT CASE WHEN rel = 'reads' THEN dst ELSE src END AS up, CASE WHEN rel = 'reads' THEN src ELSE dst END AS down, rel
  FROM edges WHERE rel <> 'tried_before'
)"""


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, concept, value``: customers' market segments, parts' brands, and the brand that urgent orders claim."""
    return (
        table(spark, sf_dir, "customer").select(key("customer", "c_custkey").alias("id"), F.lit("market").alias("concept"), F.col("c_mktsegment").alias("value"))
        .union(table(spark, sf_dir, "part").select(key("part", "p_partkey"), F.lit("brand"), "p_brand"))
        .union(table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(key("orders", "o_orderkey"), F.lit("brand"), F.lit("Brand#11")))
    )


BINDINGS_SQL = """bindings AS (
  SELECT 'customer:' || c_custkey AS id, 'market' AS concept, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'brand', 'Brand#11' FROM orders WHERE o_orderpriority = '1-URGENT'
)"""

#: Concept to canonical value.
CANONICAL = {"market": "BUILDING", "brand": "Brand#11"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, run_id, type, at, version, value``: views start a user's run, purchases finish it."""
    kind = F.when(F.col("event_type") == "view", "run.started").when(F.col("event_type") == "purchase", "run.finished").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), kind.alias("type"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("version"), "value")


LEDGER_SQL = """ledger AS (
  SELECT event_id, user_id AS run_id, CASE event_type WHEN 'view' THEN 'run.started' WHEN 'purchase' THEN 'run.finished' ELSE event_type END AS type,
    ts AS "at", CAST(json_extract_string(props, '$.k') AS INT) AS version, value FROM events
)"""
