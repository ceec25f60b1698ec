"""Array-shaped views of the shared tables, and the same ones in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_idx, voxel_id, value, label: embeddings as times x voxels."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t_idx"), F.posexplode("embedding").alias("voxel_id", "v"), "label").select("t_idx", F.col("voxel_id").cast("long").alias("voxel_id"), F.col("v").cast("double").alias("value"), "label")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxel_id (user), t_idx (day), value: mean of each user's events of a day."""
    e = table(spark, sf_dir, "events")
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    return e.groupBy(F.col("user_id").alias("voxel_id"), day.alias("t_idx")).agg(F.avg("value").alias("value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_idx (ship day from 0), voxel_id (line status), value {re, im}: sums of price and quantity as a complex signal."""
    li = table(spark, sf_dir, "lineitem")
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400)
    d = li.select(day.alias("d"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("long").alias("voxel_id"), "l_quantity", "l_discount")
    least = d.agg(F.min("d").alias("d0"))
    s = d.crossJoin(F.broadcast(least)).groupBy((F.col("d") - F.col("d0")).cast("int").alias("t_idx"), "voxel_id").agg(F.sum("l_quantity").alias("re"), F.sum("l_discount").alias("im"))
    return s.select("t_idx", "voxel_id", F.struct("re", "im").alias("value"))


def bands(spark: SparkSession) -> DataFrame:
    """voxel_id, region: overlapping bands of 16 voxels, 8 apart; voxels from 56 on are background (0)."""
    v = spark.range(64).withColumnRenamed("id", "voxel_id")
    first, second = F.floor(F.col("voxel_id") / 16) + 1, F.floor((F.col("voxel_id") - 8) / 16) + 11
    both = v.select("voxel_id", first.alias("region")).union(v.filter("voxel_id >= 8").select("voxel_id", second.alias("region")))
    return both.select("voxel_id", F.when(F.col("voxel_id") >= 56, 0).otherwise(F.col("region")).cast("int").alias("region"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, acronym, name: a root, the regions (1000 + key) and the nations (2000 + key)."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = spark.range(1).select(F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("acronym"), F.lit("root").alias("name"))
    rs = r.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.upper(F.substring("r_name", 1, 3)).alias("acronym"), F.col("r_name").alias("name"))
    ns = n.select((F.col("n_nationkey") + 2000).cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.upper(F.substring("n_name", 1, 3)).alias("acronym"), F.col("n_name").alias("name"))
    return root.union(rs).union(ns)


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxel_id, p: shares of suppliers' and customers' balances in their range, as p-values."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("voxel_id"), F.col("c_acctbal").alias("b"))
    ends = c.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    x = (F.col("b") - F.col("lo") + 1) / (F.col("hi") - F.col("lo") + 2)
    return c.crossJoin(F.broadcast(ends)).select("voxel_id", (x * x * x).alias("p"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z_idx, y_idx, x_idx, z: parts on a plane, their price as a score."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit(0).alias("z_idx"), F.floor(F.col("p_partkey") / 20).cast("int").alias("y_idx"), (F.col("p_partkey") % 20).cast("int").alias("x_idx"), F.round((F.col("p_size") - 25) / 5.0, 3).alias("z"))


E = "E AS (SELECT vec_id AS t_idx, unnest(range(64)) AS voxel_id, unnest(embedding)::DOUBLE AS value, label FROM embeddings)"
R = "R AS (SELECT user_id AS voxel_id, floor(epoch(ts) / 86400)::BIGINT AS t_idx, avg(value) AS value FROM events GROUP BY ALL)"
V = """V AS (SELECT (d - min(d) OVER ())::INT AS t_idx, voxel_id, re, im FROM (
  SELECT floor(epoch(l_shipdate) / 86400)::BIGINT AS d, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS voxel_id,
    sum(l_quantity) AS re, sum(l_discount) AS im FROM lineitem GROUP BY ALL))"""
B = """B AS (SELECT voxel_id, CASE WHEN voxel_id >= 56 THEN 0 ELSE region END AS region FROM (
  SELECT v AS voxel_id, v // 16 + 1 AS region FROM range(64) t(v) UNION ALL
  SELECT v, (v - 8) // 16 + 11 FROM range(8, 64) t(v)))"""
H = """H AS (SELECT 1::BIGINT AS id, NULL::BIGINT AS parent_id, 'root' AS acronym, 'root' AS name UNION ALL
  SELECT r_regionkey + 1000, 1, upper(substr(r_name, 1, 3)), r_name FROM region UNION ALL
  SELECT n_nationkey + 2000, n_regionkey + 1000, upper(substr(n_name, 1, 3)), n_name FROM nation)"""
P = """P AS (SELECT voxel_id, x * x * x AS p FROM (SELECT c_custkey AS voxel_id,
  (c_acctbal - min(c_acctbal) OVER () + 1) / (max(c_acctbal) OVER () - min(c_acctbal) OVER () + 2) AS x FROM customer))"""
G = """G AS (SELECT 0 AS z_idx, (p_partkey // 20)::INT AS y_idx, (p_partkey % 20)::INT AS x_idx, round((p_size - 25) / 5.0, 3) AS z
  FROM part)"""
