"""Readers for the driver's parquet tables and the tables derived from them.

``feedback`` is the classified-results fact table (one row per review) built
from the TPC-H-like tables; its definition is shared with the DuckDB oracle
(``FEEDBACK_SQL``) so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified reviews: one row per lineitem, session = (customer, order year).

    Lines are dealt by session once, which numbers them and serves every later grouping by session.
    """
    l = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_name")
    orders = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("user_id"), F.col("c_mktsegment").alias("industry"),
        F.year("o_orderdate").alias("yr"), "o_orderkey", "o_orderpriority")
    b = l.join(p, l.l_partkey == p.p_partkey).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("yr").cast("string")).alias("session_id"),
        "user_id", "industry", "yr", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_returnflag", "o_orderpriority", "p_type", "p_brand", "p_size", "p_name").repartition("session_id")
    # Sessions hold at most one customer-year of lines, so this window is small.
    w = Window.partitionBy("session_id", "user_id", "yr").orderBy("l_orderkey", "l_linenumber", "l_partkey",
                                                                   "l_suppkey", "l_quantity")
    prio = F.substring("o_orderpriority", 1, 1)
    emo = F.col("l_suppkey") % 8
    return b.select(
        "session_id",
        "user_id",
        "industry",
        F.make_date("yr", F.lit(1), F.lit(1)).alias("created_at"),
        (F.row_number().over(w) - 1).cast("int").alias("review_id"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("l_orderkey").cast("string")).alias("review"),
        F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "neutral")
         .otherwise("positive").alias("sentiment"),
        F.col("p_type").alias("primary_category"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("secondary_category"),
        F.when(prio == "1", "critical").when(prio.isin("2", "3"), "medium").otherwise("low").alias("urgency"),
        F.when(emo == 0, "happy").when(emo == 1, "angry").when(emo == 2, "frustrated")
         .when(emo == 3, "disappointed").when(emo == 4, "confused").when(emo == 5, "satisfied")
         .when(emo == 6, "surprised").otherwise("neutral").alias("emotion"),
        F.col("p_name").alias("core_issue"),
        F.when(F.col("l_quantity") > 30, "high").when(F.col("l_quantity") > 10, "medium")
         .otherwise("low").alias("confidence"),
    )


# The same table for the DuckDB oracle (shared by every oracle query).
FEEDBACK_SQL = """feedback AS (
  WITH b AS (
    SELECT o.o_custkey AS user_id, c.c_mktsegment AS industry, year(o.o_orderdate) AS yr,
           l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_returnflag,
           o.o_orderpriority, p.p_type, p.p_brand, p.p_size, p.p_name
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey)
  SELECT concat(user_id, '-', yr) AS session_id, user_id, industry,
         CAST(concat(yr, '-01-01') AS DATE) AS created_at,
         CAST(row_number() OVER (PARTITION BY user_id, yr ORDER BY l_orderkey, l_linenumber,
              l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS review_id,
         concat(p_name, ' ', lower(p_type), ' ', l_orderkey) AS review,
         CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'neutral' ELSE 'positive' END AS sentiment,
         p_type AS primary_category,
         CASE WHEN p_size % 4 = 0 THEN p_brand END AS secondary_category,
         CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'medium'
              WHEN '3' THEN 'medium' ELSE 'low' END AS urgency,
         CASE l_suppkey % 8 WHEN 0 THEN 'happy' WHEN 1 THEN 'angry' WHEN 2 THEN 'frustrated'
              WHEN 3 THEN 'disappointed' WHEN 4 THEN 'confused' WHEN 5 THEN 'satisfied'
              WHEN 6 THEN 'surprised' ELSE 'neutral' END AS emotion,
         p_name AS core_issue,
         CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS confidence
  FROM b)"""
