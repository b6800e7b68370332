"""Tables Spark derives from the driver's tables, shared by several queries.

Each has a DuckDB twin (CTE text) so oracle queries see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import dashboard as D
from revlens.operators import sessions as S
from revlens.plans.sqlbits import COUNTS_CTE, DASH_CTE, TOP_ISSUES_CTE
from revlens.sources.tables import feedback, read_table

FULL_KEYS = ["session_id", "user_id", "industry", "created_at"]


def dashboards(fb: DataFrame) -> DataFrame:
    return D.dashboard(fb, FULL_KEYS)


def history(dash: DataFrame) -> DataFrame:
    return S.history_from_dashboards(dash)


def sessions_table(dash: DataFrame) -> DataFrame:
    """Session rows: finished, last updated ``total_reviews`` hours after creation."""
    return dash.select("session_id", "user_id", F.lit("complete").alias("status"), "total_reviews",
                       (F.col("created_at").cast("timestamp")
                        + F.make_dt_interval(hours=F.col("total_reviews").cast("int"))).alias("last_updated"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profile per user, from the customer table."""
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("industry"))


def all_derived(spark: SparkSession, sf_dir: str):
    fb = feedback(spark, sf_dir)
    dash = dashboards(fb)
    return fb, dash, history(dash)


# --- DuckDB twins -----------------------------------------------------------
DERIVED_CTES = [COUNTS_CTE, TOP_ISSUES_CTE, DASH_CTE, """sess AS (
  SELECT DISTINCT session_id, user_id, industry, created_at FROM feedback)""", """dashboards AS (
  SELECT s.user_id, s.industry, s.created_at, d.* FROM dashboard d JOIN sess s ON d.session_id = s.session_id)""",
                """history AS (
  SELECT user_id, session_id, CAST(created_at AS TIMESTAMP) AS created_at, total_reviews,
         round_even(overall_score, 1) AS overall_score,
         'Analysis — ' || strftime(CAST(created_at AS TIMESTAMP), '%d %b %Y') AS label
  FROM dashboards)""", """newest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id DESC) AS pos FROM history)""", """series AS (
  SELECT h.user_id, h.session_id, h.created_at, h.total_reviews, h.overall_score, h.label,
         d.positive_pct, d.negative_pct, d.neutral_pct, d.critical_count, d.critical_pct, d.top_category,
         row_number() OVER (PARTITION BY h.user_id ORDER BY h.created_at, h.session_id) AS seq,
         count(*) OVER (PARTITION BY h.user_id) AS n_sessions
  FROM history h JOIN dashboards d ON h.session_id = d.session_id)"""]

CAT_CTE = """cats AS (
  SELECT v.session_id, category, {pct} AS pct FROM (
    SELECT session_id, primary_category AS category, count(*) AS count FROM feedback
    WHERE primary_category IS NOT NULL GROUP BY 1, 2) v
  JOIN (SELECT session_id, count(*) AS total FROM feedback GROUP BY 1) t ON v.session_id = t.session_id)"""
