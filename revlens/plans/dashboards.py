"""Registered dashboard queries (D1-D14) over every session of the feedback table."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import dashboard as D
from revlens.plans.catalog import register
from revlens.plans.sqlbits import COUNTS_CTE, DASH_CTE, OVERALL, TOP_ISSUES_CTE, spct, with_feedback
from revlens.sources.tables import feedback


def _value_sql(column: str, name: str, where: str = "") -> str:
    return with_feedback(f"""v AS (
  SELECT session_id, {column} AS {name}, count(*) AS count, min(review_id) AS first_id
  FROM feedback WHERE {column} IS NOT NULL GROUP BY 1, 2),
t AS (SELECT session_id, count(*) AS total FROM feedback GROUP BY 1),
r AS (
  SELECT v.session_id, {name}, count, {spct('count', 'total')} AS pct,
         row_number() OVER (PARTITION BY v.session_id ORDER BY count DESC, first_id ASC) AS rank
  FROM v JOIN t ON v.session_id = t.session_id)""") + f"SELECT * FROM r {where}"


@register("d01_sentiment_breakdown", with_feedback(COUNTS_CTE) + f"""
SELECT session_id, total_reviews, positive_count, negative_count, neutral_count,
       {spct('positive_count', 'total_reviews')} AS positive_pct,
       {spct('negative_count', 'total_reviews')} AS negative_pct,
       {spct('neutral_count', 'total_reviews')} AS neutral_pct,
       {OVERALL} AS overall_score
FROM counts""")
def d01(spark, sf_dir):
    return D.sentiment_breakdown(feedback(spark, sf_dir))


@register("d02_category_breakdown", _value_sql("primary_category", "category"))
def d02(spark, sf_dir):
    return D.category_breakdown(feedback(spark, sf_dir))


@register("d03_urgency_breakdown", with_feedback(COUNTS_CTE) + f"""
SELECT session_id, critical_count, medium_count, low_count,
       {spct('critical_count', 'total_reviews')} AS critical_pct FROM counts""")
def d03(spark, sf_dir):
    return D.urgency_breakdown(feedback(spark, sf_dir))


@register("d04_urgency_matrix", with_feedback() + """
SELECT session_id, category, critical, medium, low,
       row_number() OVER (PARTITION BY session_id ORDER BY critical DESC, category ASC) AS rank
FROM (SELECT session_id, primary_category AS category,
             count_if(urgency = 'critical') AS critical, count_if(urgency = 'medium') AS medium,
             count_if(urgency = 'low') AS low
      FROM feedback WHERE primary_category IS NOT NULL AND urgency IS NOT NULL GROUP BY 1, 2)""")
def d04(spark, sf_dir):
    return D.urgency_matrix(feedback(spark, sf_dir))


@register("d05_emotion_breakdown", _value_sql("emotion", "emotion"))
def d05(spark, sf_dir):
    return D.emotion_breakdown(feedback(spark, sf_dir))


@register("d06_multi_aspect", with_feedback(COUNTS_CTE) + f"""
SELECT session_id, multi_aspect_count, {spct('multi_aspect_count', 'total_reviews')} AS multi_aspect_pct,
       total_reviews - multi_aspect_count AS single_aspect_count FROM counts""")
def d06(spark, sf_dir):
    return D.multi_aspect_stats(feedback(spark, sf_dir))


@register("d07_top_issues", with_feedback(TOP_ISSUES_CTE) + """
SELECT session_id, rank, category, count, critical_count, example,
       array_to_string(all_examples[1:3], ' | ') AS example_list
FROM issues WHERE rank <= 5""")
def d07(spark, sf_dir):
    return D.top_issues(feedback(spark, sf_dir)).withColumn("example_list", F.array_join("example_list", " | "))


@register("d08_confidence_breakdown", with_feedback(COUNTS_CTE) + f"""
SELECT session_id, high_confidence_count AS high_count, medium_confidence_count AS medium_count,
       low_confidence_count AS low_count, {spct('low_confidence_count', 'total_reviews')} AS low_pct
FROM counts""")
def d08(spark, sf_dir):
    return D.confidence_breakdown(feedback(spark, sf_dir))


@register("d09_top_category", _value_sql("primary_category", "category", "WHERE rank = 1")
          .replace("SELECT * FROM r WHERE rank = 1", "SELECT session_id, category AS top_category FROM r WHERE rank = 1"))
def d09(spark, sf_dir):
    return D.top_category(feedback(spark, sf_dir))


DASHBOARD_SQL = with_feedback(COUNTS_CTE, TOP_ISSUES_CTE, DASH_CTE) + "SELECT * FROM dashboard"


@register("d10_dashboard", DASHBOARD_SQL)
def d10(spark, sf_dir):
    return D.dashboard(feedback(spark, sf_dir))


@register("d11_health_score", with_feedback(COUNTS_CTE, TOP_ISSUES_CTE, DASH_CTE)
          + "SELECT session_id, positive_pct, critical_pct, low_pct, health_score, health_label FROM dashboard")
def d11(spark, sf_dir):
    return D.dashboard(feedback(spark, sf_dir)).select(
        "session_id", "positive_pct", "critical_pct", "low_pct", "health_score", "health_label")


@register("d12_score_band", with_feedback(COUNTS_CTE) + f"""
SELECT session_id, overall_score,
       CASE WHEN overall_score >= 70 THEN 'Strong' WHEN overall_score >= 40 THEN 'Mixed' ELSE 'Concerning' END AS band
FROM (SELECT session_id, {OVERALL} AS overall_score FROM counts)""")
def d12(spark, sf_dir):
    s = D.sentiment_breakdown(feedback(spark, sf_dir))
    return s.select("session_id", "overall_score", D.score_band("overall_score").alias("band"))


@register("d13_urgency_shares", with_feedback(COUNTS_CTE) + f"""
SELECT session_id,
       {spct('critical_count', '(critical_count + medium_count + low_count)')} AS critical_share,
       {spct('medium_count', '(critical_count + medium_count + low_count)')} AS medium_share,
       {spct('low_count', '(critical_count + medium_count + low_count)')} AS low_share
FROM counts""")
def d13(spark, sf_dir):
    return D.urgency_shares(feedback(spark, sf_dir))


@register("d14_top_emotions", _value_sql("emotion", "emotion", "WHERE rank <= 8"))
def d14e(spark, sf_dir):
    return D.top_k_per_session(D.emotion_breakdown(feedback(spark, sf_dir)), 8)


@register("d14_top_categories", _value_sql("primary_category", "category", "WHERE rank <= 8"))
def d14c(spark, sf_dir):
    return D.top_k_per_session(D.category_breakdown(feedback(spark, sf_dir)), 8)


@register("d14_top_issues_display", with_feedback(TOP_ISSUES_CTE) + """
SELECT session_id, rank, category, count, critical_count FROM issues WHERE rank <= 4""")
def d14i(spark, sf_dir):
    return D.top_issues(feedback(spark, sf_dir), 4).select("session_id", "rank", "category", "count", "critical_count")
