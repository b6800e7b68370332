"""Registered industry benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import benchmarks as B
from revlens.plans.catalog import register
from revlens.plans.derived import DERIVED_CTES, all_derived
from revlens.plans.sqlbits import with_feedback

SQL = with_feedback(*DERIVED_CTES)

_ROLLUP = """analyses AS (
  SELECT session_id, user_id, industry, CAST(created_at AS TIMESTAMP) AS created_at, overall_score, positive_pct,
         negative_pct, critical_pct, total_reviews, top_category FROM dashboards),
per_company AS (
  SELECT industry, user_id, min((created_at, session_id)) AS first_arrival,
         arg_max(overall_score, (created_at, session_id)) AS overall_score,
         arg_max(positive_pct, (created_at, session_id)) AS positive_pct,
         arg_max(negative_pct, (created_at, session_id)) AS negative_pct,
         arg_max(critical_pct, (created_at, session_id)) AS critical_pct,
         arg_max(total_reviews, (created_at, session_id)) AS total_reviews
  FROM analyses GROUP BY 1, 2),
votes AS (
  SELECT industry, top_category, count(*) AS votes, min((created_at, session_id)) AS first_vote
  FROM analyses WHERE top_category IS NOT NULL AND top_category <> '' GROUP BY 1, 2),
common AS (
  SELECT industry, top_category AS common_top_category FROM (
    SELECT *, row_number() OVER (PARTITION BY industry ORDER BY votes DESC, first_vote ASC) AS r FROM votes)
  WHERE r = 1),
bench AS (
  SELECT b.*, c.common_top_category FROM (
    SELECT industry, count(*) AS company_count,
           round_even(avg(overall_score), 2) AS avg_overall_score, round_even(avg(positive_pct), 2) AS avg_positive_pct,
           round_even(avg(negative_pct), 2) AS avg_negative_pct, round_even(avg(critical_pct), 2) AS avg_critical_pct,
           round_even(avg(total_reviews), 2) AS avg_total_reviews,
           count_if(overall_score <= 25) AS bucket_0_25,
           count_if(overall_score > 25 AND overall_score <= 50) AS bucket_26_50,
           count_if(overall_score > 50 AND overall_score <= 75) AS bucket_51_75,
           count_if(overall_score > 75) AS bucket_76_100
    FROM {companies} GROUP BY industry) b LEFT JOIN common c ON b.industry = c.industry),
cmp AS (
  SELECT d.session_id, d.user_id, d.industry, b.company_count,
         round_even(d.overall_score, 2) AS your_score, b.avg_overall_score AS industry_avg_score,
         least(100, CAST(round_even(CAST((CASE WHEN d.overall_score >= 0 THEN bucket_0_25 ELSE 0 END)
              + (CASE WHEN d.overall_score >= 26 THEN bucket_26_50 ELSE 0 END)
              + (CASE WHEN d.overall_score >= 51 THEN bucket_51_75 ELSE 0 END)
              + (CASE WHEN d.overall_score >= 76 THEN bucket_76_100 ELSE 0 END) AS DOUBLE)
              / b.company_count * 100.0, 0) AS INTEGER)) AS score_percentile,
         round_even(d.overall_score - b.avg_overall_score, 2) AS score_vs_avg,
         round_even(d.positive_pct, 2) AS your_positive_pct, b.avg_positive_pct AS industry_avg_positive_pct,
         round_even(d.positive_pct - b.avg_positive_pct, 2) AS pos_vs_avg,
         round_even(d.negative_pct, 2) AS your_negative_pct, b.avg_negative_pct AS industry_avg_negative_pct,
         round_even(d.negative_pct - b.avg_negative_pct, 2) AS neg_vs_avg,
         round_even(d.critical_pct, 2) AS your_critical_pct, b.avg_critical_pct AS industry_avg_critical_pct,
         round_even(d.critical_pct - b.avg_critical_pct, 2) AS crit_vs_avg,
         b.common_top_category
  FROM dashboards d JOIN bench b ON d.industry = b.industry WHERE b.company_count >= 5)"""

ROLLUP_SQL = _ROLLUP.replace("{companies}", "per_company")
CAPPED_SQL = _ROLLUP.replace("{companies}", """(
    SELECT *, row_number() OVER (PARTITION BY industry ORDER BY first_arrival) AS k FROM per_company QUALIFY k <= 100)""")

ROLLUP_COLS = ("industry, company_count, avg_overall_score, avg_positive_pct, avg_negative_pct, avg_critical_pct, "
               "avg_total_reviews, bucket_0_25, bucket_26_50, bucket_51_75, bucket_76_100, common_top_category")


def _bench(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return dash, B.benchmark_rollup(B.analyses_from_dashboards(dash))


@register("f01_pseudonymise", SQL + """
SELECT DISTINCT user_id, industry, sha256(CAST(user_id AS VARCHAR)) AS user_hash FROM dashboards""")
def f01(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return dash.select("user_id", "industry", B.pseudonymise("user_id").alias("user_hash")).distinct()


@register("f02_score_bucket", SQL + """
SELECT session_id, overall_score, CASE WHEN overall_score <= 25 THEN '0-25' WHEN overall_score <= 50 THEN '26-50'
       WHEN overall_score <= 75 THEN '51-75' ELSE '76-100' END AS bucket FROM dashboards""")
def f02(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return dash.select("session_id", "overall_score", B.score_bucket("overall_score").alias("bucket"))


@register("f03_benchmark_rollup", SQL + ", " + ROLLUP_SQL + f" SELECT {ROLLUP_COLS} FROM bench")
def f03(spark, sf_dir):
    return _bench(spark, sf_dir)[1]


@register("f05_capped_rollup", SQL + ", " + CAPPED_SQL + f" SELECT {ROLLUP_COLS} FROM bench")
def f05(spark, sf_dir):
    """The capped variant, at a cap that the data reach."""
    _, dash, _ = all_derived(spark, sf_dir)
    return B.benchmark_rollup(B.analyses_from_dashboards(dash), 100)


@register("f04_common_top_category", SQL + ", " + ROLLUP_SQL + " SELECT * FROM common")
def f04(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return B.common_top_category(B.analyses_from_dashboards(dash))


SUB_INDUSTRY_SQL = "CASE WHEN user_id % 50 = 0 THEN industry || ' ' || user_id ELSE industry END"


@register("f10_industry_summary", SQL + ", " + ROLLUP_SQL.replace("user_id, industry, CAST(created_at", f"user_id, {SUB_INDUSTRY_SQL} AS industry, CAST(created_at", 1) + f"""
SELECT {ROLLUP_COLS}, company_count >= 5 AS available,
       CASE WHEN company_count < 5 THEN 'insufficient_data' END AS reason FROM bench""")
def f10(spark, sf_dir):
    """Every fiftieth company is an industry of its own, too small for a benchmark."""
    _, dash, _ = all_derived(spark, sf_dir)
    own = F.concat_ws(" ", "industry", F.col("user_id").cast("string"))
    dash = dash.withColumn("industry", F.when(F.col("user_id") % 50 == 0, own).otherwise(F.col("industry")))
    return B.industry_summary(B.benchmark_rollup(B.analyses_from_dashboards(dash)))


@register("f08_benchmark_compare", SQL + ", " + ROLLUP_SQL + " SELECT * FROM cmp")
def f08(spark, sf_dir):
    dash, bench = _bench(spark, sf_dir)
    return B.benchmark_compare(dash, bench)


@register("f09_benchmark_insight", SQL + ", " + ROLLUP_SQL + """
, dom AS (
  SELECT *, CASE WHEN abs(score_vs_avg) = greatest(abs(score_vs_avg), abs(neg_vs_avg), abs(crit_vs_avg), abs(pos_vs_avg)) THEN 'score'
                 WHEN abs(neg_vs_avg) = greatest(abs(score_vs_avg), abs(neg_vs_avg), abs(crit_vs_avg), abs(pos_vs_avg)) THEN 'negative'
                 WHEN abs(crit_vs_avg) = greatest(abs(score_vs_avg), abs(neg_vs_avg), abs(crit_vs_avg), abs(pos_vs_avg)) THEN 'critical'
                 ELSE 'positive' END AS dominant FROM cmp)
SELECT session_id, dominant,
       industry || ' peers: ' || dominant || ' ' || CASE WHEN delta > 0 THEN 'over' WHEN delta < 0 THEN 'under' ELSE 'level with' END
       || ' the mean by ' || printf('%.1f', round_even(abs(delta), 1))
       || CASE WHEN dominant = 'critical' AND delta > 0 THEN ' (worse than '
               || CAST(least(99, CAST(round_even((1.0 - score_percentile / 100.0) * 100.0, 0) AS INTEGER)) AS VARCHAR)
               || ' in 100 peers)' ELSE '' END AS insight
FROM (SELECT *, CASE dominant WHEN 'score' THEN score_vs_avg WHEN 'negative' THEN neg_vs_avg WHEN 'critical' THEN crit_vs_avg
                              ELSE pos_vs_avg END AS delta FROM dom) """.replace("\n, dom AS", ", dom AS", 1))
def f09(spark, sf_dir):
    dash, bench = _bench(spark, sf_dir)
    return B.benchmark_insight(B.benchmark_compare(dash, bench)).select("session_id", "dominant", "insight")


@register("f11_benchmark_badges", SQL + ", " + ROLLUP_SQL + """
, x AS (
  SELECT session_id, 'score' AS measure, score_vs_avg AS diff, false AS lower_better FROM cmp
  UNION ALL SELECT session_id, 'positive', your_positive_pct - industry_avg_positive_pct, false FROM cmp
  UNION ALL SELECT session_id, 'negative', your_negative_pct - industry_avg_negative_pct, true FROM cmp
  UNION ALL SELECT session_id, 'critical', your_critical_pct - industry_avg_critical_pct, true FROM cmp)
SELECT session_id, measure, round_even(diff, 2) AS diff,
       CASE WHEN (lower_better AND diff < -2) OR (NOT lower_better AND diff > 2) THEN 'better'
            WHEN (lower_better AND diff > 2) OR (NOT lower_better AND diff < -2) THEN 'worse'
            ELSE 'similar' END AS badge
FROM x""".replace("\n, x AS", ", x AS", 1))
def f11(spark, sf_dir):
    dash, bench = _bench(spark, sf_dir)
    return B.benchmark_badges(B.benchmark_compare(dash, bench))
