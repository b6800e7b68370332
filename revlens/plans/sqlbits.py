"""Small SQL text helpers for the DuckDB oracle queries."""

from revlens.sources.tables import FEEDBACK_SQL


def with_feedback(*ctes: str) -> str:
    """WITH clause holding the feedback fixture plus extra CTEs."""
    return "WITH " + ",\n".join((FEEDBACK_SQL,) + ctes) + "\n"


def spct(c: str, t: str) -> str:
    return (f"(CASE WHEN {t} > 0 THEN round_even(CAST({c} AS DOUBLE) / CAST({t} AS DOUBLE) * 100.0, 1) "
            f"ELSE 0.0 END)")


COUNTS_CTE = """counts AS (
  SELECT session_id, count(*) AS total_reviews,
         count_if(sentiment = 'positive') AS positive_count,
         count_if(sentiment = 'negative') AS negative_count,
         count_if(sentiment = 'neutral') AS neutral_count,
         count_if(urgency = 'critical') AS critical_count,
         count_if(urgency = 'medium') AS medium_count,
         count_if(urgency = 'low') AS low_count,
         count_if(confidence = 'high') AS high_confidence_count,
         count_if(confidence = 'medium') AS medium_confidence_count,
         count_if(confidence = 'low') AS low_confidence_count,
         count_if(coalesce(secondary_category, '—') <> '—') AS multi_aspect_count
  FROM feedback GROUP BY session_id)"""

OVERALL = ("(CASE WHEN total_reviews > 0 THEN round_even(CAST(positive_count - negative_count AS DOUBLE) / "
           "CAST(total_reviews AS DOUBLE) * 100.0 + 50.0, 1) ELSE 0.0 END)")

TOP_ISSUES_CTE = """neg AS (
  SELECT session_id, primary_category AS category, review_id, urgency, core_issue
  FROM feedback WHERE sentiment = 'negative' AND primary_category IS NOT NULL),
issue_agg AS (
  SELECT session_id, category, count(*) AS count, count_if(urgency = 'critical') AS critical_count,
         arg_min(core_issue, review_id) FILTER (WHERE core_issue IS NOT NULL) AS example,
         list(core_issue ORDER BY review_id) AS all_examples
  FROM neg GROUP BY session_id, category),
issues AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY critical_count DESC, count DESC, category ASC) AS rank
  FROM issue_agg)"""

DASH_CTE = """cat_rank AS (
  SELECT session_id, primary_category AS category, count(*) AS cnt, min(review_id) AS first_id
  FROM feedback WHERE primary_category IS NOT NULL GROUP BY 1, 2),
top_cat AS (
  SELECT session_id, category AS top_category FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cnt DESC, first_id ASC) AS rk FROM cat_rank)
  WHERE rk = 1),
dash AS (
  SELECT c.session_id, c.total_reviews, c.positive_count, c.negative_count, c.neutral_count,
         {pp} AS positive_pct, {np} AS negative_pct, {up} AS neutral_pct, {ov} AS overall_score,
         c.critical_count, c.medium_count, c.low_count, {cp} AS critical_pct,
         c.multi_aspect_count, {mp} AS multi_aspect_pct, c.total_reviews - c.multi_aspect_count AS single_aspect_count,
         c.high_confidence_count, c.medium_confidence_count, c.low_confidence_count, {lp} AS low_pct,
         coalesce(t.top_category, '—') AS top_category, i.category AS top_issue,
         i.critical_count AS top_issue_critical_count
  FROM counts c LEFT JOIN top_cat t ON c.session_id = t.session_id
  LEFT JOIN (SELECT * FROM issues WHERE rank = 1) i ON c.session_id = i.session_id),
dash_h AS (
  SELECT *, least(greatest(CAST(round_even(positive_pct * 0.5 + (100.0 - critical_pct) * 0.3
                  + (100.0 - low_pct) * 0.2, 0) AS INTEGER), 0), 100) AS health_score
  FROM dash),
dashboard AS (
  SELECT *, CASE WHEN health_score >= 75 THEN 'Strong' WHEN health_score >= 50 THEN 'Mixed'
                 WHEN health_score >= 25 THEN 'Needs Attention' ELSE 'Critical' END AS health_label
  FROM dash_h)""".format(
    pp=spct("c.positive_count", "c.total_reviews"), np=spct("c.negative_count", "c.total_reviews"),
    up=spct("c.neutral_count", "c.total_reviews"),
    ov=OVERALL.replace("total_reviews", "c.total_reviews").replace("positive_count", "c.positive_count")
              .replace("negative_count", "c.negative_count"),
    cp=spct("c.critical_count", "c.total_reviews"), mp=spct("c.multi_aspect_count", "c.total_reviews"),
    lp=spct("c.low_confidence_count", "c.total_reviews"))
