"""Registered session/history (A10-A14), trend (E1-E5) and alert (G1-G6) queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from revlens.operators import alerts as G
from revlens.operators import dashboard as D
from revlens.operators import sessions as S
from revlens.operators import trends as E
from revlens.plans.catalog import register
from revlens.plans.derived import CAT_CTE, DERIVED_CTES, all_derived, dashboards, history, profiles, sessions_table
from revlens.plans.sqlbits import spct, with_feedback
from revlens.session import cut_lineage
from revlens.sources.tables import feedback, read_table

NOW = dt.datetime(1998, 1, 3, 20, 0, 0)
NOW_SQL = "TIMESTAMP '1998-01-03 20:00:00'"
SQL = with_feedback(*DERIVED_CTES)
SQL_CATS = with_feedback(*DERIVED_CTES, CAT_CTE.format(pct=spct("count", "total")))

SESSIONS_SQL = """sessions AS (
  SELECT session_id, user_id, 'complete' AS status, total_reviews,
         CAST(created_at AS TIMESTAMP) + to_hours(CAST(total_reviews AS BIGINT)) AS last_updated
  FROM dashboards)"""


# --- A: sessions and history -------------------------------------------------
@register("a10_live_sessions", with_feedback(*DERIVED_CTES, SESSIONS_SQL) + f"""
SELECT * FROM sessions WHERE last_updated IS NOT NULL
  AND epoch({NOW_SQL}) - epoch(last_updated) <= 48 * 3600.0""")
def a10(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return S.live_sessions(sessions_table(dash), NOW, 48)


@register("a11_latest_history", SQL + "SELECT * FROM newest")
def a11(spark, sf_dir):
    _, _, hist = all_derived(spark, sf_dir)
    return S.latest_history(hist)


@register("a11_newest_three", SQL + "SELECT * FROM newest WHERE pos <= 3")
def a11_three(spark, sf_dir):
    """The capped variant, at a cap that the data reach."""
    _, _, hist = all_derived(spark, sf_dir)
    return S.latest_history(hist, 3)


@register("a12_upsert_sessions", with_feedback(*DERIVED_CTES, SESSIONS_SQL) + f"""
, old AS (SELECT session_id, user_id, 'pending' AS status, CAST(NULL AS BIGINT) AS total_reviews,
                 CAST(created_at AS TIMESTAMP) AS last_updated FROM dashboards),
new AS (SELECT s.session_id, s.status, s.total_reviews FROM sessions s JOIN series r ON s.session_id = r.session_id
        WHERE r.seq = r.n_sessions)
SELECT coalesce(n.session_id, o.session_id) AS session_id, o.user_id AS user_id,
       coalesce(n.status, o.status) AS status, coalesce(n.total_reviews, o.total_reviews) AS total_reviews,
       CASE WHEN n.session_id IS NOT NULL THEN {NOW_SQL} ELSE o.last_updated END AS last_updated
FROM old o FULL OUTER JOIN new n ON o.session_id = n.session_id""".replace("\n, old AS", ", old AS", 1))
def a12(spark, sf_dir):
    _, dash, hist = all_derived(spark, sf_dir)
    old = dash.select("session_id", "user_id", F.lit("pending").alias("status"),
                      F.lit(None).cast("bigint").alias("total_reviews"),
                      F.col("created_at").cast("timestamp").alias("last_updated"))
    series = E.session_series(hist, dash)
    new = sessions_table(dash).join(series.filter(F.col("seq") == F.col("n_sessions")).select("session_id"),
                                    "session_id", "left_semi").select("session_id", "status", "total_reviews")
    return S.upsert_sessions(old, new, NOW)


@register("a13_user_totals", SQL + """
SELECT user_id, count(*) AS session_count, CAST(sum(total_reviews) AS BIGINT) AS total_reviews FROM history GROUP BY user_id""")
def a13(spark, sf_dir):
    _, _, hist = all_derived(spark, sf_dir)
    return S.user_totals(hist)


@register("a14_report_rows", with_feedback() + """
SELECT f.session_id, row_number() OVER (PARTITION BY f.session_id ORDER BY review_id) AS row_no, review_id,
       sentiment, primary_category, urgency,
       core_issue AS example, t.total_rows
FROM feedback f JOIN (SELECT session_id, count(*) AS total_rows FROM feedback GROUP BY 1) t
  ON f.session_id = t.session_id""")
def a14(spark, sf_dir):
    fb, _, _ = all_derived(spark, sf_dir)
    return S.report_rows(fb)


@register("a14_report_extract", with_feedback() + """
SELECT f.session_id, row_number() OVER (PARTITION BY f.session_id ORDER BY review_id) AS row_no, review_id,
       sentiment, primary_category, urgency,
       CASE WHEN length(core_issue) > 12 THEN substring(core_issue, 1, 12) || '…' ELSE core_issue END AS example,
       t.total_rows
FROM feedback f JOIN (SELECT session_id, count(*) AS total_rows FROM feedback GROUP BY 1) t
  ON f.session_id = t.session_id
QUALIFY row_no <= 5""")
def a14_extract(spark, sf_dir):
    """The cut variant, at limits that the data reach."""
    fb, _, _ = all_derived(spark, sf_dir)
    return S.report_rows(fb, 5, 12)


# --- E: trends ---------------------------------------------------------------
@register("e01_session_series", SQL + "SELECT * FROM series")
def e01(spark, sf_dir):
    _, dash, hist = all_derived(spark, sf_dir)
    return E.session_series(hist, dash)


TRAJ_SQL = """traj AS (
  SELECT user_id, count(*) AS session_count, arg_min(overall_score, seq) AS first_score,
         arg_max(overall_score, seq) AS last_score
  FROM series GROUP BY user_id),
traj2 AS (
  SELECT user_id, session_count, first_score, last_score,
         CASE WHEN session_count >= 2 THEN round_even(last_score - first_score, 2) ELSE 0.0 END AS change,
         CASE WHEN session_count < 2 THEN 'insufficient_data'
              WHEN round_even(last_score - first_score, 2) > 5 THEN 'improving'
              WHEN round_even(last_score - first_score, 2) < -5 THEN 'declining' ELSE 'stable' END AS trend
  FROM traj)"""


@register("e02_sentiment_trajectory", SQL + ", " + TRAJ_SQL + """
SELECT *, session_count AS n_points FROM traj2""")
def e02(spark, sf_dir):
    _, dash, hist = all_derived(spark, sf_dir)
    t = E.sentiment_trajectory(E.session_series(hist, dash))
    return t.withColumn("n_points", F.col("session_count"))


DRIFT_SQL = """firsts AS (SELECT user_id, session_id FROM series WHERE n_sessions >= 2 AND seq = 1),
lasts AS (SELECT user_id, session_id FROM series WHERE n_sessions >= 2 AND seq = n_sessions),
prevs AS (SELECT user_id, session_id FROM series WHERE n_sessions >= 2 AND seq = n_sessions - 1),
fc AS (SELECT f.user_id, c.category, c.pct AS first_pct FROM firsts f JOIN cats c ON f.session_id = c.session_id),
lc AS (SELECT f.user_id, c.category, c.pct AS latest_pct FROM lasts f JOIN cats c ON f.session_id = c.session_id),
drift AS (
  SELECT coalesce(fc.user_id, lc.user_id) AS user_id, coalesce(fc.category, lc.category) AS category,
         first_pct, latest_pct,
         CASE WHEN first_pct IS NOT NULL AND latest_pct IS NOT NULL THEN round_even(latest_pct - first_pct, 2) END AS change,
         CASE WHEN first_pct IS NULL THEN 'new' WHEN latest_pct IS NULL THEN 'dropped'
              WHEN round_even(latest_pct - first_pct, 2) > 5 THEN 'growing'
              WHEN round_even(latest_pct - first_pct, 2) < -5 THEN 'shrinking' ELSE 'stable' END AS status
  FROM fc FULL OUTER JOIN lc ON fc.user_id = lc.user_id AND fc.category = lc.category),
pi AS (SELECT p.user_id, i.category, i.critical_count AS previous_critical
       FROM prevs p JOIN issues i ON p.session_id = i.session_id),
li AS (SELECT p.user_id, i.category, i.critical_count AS current_critical
       FROM lasts p JOIN issues i ON p.session_id = i.session_id),
emerging AS (
  SELECT user_id, category, previous_critical, current_critical, current_critical - previous_critical AS change,
         CASE WHEN current_critical - previous_critical > 0 THEN 'emerging'
              WHEN current_critical = 0 AND previous_critical > 0 THEN 'resolved' ELSE 'unchanged' END AS status
  FROM (SELECT coalesce(pi.user_id, li.user_id) AS user_id, coalesce(pi.category, li.category) AS category,
               coalesce(previous_critical, 0) AS previous_critical, coalesce(current_critical, 0) AS current_critical
        FROM pi FULL OUTER JOIN li ON pi.user_id = li.user_id AND pi.category = li.category))"""


def _shares(fb):
    """Category shares (D2) as a table: the first and the latest sessions read it."""
    return cut_lineage(D.category_breakdown(fb).select("session_id", "category", "pct"))


def _issues(fb):
    """Uncut issues (D7) as a table: the previous and the latest sessions read it."""
    return cut_lineage(D.top_issues(fb, None).select("session_id", "category", "critical_count"))


@register("e03_category_drift", SQL_CATS + ", " + DRIFT_SQL + " SELECT * FROM drift")
def e03(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    dash = cut_lineage(dashboards(fb))
    return E.category_drift(E.session_series(history(dash), dash), _shares(fb))


@register("e04_emerging_issues", SQL_CATS + ", " + DRIFT_SQL + " SELECT * FROM emerging")
def e04(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    dash = cut_lineage(dashboards(fb))
    return E.emerging_issues(E.session_series(history(dash), dash), _issues(fb))


@register("e05_trends", SQL_CATS + ", " + DRIFT_SQL + ", " + TRAJ_SQL + """
, dc AS (SELECT user_id, count_if(status = 'growing') AS n_growing, count_if(status = 'shrinking') AS n_shrinking,
               count_if(status = 'stable') AS n_stable, count_if(status = 'new') AS n_new,
               count_if(status = 'dropped') AS n_dropped FROM drift GROUP BY 1),
ec AS (SELECT user_id, count_if(status = 'emerging') AS n_emerging, count_if(status = 'resolved') AS n_resolved,
              count_if(status = 'unchanged') AS n_unchanged FROM emerging GROUP BY 1)
SELECT t.user_id, t.session_count >= 2 AS available, t.session_count, t.trend, t.change,
       coalesce(n_growing, 0) AS n_growing, coalesce(n_shrinking, 0) AS n_shrinking, coalesce(n_stable, 0) AS n_stable,
       coalesce(n_new, 0) AS n_new, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_emerging, 0) AS n_emerging,
       coalesce(n_resolved, 0) AS n_resolved, coalesce(n_unchanged, 0) AS n_unchanged
FROM traj2 t LEFT JOIN dc ON t.user_id = dc.user_id LEFT JOIN ec ON t.user_id = ec.user_id""".replace("\n, dc AS", ", dc AS", 1))
def e05(spark, sf_dir):
    fb = cut_lineage(feedback(spark, sf_dir).select("session_id", "user_id", "industry", "created_at", "review_id", "sentiment", "primary_category",
                                                    "secondary_category", "urgency", "core_issue", "confidence"))
    dash = cut_lineage(dashboards(fb))
    series = cut_lineage(E.session_series(history(dash), dash))
    drift = E.category_drift(series, _shares(fb))
    emerging = E.emerging_issues(series, _issues(fb))
    return E.trends(series, drift, emerging)


# --- G: alerts ---------------------------------------------------------------
ALERTS_SQL = """hl AS (
  SELECT user_id, session_id, lag(session_id) OVER (PARTITION BY user_id ORDER BY created_at, session_id) AS prev_session_id
  FROM history),
cur AS (
  SELECT hl.user_id, hl.session_id, d.critical_count, d.critical_pct, d.overall_score, d.top_issue,
         p.overall_score AS prev_score, p.top_issue AS prev_top_issue, p.session_id IS NOT NULL AS has_prev
  FROM hl JOIN dashboards d ON hl.session_id = d.session_id
  LEFT JOIN dashboards p ON hl.prev_session_id = p.session_id),
alerts AS (
  SELECT user_id, session_id, 'critical_spike' AS event, critical_count, critical_pct, CAST(20.0 AS DOUBLE) AS threshold,
         CAST(NULL AS DOUBLE) AS current_score, CAST(NULL AS DOUBLE) AS previous_score, CAST(NULL AS DOUBLE) AS drop,
         CAST(NULL AS VARCHAR) AS new_issue, CAST(NULL AS VARCHAR) AS previous_issue
  FROM cur WHERE critical_pct > 20.0
  UNION ALL
  SELECT user_id, session_id, 'sentiment_drop', NULL, NULL, NULL, overall_score, prev_score,
         round_even(prev_score - overall_score, 2), NULL, NULL
  FROM cur WHERE has_prev AND prev_score - overall_score > 10.0
  UNION ALL
  SELECT user_id, session_id, 'new_top_issue', NULL, NULL, NULL, NULL, NULL, NULL, top_issue, prev_top_issue
  FROM cur WHERE has_prev AND top_issue IS NOT NULL AND top_issue IS DISTINCT FROM prev_top_issue)"""

SUBS_SQL = """subs AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_nationkey = 0 THEN 'http://' ELSE 'https://' END || 'hooks.example.org/' || c_custkey AS url,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['critical_spike', 'sentiment_drop', 'new_top_issue']
                           WHEN 'BUILDING' THEN ['critical_spike']
                           WHEN 'FURNITURE' THEN ['sentiment_drop', 'new_top_issue']
                           WHEN 'MACHINERY' THEN ['new_top_issue', 'unknown_event']
                           ELSE ['critical_spike', 'sentiment_drop'] END AS events,
         c_acctbal >= 0 AS active
  FROM customer),
matched AS (
  SELECT a.*, s.url FROM alerts a JOIN subs s ON a.user_id = s.user_id
  WHERE s.active AND starts_with(s.url, 'https://')
    AND a.event IN ('critical_spike', 'sentiment_drop', 'new_top_issue') AND list_contains(s.events, a.event))"""


@register("g01_critical_spike", SQL + """
SELECT session_id, critical_count, critical_pct, CAST(20.0 AS DOUBLE) AS threshold FROM dashboards WHERE critical_pct > 20.0""")
def g01(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return G.critical_spike(dash)


@register("g04_alerts", SQL + ", " + ALERTS_SQL + " SELECT * FROM alerts")
def g04(spark, sf_dir):
    _, dash, hist = all_derived(spark, sf_dir)
    return G.alerts(hist, dash)


@register("g05_matched_alerts", SQL + ", " + ALERTS_SQL + ", " + SUBS_SQL + " SELECT * FROM matched")
def g05(spark, sf_dir):
    _, dash, hist = all_derived(spark, sf_dir)
    subs = G.subscriptions_from_customers(read_table(spark, sf_dir, "customer"))
    return G.match_subscriptions(G.alerts(hist, dash), subs)


@register("g06_alert_outbox", SQL + ", " + ALERTS_SQL + ", " + SUBS_SQL + f"""
SELECT '1.0' AS version, m.event, {NOW_SQL} AS triggered_at, m.session_id, m.user_id, c.c_name AS company_name,
       c.c_mktsegment AS industry, m.url, coalesce(critical_count, -1) AS critical_count, coalesce(drop, -1) AS drop,
       coalesce(new_issue, '') AS new_issue
FROM matched m LEFT JOIN customer c ON m.user_id = c.c_custkey""")
def g06(spark, sf_dir):
    _, dash, hist = all_derived(spark, sf_dir)
    subs = G.subscriptions_from_customers(read_table(spark, sf_dir, "customer"))
    out = G.alert_outbox(G.match_subscriptions(G.alerts(hist, dash), subs), profiles(spark, sf_dir), NOW)
    data = "critical_count bigint, critical_pct double, drop double, new_issue string"
    out = out.withColumn("d", F.from_json("data", data))
    return out.select("version", "event", "triggered_at", "session_id", "user_id", "company_name", "industry", "url",
                      F.coalesce("d.critical_count", F.lit(-1).cast("bigint")).alias("critical_count"),
                      F.coalesce("d.drop", F.lit(-1.0)).alias("drop"), F.coalesce("d.new_issue", F.lit("")).alias("new_issue"))
