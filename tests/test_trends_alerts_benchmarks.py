import datetime as dt

from revlens.operators import alerts as G
from revlens.operators import benchmarks as B
from revlens.operators import trends as E

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def _history(spark):
    return spark.createDataFrame([(1, "s1", T1, 10, 60.0, "a"), (1, "s2", T2, 12, 72.0, "b"), (2, "s3", T1, 5, 50.0, "c")],
                                 "user_id long, session_id string, created_at timestamp, total_reviews long, "
                                 "overall_score double, label string")


def _dash(spark, rows=None):
    rows = rows or [("s1", 50.0, 30.0, 20.0, 2, 10.0, "Delivery", 70.0, "Delivery"),
                    ("s2", 60.0, 20.0, 20.0, 3, 25.0, "Support", 55.0, "Billing"),
                    ("s3", 40.0, 40.0, 20.0, 0, 0.0, "Price", 50.0, None)]
    return spark.createDataFrame(rows, "session_id string, positive_pct double, negative_pct double, neutral_pct double, "
                                       "critical_count long, critical_pct double, top_category string, "
                                       "overall_score double, top_issue string")


def test_trajectory_drift_emerging(spark):
    series = E.session_series(_history(spark), _dash(spark))
    traj = {r.user_id: r for r in E.sentiment_trajectory(series).collect()}
    assert traj[1].trend == "improving" and traj[1].change == 12.0
    assert traj[2].trend == "insufficient_data" and traj[2].change == 0.0
    cats = spark.createDataFrame([("s1", "Delivery", 50.0), ("s1", "Billing", 20.0), ("s2", "Delivery", 40.0),
                                  ("s2", "Support", 30.0)], "session_id string, category string, pct double")
    drift = {r.category: r.status for r in E.category_drift(series, cats).collect()}
    assert drift == {"Delivery": "shrinking", "Support": "new", "Billing": "dropped"}
    issues = spark.createDataFrame([("s1", "Delivery", 2), ("s2", "Delivery", 0), ("s2", "Billing", 3)],
                                   "session_id string, category string, critical_count long")
    em = {r.category: r.status for r in E.emerging_issues(series, issues).collect()}
    assert em == {"Delivery": "resolved", "Billing": "emerging"}


def test_alert_rules(spark):
    ev = {(r.session_id, r.event): r for r in G.alerts(_history(spark), _dash(spark)).collect()}
    assert ("s2", "critical_spike") in ev and ev[("s2", "critical_spike")].critical_pct == 25.0
    assert ev[("s2", "sentiment_drop")].drop == 15.0
    assert ev[("s2", "new_top_issue")].new_issue == "Billing" and ev[("s2", "new_top_issue")].previous_issue == "Delivery"
    assert not any(k[0] in ("s1", "s3") and k[1] != "critical_spike" for k in ev)  # no previous -> no comparisons
    # previous not live -> no comparison rules
    live = spark.createDataFrame([("s2",)], "session_id string")
    ev2 = {r.event for r in G.alerts(_history(spark), _dash(spark), live=live).collect() if r.session_id == "s2"}
    assert ev2 == {"critical_spike"}


def test_subscriptions(spark):
    events = G.alerts(_history(spark), _dash(spark))
    subs = spark.createDataFrame([(1, "https://x/1", ["sentiment_drop"], True), (2, "http://x/2", ["critical_spike"], True)],
                                 "user_id long, url string, events array<string>, active boolean")
    m = G.match_subscriptions(events, subs).collect()
    assert [(r.user_id, r.event) for r in m] == [(1, "sentiment_drop")]


def _analyses(spark, scores, industry="Retail"):
    rows = [(f"s{i}", i, industry, dt.datetime(2024, 1, 1 + i), s, 50.0, 10.0, 5.0, 20, "Delivery")
            for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "session_id string, user_id long, industry string, created_at timestamp, "
                                       "overall_score double, positive_pct double, negative_pct double, "
                                       "critical_pct double, total_reviews long, top_category string")


def test_benchmark_gate_and_compare(spark):
    a = _analyses(spark, [60.0, 65.0, 70.0, 55.0, 75.0])
    bench = B.benchmark_rollup(a)
    row = bench.collect()[0]
    assert row.company_count == 5 and row.avg_overall_score == 65.0
    assert (row.bucket_51_75, row.bucket_26_50) == (5, 0)
    me = spark.createDataFrame([("me", 99, "Retail", 80.0, 50.0, 10.0, 5.0)],
                               "session_id string, user_id long, industry string, overall_score double, "
                               "positive_pct double, negative_pct double, critical_pct double")
    cmp = B.benchmark_compare(me, bench).collect()[0]
    assert cmp.score_vs_avg == 15.0 and cmp.score_percentile == 100
    ins = B.benchmark_insight(B.benchmark_compare(me, bench)).collect()[0]
    assert ins.dominant == "score" and "score over the mean by 15.0" in ins.insight
    small = B.benchmark_gate(B.benchmark_rollup(_analyses(spark, [60.0, 70.0, 80.0, 90.0]))).collect()[0]
    assert small.available is False and small.reason == "insufficient_data"


def test_benchmark_repeat_company_counts_once(spark):
    a = _analyses(spark, [60.0, 70.0, 80.0, 90.0, 50.0])
    again = spark.createDataFrame([("s9", 0, "Retail", dt.datetime(2024, 3, 1), 100.0, 50.0, 10.0, 5.0, 20, "Price")],
                                  a.schema)
    r = B.benchmark_rollup(a.unionByName(again)).collect()[0]
    assert r.company_count == 5                      # idempotent per user
    assert r.avg_overall_score == 78.0               # latest analysis of user 0 counts
    assert r.common_top_category == "Delivery"       # votes from every analysis
