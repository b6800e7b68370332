import datetime as dt

from pyspark.sql import functions as F

from revlens.operators import dashboard as D

COLS = ["session_id", "review_id", "sentiment", "primary_category", "secondary_category", "urgency", "emotion",
        "core_issue", "confidence"]


SCHEMA = ", ".join(f"{c} {'int' if c == 'review_id' else 'string'}" for c in COLS)


def fact(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sentiment_and_health_examples(spark):
    rows = [("s", 0, "positive", "Delivery", None, "low", "happy", "fast", "high"),
            ("s", 1, "negative", "Delivery", "Price", "critical", "angry", "late box", "low"),
            ("s", 2, "negative", "Support", "—", "medium", "frustrated", "rude", "medium"),
            ("s", 3, "neutral", "Support", None, "low", "neutral", "ok", "high")]
    d = D.dashboard(fact(spark, rows)).collect()[0]
    assert d.total_reviews == 4 and d.positive_count == 1 and d.negative_count == 2
    assert d.positive_pct == 25.0 and d.overall_score == 25.0  # (1-2)/4*100+50
    assert d.critical_pct == 25.0 and d.multi_aspect_count == 1 and d.single_aspect_count == 3
    assert d.top_category == "Delivery"  # tie 2-2: first seen wins
    assert d.top_issue == "Delivery"     # critical desc first


def test_health_score_reference_values(spark):
    df = spark.createDataFrame([(60.0, 10.0, 5.0), (0.0, 80.0, 30.0)], ["positive_pct", "critical_pct", "low_pct"])
    out = D.health_score(df).orderBy(F.desc("positive_pct")).collect()
    assert (out[0].health_score, out[0].health_label) == (76, "Strong")
    assert out[1].health_score == 20 and out[1].health_label == "Critical"


def test_rounding_is_half_even(spark):
    # 1/8*100 = 12.5 -> Python round(12.5, 1) = 12.5 ; 1/16*100 = 6.25 -> 6.2 (half-even)
    rows = [("s", i, "positive" if i == 0 else "neutral", "A", None, "low", "happy", "x", "high") for i in range(16)]
    d = D.sentiment_breakdown(fact(spark, rows)).collect()[0]
    assert d.positive_pct == 6.2


def test_top_issues_order_and_examples(spark):
    rows = [("s", 0, "negative", "B", None, "low", "angry", "b0", "high"),
            ("s", 1, "negative", "A", None, "low", "angry", None, "high"),
            ("s", 2, "negative", "A", None, "low", "angry", "a2", "high"),
            ("s", 3, "negative", "B", None, "low", "angry", "b3", "high"),
            ("s", 4, "negative", "A", None, "low", "angry", "a4", "high"),
            ("s", 5, "negative", "A", None, "low", "angry", "a5", "high")]
    out = D.top_issues(fact(spark, rows)).orderBy("rank").collect()
    assert [r.category for r in out] == ["A", "B"]
    assert out[0].example == "a2"                       # first non-null
    assert out[0].example_list == [None, "a2", "a4"]    # first three, nulls kept
    ties = D.top_issues(fact(spark, [r for r in rows if r[1] in (0, 1)])).orderBy("rank").collect()
    assert [r.category for r in ties] == ["A", "B"]     # equal counts: category asc


def test_urgency_matrix_and_shares(spark):
    rows = [("s", 0, "negative", "A", None, "critical", "angry", "x", "high"),
            ("s", 1, "negative", "B", None, "low", "angry", "x", "high")]
    m = {r.category: r for r in D.urgency_matrix(fact(spark, rows)).collect()}
    assert (m["A"].critical, m["A"].medium, m["A"].low, m["A"].rank) == (1, 0, 0, 1)
    sh = D.urgency_shares(fact(spark, rows)).collect()[0]
    assert sh.critical_share == 50.0 and sh.low_share == 50.0


def test_score_band(spark):
    df = spark.createDataFrame([(70.0,), (40.0,), (39.9,)], ["s"])
    assert [r.b for r in df.select(D.score_band("s").alias("b")).collect()] == ["Strong", "Mixed", "Concerning"]
