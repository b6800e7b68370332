import json

from pyspark.sql import functions as F

from revlens.operators import actionplans as J
from revlens.streaming import streams as S


def plan(**kw):
    p = {"health_score": 76, "health_label": "Strong", "executive_summary": "ok", "key_strengths": ["x"],
         "recommendations": [{"rank": i, "title": f"Fix delivery {i}", "rationale": f"{i} critical delivery complaints",
                              "action": "Add a courier", "impact": "high", "effort": "low", "timeframe": "immediate"}
                             for i in (3, 1, 2)],
         "quick_win": {"title": "t", "description": "Send an apology", "expected_outcome": "o"},
         "data_quality_note": None}
    p.update(kw)
    return json.dumps(p)


def test_plan_parse_verify_dispose(spark):
    issues = spark.createDataFrame([("s", "Delivery", "parcel late", 1)], "session_id string, category string, "
                                                                          "example string, rank int")
    rows = [("s", 1, "<thinking>x</thinking>```json\n" + plan() + "\n```"),
            ("s", 2, plan(health_score=120)),
            ("s", 3, "not json"),
            ("s", 4, plan(recommendations=[{"rank": 1, "title": "a", "rationale": "no numbers", "action": "b",
                                            "impact": "high", "effort": "low", "timeframe": "immediate"}] * 3)),
            ("s", 5, plan(recommendations=[{"rank": 1, "title": "a", "rationale": "none", "action": "b",
                                            "impact": "high", "effort": "low", "timeframe": "immediate"}] * 3))]
    df = spark.createDataFrame(rows, "session_id string, attempt int, raw_plan string")
    v = J.verify_plans(J.parse_plans(df), issues)
    d = {r.attempt: r for r in J.plan_dispositions(v).collect()}
    assert d[1].disposition == "accepted" and d[1].grounding == "passed"
    assert d[2].parse_error == "bad_schema" and d[2].disposition == "retry"
    assert d[3].parse_error == "bad_json"
    assert d[4].grounding.startswith("rationales_with_numbers: 0") and d[4].disposition == "retry"
    assert d[5].disposition == "accepted_ungrounded"
    recs = J.plan_recommendations(J.parse_plans(df.filter("attempt = 1"))).orderBy("rank").collect()
    assert [r.rank for r in recs] == [1, 2, 3]


def test_filler_count(spark):
    df = spark.createDataFrame([("We will Leverage synergies and streamline, streamline",)], ["t"])
    assert df.select(J.filler_count(F.col("t"))).first()[0] == 3


def test_stream_dashboard_closed_windows(spark):
    sf = "/root/testdata/sf0.001"
    ev = S.event_stream(spark, f"{sf}/events.parquet")
    out = spark.read.parquet(S.run_to_table(S.stream_dashboard(ev), "t-dash"))
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    wm = batch.agg(F.max("ts")).first()[0]
    assert out.count() > 0
    assert out.agg(F.max("window_end")).first()[0] <= wm
    assert out.agg(F.sum("total")).first()[0] < batch.count()   # the open window is held back


def analyses(spark, rows):
    return spark.createDataFrame(rows, "session_id string, user_id long, industry string, created_at timestamp, overall_score double, "
                                       "positive_pct double, negative_pct double, critical_pct double, total_reviews long, top_category string")


def test_benchmark_table_survives_a_repeated_batch(spark):
    """A batch written again replaces itself; of a session's rows the newest by (created_at, batch) counts."""
    import datetime as dt
    d = lambda day: dt.datetime(2024, 1, day)
    first = analyses(spark, [("a", 1, "X", d(1), 10.0, 1.0, 1.0, 1.0, 5, "c"), ("b", 2, "X", d(2), 20.0, 1.0, 1.0, 1.0, 5, "c")])
    second = analyses(spark, [("a", 1, "X", d(3), 70.0, 1.0, 1.0, 1.0, 5, "c"), ("b", 2, "X", d(1), 90.0, 1.0, 1.0, 1.0, 5, "c")])
    table = S.scratch_path(spark, "t-bench")
    S.add_analyses(first, 0, table)
    S.add_analyses(second, 1, table)
    S.add_analyses(second, 1, table)  # a restart runs the batch again
    got = {r.session_id: r.overall_score for r in S.read_analyses(spark, table).collect()}
    assert got == {"a": 70.0, "b": 20.0}


def test_alert_state_expires_by_event_time(spark):
    """The second dashboard is too late to compare with the first, the third is not."""
    import datetime as dt
    d = lambda day: dt.datetime(2024, 1, day)
    rows = [("a", 1, "X", d(1), 90.0, 1.0, 1.0, 1.0, 5, "c"), ("b", 1, "X", d(9), 50.0, 1.0, 1.0, 30.0, 5, "c"), ("c", 1, "X", d(10), 20.0, 1.0, 1.0, 1.0, 5, "c")]
    path = S.scratch_path(spark, "t-alerts")
    analyses(spark, rows).withColumn("top_issue", F.lit(None).cast("string")).write.parquet(path)
    out = spark.read.parquet(S.run_to_table(S.stream_alerts(S.parquet_stream(spark, path), ttl_hours=48), "t-alerts-out"))
    assert sorted((r.session_id, r.event, r.drop) for r in out.collect()) == [("b", "critical_spike", None), ("c", "sentiment_drop", 30.0)]


def test_stream_clean_drops_noise_and_repeats(spark):
    path = S.scratch_path(spark, "t-clean")
    spark.createDataFrame([("s", "Fine  day"), ("s", "Fine day"), ("t", "Fine day"), ("s", "!!!!"), ("s", None)], "session_id string, text string").write.parquet(path)
    out = spark.read.parquet(S.run_to_table(S.stream_clean(S.parquet_stream(spark, path)), "t-clean-out"))
    assert sorted((r.session_id, r.text) for r in out.collect()) == [("s", "Fine day"), ("t", "Fine day")]


def test_benchmark_buckets_equal_the_full_rollup(spark):
    """Batches with re-sent sessions, changed categories and new users; a batch touches only its users' buckets."""
    import datetime as dt
    import random
    from revlens.operators import benchmarks as B
    rnd = random.Random(4)
    table, sent = S.scratch_path(spark, "t-bench"), []
    for b in range(4):
        users = rnd.sample(range(40), 6)
        rows = [(f"{u}-{rnd.randrange(3)}", u, "XYZ"[u % 3], dt.datetime(2024, 1 + b, 1 + rnd.randrange(20)), float(rnd.randrange(100)), 1.0 * b, 2.0, 3.0,
                 rnd.randrange(50), rnd.choice(["p", "q", "", None])) for u in users]
        rows = list({r[0]: r for r in rows}.values())
        sent += [(*r, b) for r in rows]
        batch = analyses(spark, rows)
        touched = S.add_analyses(batch, b, table, buckets=8)
        assert touched == sorted({r[0] for r in batch.select(F.expr("int(pmod(xxhash64(user_id), 8))")).collect()})
        S.add_analyses(batch, b, table, buckets=8)  # a restart runs the batch again
        newest = {}
        for r in sent:
            if r[0] not in newest or (r[3], r[10]) > (newest[r[0]][3], newest[r[0]][10]):
                newest[r[0]] = r
        want = B.benchmark_rollup(analyses(spark, [r[:10] for r in newest.values()]))
        got = S.read_benchmarks(spark, table).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_dashboards_are_compared_in_event_order(spark):
    """Four triggers; user 1's second dashboard comes after the third, one comes beyond the watermark, one user is forgotten."""
    import datetime as dt
    d = lambda day: dt.datetime(2024, 1, day)
    row = lambda s, u, day, score: (s, u, "X", d(day), score, 1.0, 1.0, 1.0, 5, "c")
    path = S.scratch_path(spark, "t-alerts")
    for rows in ([row("a", 1, 1, 90.0), row("x", 2, 1, 90.0), row("c", 1, 5, 40.0)],
                 [row("b", 1, 3, 60.0), row("z", 9, 8, 50.0)],
                 [row("y", 2, 20, 10.0)], [row("late", 1, 2, 10.0), row("z2", 9, 27, 50.0)]):
        analyses(spark, rows).withColumn("top_issue", F.lit("same")).coalesce(1).write.mode("append").parquet(path)
    progress = []
    out = spark.read.parquet(S.run_to_table(S.stream_alerts(S.parquet_stream(spark, path, 1), ttl_hours=24 * 10, late="96 hours"), "t-alerts-out", progress=progress))
    assert sorted((r.session_id, r.event, r.previous_score, r.drop) for r in out.collect()) == [("b", "sentiment_drop", 90.0, 30.0), ("c", "sentiment_drop", 60.0, 20.0)]
    assert len(progress) >= 4 and any("rocksdb" in m.lower() for p in progress if p["stateOperators"] for m in p["stateOperators"][0]["customMetrics"])


def test_alert_stream_goes_on_after_a_restart(spark):
    """A second run over new files continues from the state of the first."""
    import datetime as dt
    d = lambda day: dt.datetime(2024, 1, day)
    row = lambda s, day, score: (s, 1, "X", d(day), score, 1.0, 1.0, 1.0, 5, "c")
    path, out = S.scratch_path(spark, "t-alerts"), S.scratch_path(spark, "t-alerts-out")
    spark.conf.set(S.STATE_STORE, S.ROCKSDB)
    for rows in ([row("a", 1, 90.0)], [row("b", 4, 50.0)], [row("c", 9, 45.0)]):
        analyses(spark, rows).withColumn("top_issue", F.lit(None).cast("string")).coalesce(1).write.mode("append").parquet(path)
        q = (S.stream_alerts(S.parquet_stream(spark, path, 1), ttl_hours=None).writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", out + ".ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    spark.conf.unset(S.STATE_STORE)
    assert [(r.session_id, r.previous_score, r.drop) for r in spark.read.parquet(out).collect()] == [("b", 90.0, 40.0)]


def test_stream_clean_forgets_after_the_watermark(spark):
    """Re-sent lines inside the time are dropped, later ones pass again; the state holds the last days' texts only."""
    import datetime as dt
    path = S.scratch_path(spark, "t-clean")
    at = lambda day, hour=0: dt.datetime(2024, 3, day, hour)
    for day in range(1, 10):
        rows = [("s", f"line of day {day}", at(day)), ("s", "every day", at(day, 1)), ("s", f"Line  of day {day}".lower(), at(day, 2)), ("s", "too old", at(1))]
        spark.createDataFrame(rows, "session_id string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    progress = []
    out = spark.read.parquet(S.run_to_table(S.stream_clean(S.parquet_stream(spark, path, 1), "30 hours"), "t-clean-out", progress=progress)).collect()
    texts = sorted((r.text, r.ts.day) for r in out)
    assert [t for t in texts if t[0] == "every day"] == [("every day", 1), ("every day", 6)]
    assert [t for t in texts if t[0].startswith("line")] == [(f"line of day {d}", d) for d in range(1, 10)]
    assert [t for t in texts if t[0] == "too old"] == [("too old", 1)]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 8


def test_a_day_is_always_the_same_number_of_files(spark, tmp_path):
    path = str(tmp_path / "days")
    for n in (0, 2, 500):
        S.append_files(spark.range(n).withColumn("day", F.lit(n)), path, 4)
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) == 12 and back.count() == 502


def test_alert_state_sends_no_empty_frames():
    import pandas as pd

    class Held:
        rows, timers = [], []

        def getValueState(self, *_):
            return self

        getListState = getValueState

        def appendValue(self, row):
            self.rows.append(row)

        def registerTimer(self, t):
            self.timers.append(t)
    p = S.PreviousDashboard(24)
    p.init(Held())
    row = pd.DataFrame({"session_id": ["s"], "created_at": [pd.Timestamp("2024-01-01")], "overall_score": [1.0], "critical_pct": [2.0], "top_issue": [None]})
    assert list(p.handleInputRows((1,), iter([row]), None)) == []
    assert Held.rows == [("s", pd.Timestamp("2024-01-01").to_pydatetime(), 1.0, 2.0, None)] and len(Held.timers) == 1


def test_users_of_a_bucket_share_one_state(spark):
    """Many users with several dashboards a trigger: the alerts are those of the rule, with no more states than buckets."""
    import datetime as dt
    import random
    rnd, sent = random.Random(9), []
    path = S.scratch_path(spark, "t-alerts")
    issue = lambda r: None if r[4] % 3 == 0 else f"i{int(r[4] % 5)}"
    for trigger in range(4):
        rows = [(f"s{trigger}-{i}", rnd.choice([None, *range(40)]), "X", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(trigger * 150, trigger * 150 + 300)),
                 float(rnd.randrange(100)), 1.0, 1.0, float(rnd.randrange(40)), 5, "c") for i in range(80)]
        (analyses(spark, rows).withColumn("top_issue", F.expr("if(overall_score % 3 = 0, null, concat('i', cast(overall_score % 5 as int)))"))
         .coalesce(1).write.mode("append").parquet(path))
        sent += rows
    want = set()
    for r in sent:
        earlier = [o for o in sent if o[1] == r[1] and (o[3], o[0]) < (r[3], r[0])]
        before = max(earlier, key=lambda o: (o[3], o[0]), default=None)
        if r[3] > max(o[3] for o in sent) - dt.timedelta(hours=60):
            continue
        if r[7] > 20:
            want.add((r[1], r[0], "critical_spike", None))
        if before and r[3] - before[3] <= dt.timedelta(hours=100):
            if before[4] - r[4] > 10:
                want.add((r[1], r[0], "sentiment_drop", before[4] - r[4]))
            if issue(r) is not None and issue(r) != issue(before):
                want.add((r[1], r[0], "new_top_issue", None))
    progress = []
    out = spark.read.parquet(S.run_to_table(S.stream_alerts(S.parquet_stream(spark, path, 1), 100, "60 hours", buckets=8), "t-alerts-out", progress=progress)).collect()
    assert len(out) == len(want) and {(r.user_id, r.session_id, r.event, r["drop"]) for r in out} == want and len({w[2] for w in want}) == 3
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 8
