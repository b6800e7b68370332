"""Registered streaming queries (S1-S4): each runs its stream over every file available
now and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import benchmarks as B
from revlens.operators import clean as C
from revlens.plans.catalog import register
from revlens.plans.cleaning import LINES_SQL
from revlens.plans.derived import all_derived
from revlens.plans.histories import ALERTS_SQL, SQL as HIST_SQL
from revlens.plans.industry import ROLLUP_COLS, ROLLUP_SQL, SQL as IND_SQL
from revlens.session import cut_lineage
from revlens.sources.tables import read_table
from revlens.streaming import streams as S
from revlens.types import EMOTIONS

TTL_HOURS = 9000


def _events_path(sf_dir):
    return f"{sf_dir.rstrip('/')}/events.parquet"


S1_SQL = """WITH e AS (
  SELECT ts, CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('view', 'click') THEN 'neutral'
                  ELSE 'positive' END AS s FROM events),
d AS (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
         count(*) AS total, count_if(s = 'positive') AS positive_count, count_if(s = 'negative') AS negative_count,
         count_if(s = 'neutral') AS neutral_count FROM e GROUP BY 1, 2)
SELECT window_start, window_end, total, positive_count, negative_count, neutral_count,
       round_even(CAST(positive_count AS DOUBLE) / total * 100.0, 1) AS positive_pct,
       round_even(CAST(negative_count AS DOUBLE) / total * 100.0, 1) AS negative_pct,
       round_even(CAST(positive_count - negative_count AS DOUBLE) / total * 100.0 + 50.0, 1) AS overall_score
FROM d WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""


@register("s01_stream_dashboard", S1_SQL)
def s01(spark, sf_dir):
    ev = S.event_stream(spark, _events_path(sf_dir))
    out = S.run_to_table(S.stream_dashboard(ev), "dashboard")
    return spark.read.parquet(out)


def _event_reviews(ev):
    """Events as classified reviews: the event's type, value and user say what a classifier would."""
    emo = F.col("user_id") % 8
    return S.with_sentiment(ev).select(
        "ts", (F.col("user_id") % 4).alias("company_id"), F.col("event_type").alias("category"), "sentiment",
        F.when(F.col("value") > 60, "critical").when(F.col("value") > 20, "medium").otherwise("low").alias("urgency"),
        F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), (emo + 1).cast("int")).alias("emotion"),
        F.when(F.col("value") > 10, "high").otherwise("low").alias("confidence"))


def _breakdown_sql(windows: str, length: str) -> str:
    emotions = ", ".join(f"count_if(emotion = '{e}') AS emotion_{e}" for e in EMOTIONS)
    return f"""WITH e AS (
  SELECT ts, user_id % 4 AS company_id, event_type AS category,
         CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type IN ('view', 'click') THEN 'neutral' ELSE 'positive' END AS sentiment,
         CASE WHEN value > 60 THEN 'critical' WHEN value > 20 THEN 'medium' ELSE 'low' END AS urgency,
         {EMOTIONS!r}[user_id % 8 + 1] AS emotion, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS confidence
  FROM events),
x AS (SELECT *, unnest({windows}) AS window_start FROM e),
d AS (
  SELECT window_start, window_start + INTERVAL {length} AS window_end, company_id, category, count(*) AS total,
         count_if(sentiment = 'positive') AS sentiment_positive, count_if(sentiment = 'negative') AS sentiment_negative,
         count_if(sentiment = 'neutral') AS sentiment_neutral, count_if(urgency = 'critical') AS urgency_critical,
         count_if(urgency = 'medium') AS urgency_medium, count_if(urgency = 'low') AS urgency_low, {emotions},
         count_if(confidence = 'high') AS confidence_high, count_if(confidence = 'medium') AS confidence_medium,
         count_if(confidence = 'low') AS confidence_low
  FROM x GROUP BY 1, 2, 3, 4)
SELECT *, round_even(CAST(sentiment_positive AS DOUBLE) / total * 100.0, 1) AS positive_pct,
       round_even(CAST(urgency_critical AS DOUBLE) / total * 100.0, 1) AS critical_pct,
       round_even(CAST(sentiment_positive - sentiment_negative AS DOUBLE) / total * 100.0 + 50.0, 1) AS overall_score
FROM d WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""


def _breakdown(spark, sf_dir, **windows):
    ev = S.event_stream(spark, _events_path(sf_dir))
    return spark.read.parquet(S.run_to_table(S.stream_breakdown(_event_reviews(ev), ["company_id"], **windows), "breakdown"))


@register("s01_stream_breakdown", _breakdown_sql("[date_trunc('day', ts)]", "1 DAY"))
def s01b(spark, sf_dir):
    return _breakdown(spark, sf_dir)


@register("s01_stream_sliding", _breakdown_sql("[date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]", "2 DAY"))
def s01s(spark, sf_dir):
    return _breakdown(spark, sf_dir, window="2 days", slide="1 day")


@register("s04_stream_clean", "WITH " + LINES_SQL + " SELECT DISTINCT session_id, text FROM flagged WHERE NOT noise")
def s04(spark, sf_dir):
    docs = S.parquet_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    lines = C.lines_from_text(docs.select(F.col("source").alias("session_id"), F.col("doc_id").alias("row_ord"), "text"))
    return spark.read.parquet(S.run_to_table(S.stream_clean(lines.select("session_id", "text")), "clean"))


DAYS, KEEP_HOURS = 8, 30
LATE_ARRIVAL = "row_ord % 11 = 0 AND row_ord % 8 >= 2"


@register("s04_stream_clean_watermark", "WITH " + LINES_SQL + f"""
, days AS (SELECT DISTINCT session_id, text, row_ord % {DAYS} AS day FROM flagged WHERE NOT noise AND NOT ({LATE_ARRIVAL})),
firsts AS (SELECT session_id, text, min(day) AS day FROM days GROUP BY 1, 2)
SELECT session_id, text, CAST(day AS INTEGER) AS day FROM firsts
UNION ALL
SELECT d.session_id, d.text, CAST(min(d.day) AS INTEGER) FROM days d JOIN firsts f ON f.session_id = d.session_id AND f.text = d.text AND d.day >= f.day + 5
GROUP BY 1, 2""".replace("\n, days", ", days", 1))
def s04_watermark(spark, sf_dir):
    """Bounded state: a text is remembered for 30 hours of event time.

    Documents arrive in the same number of files every day.  The watermark of a day's batch is the day before less 30
    hours, so a text is forgotten with the batch four days after it and passes again from the
    fifth day on.  Some lines arrive five days late and are dropped.
    """
    docs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("row_ord"), "text")
    lines = C.lines_from_text(docs).withColumn("arrival", (F.col("row_ord") % DAYS).cast("int"))
    day = F.col("arrival") - F.when(F.expr(LATE_ARRIVAL), 5).otherwise(0)
    lines = lines.select("session_id", "text", F.expr("timestamp '2024-03-01 00:00:00'").alias("t0"), "arrival", day.alias("day")) \
        .select("session_id", "text", F.timestamp_add("DAY", "day", "t0").alias("ts"), "day", "arrival")
    path = S.scratch_path(spark, "daily-lines")
    sizes = docs.groupBy(F.col("row_ord") % DAYS).count().agg(F.count(F.lit(1)), F.min("count")).first()
    files = min(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes[1] // 64) if sizes[0] >= DAYS else 1
    files = max(files, 1)
    for d in range(DAYS):  # in the order of days
        S.append_files(lines.filter(F.col("arrival") == d), path, files)
    stream = S.parquet_stream(spark, path, max_files=files).drop("arrival")
    return spark.read.parquet(S.run_to_table(S.stream_clean(stream, f"{KEEP_HOURS} hours"), "clean-daily")).select("session_id", "text", "day")


def _dashboards(spark, sf_dir):
    _, dash, _ = all_derived(spark, sf_dir)
    return dash.select("session_id", "user_id", "industry", F.col("created_at").cast("timestamp").alias("created_at"),
                       *B.MEASURES, "critical_count", "top_category", "top_issue")


def _dashboard_files(spark, sf_dir):
    """Finished dashboards written as files, the input of the benchmark stream."""
    path = S.scratch_path(spark, "dashboards-in")
    _dashboards(spark, sf_dir).repartition(4, "user_id").write.parquet(path)
    return path


LATE_HOURS = 4812


@register("s02_stream_alerts", HIST_SQL + ", " + ALERTS_SQL + f"""
SELECT user_id, session_id, event, critical_pct, current_score, previous_score, drop, new_issue, previous_issue
FROM alerts WHERE (event = 'critical_spike' OR session_id IN (
  SELECT session_id FROM (
    SELECT session_id, created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, session_id) AS age FROM history)
  WHERE age <= INTERVAL {TTL_HOURS} HOUR))
  AND session_id IN (SELECT session_id FROM history WHERE created_at < (SELECT max(created_at) FROM history) - INTERVAL {LATE_HOURS} HOUR)""")
def s02(spark, sf_dir):
    """A file a half-year, some rows up to a half-year late and read with the next file.

    Sessions are a year apart or more: with TTL_HOURS some previous ones count and some are
    too old.  Dashboards of the last LATE_HOURS wait for the watermark and are not judged yet.
    """
    part = F.year("created_at") * 2 + F.floor((F.month("created_at") - 1) / 6)
    rows = cut_lineage(_dashboards(spark, sf_dir).withColumn("part", (part + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)).cast("int")))
    path = S.scratch_path(spark, "dashboards-in")
    low, high = rows.agg(F.min("part"), F.max("part")).first()
    for p in range(low, high + 1):
        rows.filter(F.col("part") == p).coalesce(1).write.mode("append").parquet(path)
    stream = S.parquet_stream(spark, path, max_files=1)
    return spark.read.parquet(S.run_to_table(S.stream_alerts(stream, TTL_HOURS, f"{LATE_HOURS} hours"), "alerts"))


@register("s03_stream_benchmarks", IND_SQL + ", " + ROLLUP_SQL + f" SELECT {ROLLUP_COLS} FROM bench")
def s03(spark, sf_dir):
    path = _dashboard_files(spark, sf_dir)
    src = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = S.scratch_path(spark, "bench-table")
    S.stream_benchmarks(src, table).awaitTermination()
    return S.read_benchmarks(spark, table)
