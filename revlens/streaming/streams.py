"""Structured Streaming forms of the dashboard, alert, benchmark and cleaning work.

Sources are file streams (parquet); event time is cast to TIMESTAMP before a
watermark.  Checkpoints and outputs live under the shared checkpoint folder
named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revlens.functions import text as X
from revlens.functions.exprs import pct
from revlens.operators import benchmarks as B
from revlens.session import checkpoint_dir, cut_lineage, path_exists
from revlens.types import (CONFIDENCES, CRITICAL_SPIKE_PCT, EMOTIONS, SENTIMENT_DROP_POINTS, SENTIMENTS, SESSION_TTL_HOURS,
                           URGENCIES)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def parquet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream; any path that Spark reads."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if _is_file(spark, path):  # a single file: stream its folder, filtered to that name
        path, _, name = path.rpartition("/")
        r = r.option("pathGlobFilter", name)
    return r.parquet(path)


def append_files(rows: DataFrame, path: str, files: int) -> None:
    """Add ``rows`` to a folder as exactly ``files`` files, empty ones where there are too few rows.

    A stream that reads ``files`` files a trigger then takes the rows of one call at a time.
    """
    spark = rows.sparkSession

    def held() -> int:
        return len(spark.read.schema(rows.schema).parquet(path).inputFiles()) if path_exists(spark, path) else 0
    target = held() + files
    (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    for _ in range(target - held()):
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events as a stream; ``ts`` cast from TIMESTAMP_NTZ to TIMESTAMP (UTC) for the watermark."""
    return parquet_stream(spark, path, max_files).withColumn("ts", F.col("ts").cast("timestamp"))


def with_sentiment(events: DataFrame) -> DataFrame:
    """Event type -> sentiment: error negative, view/click neutral, others positive."""
    et = F.col("event_type")
    return events.withColumn("sentiment", F.when(et == "error", "negative")
                             .when(et.isin("view", "click"), "neutral").otherwise("positive"))


def stream_dashboard(events: DataFrame, window: str = "1 day", slide: str | None = None,
                     watermark: str = "1 day") -> DataFrame:
    """Sentiment counters, shares and score per event-time window (append: closed windows only)."""
    e = with_sentiment(events).withWatermark("ts", watermark)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    s = F.col("sentiment")
    agg = e.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "positive").alias("positive_count"),
        F.count_if(s == "negative").alias("negative_count"), F.count_if(s == "neutral").alias("neutral_count"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total",
                      "positive_count", "negative_count", "neutral_count",
                      pct("positive_count", "total").alias("positive_pct"),
                      pct("negative_count", "total").alias("negative_pct"),
                      F.bround((F.col("positive_count") - F.col("negative_count")) / F.col("total") * 100.0 + 50.0, 1)
                      .alias("overall_score"))


def stream_breakdown(reviews: DataFrame, keys: list, window: str = "1 day", slide: str | None = None,
                     watermark: str = "1 day") -> DataFrame:
    """The dashboard's counters (D1-D5, D8) per key, category and event-time window; append, closed windows only.

    ``reviews``: ts, keys, sentiment, category, urgency, emotion, confidence.  One aggregation
    holds all counters, so summing its rows over categories gives the session-level ones.
    """
    e = reviews.withWatermark("ts", watermark)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counters = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in (
        ("sentiment", SENTIMENTS), ("urgency", URGENCIES), ("emotion", EMOTIONS), ("confidence", CONFIDENCES)) for v in values]
    agg = e.groupBy(w.alias("w"), *keys, "category").agg(F.count(F.lit(1)).alias("total"), *counters)
    n = [c for c in agg.columns if c not in ("w", "category", *keys)]
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "category", *n,
                      pct("sentiment_positive", "total").alias("positive_pct"), pct("urgency_critical", "total").alias("critical_pct"),
                      F.bround((F.col("sentiment_positive") - F.col("sentiment_negative")) / F.col("total") * 100.0 + 50.0, 1).alias("overall_score"))


def stream_clean(lines: DataFrame, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """B1-B5 on each line and exact de-duplication per session.

    ``lines``: session_id, text (and ``ts``).  With a watermark a text is remembered for that
    long, so the state stays bounded; without one, for the whole stream.
    """
    e = lines.withColumn("text", X.normalise(X.emoji_to_text("text")))
    e = e.filter(~X.is_noise("text"))
    if watermark is None:
        return e.dropDuplicates(["session_id", "text"])
    return e.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["session_id", "text"])


ALERT_OUT = ("user_id long, session_id string, event string, critical_pct double, current_score double, "
             "previous_score double, drop double, new_issue string, previous_issue string")
ALERT_NAMES = [c.split()[0] for c in ALERT_OUT.split(", ")]
ALERT_ROW = "session_id string, created_at timestamp, overall_score double, critical_pct double, top_issue string"


class PreviousDashboard(StatefulProcessor):
    """Per user: the last dashboard, and those that wait until the watermark has passed them.

    A dashboard sets an event-time timer at its own time.  When the timer fires, nothing
    earlier can arrive any more, so the waiting dashboards up to it are compared in the order
    of event time, however late or in whatever batch they came.  Another timer forgets the
    user ``ttl_hours`` after the last dashboard.  ``stream_alerts`` judges whole buckets of users instead.
    """

    def __init__(self, ttl_hours: float | None):
        self.ttl_ms = None if ttl_hours is None else int(ttl_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ALERT_ROW)
        self.waiting = handle.getListState("waiting", ALERT_ROW)

    @staticmethod
    def _ms(row) -> int:
        return int(pd.Timestamp(row[1]).timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for pdf in rows:
            for session, created, score, critical, issue in zip(*(pdf[c.split()[0]] for c in ALERT_ROW.split(", "))):
                row = (session, pd.Timestamp(created).to_pydatetime(), float(score), float(critical), issue if isinstance(issue, str) else None)
                self.waiting.appendValue(row)
                times.add(self._ms(row))
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (self._ms(r), r[0]))
        due = [r for r in held if self._ms(r) <= now]
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for row in due:
            out += self._events(key[0], row, before)
            before = row
        if due:
            self.waiting.put(held[len(due):]) if len(due) < len(held) else self.waiting.clear()
            self.last.update(before)
            if self.ttl_ms is not None:
                self.handle.registerTimer(self._ms(before) + self.ttl_ms + 1)
        elif before is not None and self.ttl_ms is not None and self._ms(before) + self.ttl_ms < now:
            self.last.clear()
        if out:  # a frame is an Arrow batch of its own
            yield pd.DataFrame(out, columns=ALERT_NAMES).astype(object)

    def _events(self, user, row, before) -> list[tuple]:
        session, _, score, critical, issue = row
        out = []
        if critical > CRITICAL_SPIKE_PCT:
            out.append((user, session, "critical_spike", critical, None, None, None, None, None))
        if before is None or (self.ttl_ms is not None and self._ms(row) - self._ms(before) > self.ttl_ms):
            return out
        if before[2] - score > SENTIMENT_DROP_POINTS:
            out.append((user, session, "sentiment_drop", None, score, before[2], round(before[2] - score, 2), None, None))
        if issue is not None and issue != before[4]:
            out.append((user, session, "new_top_issue", None, None, None, None, issue, before[4]))
        return out

    def close(self) -> None:
        pass


STATE_ROWS = pa.schema([("user", pa.string()), ("session_id", pa.string()), ("ms", pa.int64()), ("score", pa.float64()), ("critical", pa.float64()),
                        ("issue", pa.string()), ("done", pa.bool_())])
USERS_HELD = STATE_ROWS.names


def judge_users(rows: pd.DataFrame, now: int, ttl_ms: int | None) -> tuple[list[tuple], pd.DataFrame]:
    """G1-G3 for many users at once: the events, and the rows (USERS_HELD) to hold on.

    ``rows`` are the users' last judged dashboards (``done``) and those that wait, in the order
    of arrival; those up to ``now`` are judged, by user in the order of time and session.
    """
    user = pd.factorize(rows["user"], use_na_sentinel=False)[0]
    session = pd.factorize(rows["session_id"].fillna(""), sort=True)[0]
    order = np.lexsort((session, rows["ms"], ~rows["done"], user))  # stable
    rows, user = rows.iloc[order].reset_index(drop=True), user[order]
    ms, done = rows["ms"].to_numpy(), rows["done"].to_numpy()
    due = ~done & (ms <= now)
    known = np.append(False, user[1:] == user[:-1])[:len(user)]
    if ttl_ms is not None:
        known[1:] &= ms[1:] - ms[:-1] <= ttl_ms
    before = rows.shift(1)
    issue = rows["issue"].notna() & (before["issue"].isna() | (rows["issue"] != before["issue"]))
    spike, drop = due & (rows["critical"] > CRITICAL_SPIKE_PCT), due & known & (before["score"] - rows["score"] > SENTIMENT_DROP_POINTS)

    def names(at):
        return [(None if u is None else int(u), x) for u, x in zip(rows["user"][at], rows["session_id"][at])]

    out = [(*key, "critical_spike", critical, None, None, None, None, None) for key, critical in zip(names(spike), rows["critical"][spike].tolist())]
    out += [(*key, "sentiment_drop", None, score, last, round(last - score, 2), None, None)
            for key, score, last in zip(names(drop), rows["score"][drop].tolist(), before["score"][drop].tolist())]
    new = due & known & issue
    out += [(*key, "new_top_issue", None, None, None, None, now_, last if isinstance(last, str) else None)
            for key, now_, last in zip(names(new), rows["issue"][new], before["issue"][new])]
    # a user's last judged dashboard is followed by a waiting one or by another user
    judged = done | due
    last = judged & ~np.append(judged[1:] & (user[1:] == user[:-1]), False)[:len(user)]
    if ttl_ms is not None:
        last &= ms + ttl_ms >= now
    return out, rows.assign(done=judged)[last | ~judged]


def _judge_bucket(ttl_ms: int | None):
    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_pandas()] if state.exists else []
        parts += [f[USERS_HELD[:-1]].assign(done=False) for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).astype({"user": object, "session_id": object, "issue": object, "done": bool})
        if rows["ms"].isna().any():
            raise ValueError("a dashboard without a time")
        rows = rows.astype({"ms": np.int64}).where(lambda r: r.notna() | ~r.columns.isin(["user", "session_id", "issue"]), None)
        out, held = judge_users(rows, now, ttl_ms)
        if len(held):
            table = pa.Table.from_pandas(held, STATE_ROWS, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, STATE_ROWS) as w:
                w.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            # a state is called once the watermark has passed the time set, so that is just before what is due
            ends = (held["ms"] - 1).where(~held["done"], np.nan if ttl_ms is None else held["ms"] + (ttl_ms or 0))
            if ends.notna().any():
                state.setTimeoutTimestamp(max(int(ends.min()), now, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=ALERT_NAMES).astype(object)
    return run


def stream_alerts(dashboards: DataFrame, ttl_hours: float | None = SESSION_TTL_HOURS, late: str = "0 seconds", buckets: int = 512) -> DataFrame:
    """G1-G3 against the same user's previous dashboard, held as keyed state (state store: RocksDB).

    A dashboard is judged once the watermark, ``late`` behind the newest event time, has passed
    it; dashboards later than that are dropped.  A previous one older than ``ttl_hours`` does
    not count, and a user without a newer one is forgotten by then.  Of a user the state holds the
    last dashboard and those inside the watermark's delay.

    Users lie in ``buckets`` buckets; a bucket's users are judged together, one state and one call
    a trigger.  A task holds one bucket, so raise the number with the users; it may not change
    between runs of one stream.
    """
    rows = dashboards.withWatermark("created_at", late).select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), F.col("user_id").cast("long").cast("string").alias("user"), "session_id", "created_at",
                       F.unix_millis("created_at").alias("ms"), F.col("overall_score").cast("double").alias("score"),
                       F.col("critical_pct").cast("double").alias("critical"), F.col("top_issue").alias("issue"))
    ttl_ms = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    return rows.groupBy("bucket").applyInPandasWithState(_judge_bucket(ttl_ms), ALERT_OUT, "held binary", "append", "EventTimeTimeout")


ANALYSIS = ["session_id", "user_id", "industry", "created_at", *B.MEASURES, "top_category"]


def _overwrite_buckets(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` hold, and no others."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def add_analyses(batch: DataFrame, batch_id: int, table_path: str, buckets: int = 64) -> list[int]:
    """Merge one micro-batch into the table of sessions and its partial benchmarks; returns the buckets it touched.

    Sessions lie in ``buckets`` buckets by their user, the newest row of each by (created_at,
    batch).  A batch reads and rewrites only the buckets of its own users, then those buckets'
    partial benchmarks; what a re-sent session said before goes with its old row.  A repeated
    batch gives the same tables again.
    """
    spark = batch.sparkSession
    new = cut_lineage(batch.select(*ANALYSIS, F.lit(batch_id).cast("long").alias("batch"), F.expr(f"int(pmod(xxhash64(user_id), {buckets}))").alias("bucket")))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return touched
    rows = new
    if path_exists(spark, f"{table_path}/sessions"):
        rows = rows.unionByName(_sessions(spark, table_path).filter(F.col("bucket").isin(touched)))
    fields = [c for c in new.columns if c not in ("session_id", "bucket")]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "batch", *B.MEASURES))
    merged = cut_lineage(rows.groupBy("bucket", "session_id").agg(newest.alias("r")).select("bucket", "session_id", "r.*"))
    _overwrite_buckets(merged, f"{table_path}/sessions")
    companies, votes = B.partial_benchmarks(merged, ["bucket"])
    _overwrite_buckets(companies, f"{table_path}/companies")
    # a bucket whose sessions name no category must lose its old votes too: keep a row without one
    _overwrite_buckets(votes.unionByName(merged.select("bucket").distinct(), allowMissingColumns=True), f"{table_path}/votes")
    return touched


def _sessions(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(f"{table_path}/sessions").withColumn("bucket", F.col("bucket").cast("int"))


def read_analyses(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest row of every session, by (created_at, batch)."""
    return _sessions(spark, table_path).select(*ANALYSIS)


def read_benchmarks(spark: SparkSession, table_path: str) -> DataFrame:
    """The industry table (as ``benchmark_rollup`` over all sessions) from the buckets' partial benchmarks alone."""
    return B.combine_benchmarks(spark.read.parquet(f"{table_path}/companies"), spark.read.parquet(f"{table_path}/votes").filter("industry IS NOT NULL"))


def stream_benchmarks(analyses: DataFrame, table_path: str, trigger_available_now: bool = True, buckets: int = 64):
    """S3: merge each micro-batch of analyses into the bucketed table and its partial benchmarks.

    Returns the started query; ``read_benchmarks`` gives the industry table after any batch.
    """
    w = (analyses.writeStream.foreachBatch(lambda batch, i: add_analyses(batch, i, table_path, buckets) and None)
         .option("checkpointLocation", table_path + ".ckpt"))
    return (w.trigger(availableNow=True) if trigger_available_now else w).start()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", progress: list | None = None) -> str:
    """Run a stream over everything available now into a parquet folder; return the folder.

    State is kept in RocksDB on the executors' disks, so it is not bounded by their heap.
    ``progress`` receives the progress of each trigger.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # read when the query starts
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", out + ".ckpt").trigger(availableNow=True).start())
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return out
