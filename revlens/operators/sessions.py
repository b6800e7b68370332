"""Session and history tables.

Sessions and per-user history are tables, not files: expiry is a filter with
``now`` as a parameter, history keeps the newest ``n`` entries per user, and
an upsert is one full outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.exprs import first_n_per_group, ranked
from revlens.functions.scan import segmented
from revlens.types import SESSION_TTL_HOURS


def history_from_dashboards(dash: DataFrame) -> DataFrame:
    """One history entry per finished session: score rounded to 1 place, display label."""
    created = F.col("created_at").cast("timestamp")
    return dash.select(
        "user_id", "session_id", created.alias("created_at"), "total_reviews",
        F.bround("overall_score", 1).alias("overall_score"),
        F.concat(F.lit("Analysis — "), F.date_format(created, "dd MMM yyyy")).alias("label"),
    )


def latest_history(history: DataFrame, n: int | None = None) -> DataFrame:
    """Entries per user, newest first (``pos`` 1); the newest ``n`` where a caller asks for that."""
    if n is None:
        return segmented(history, ["user_id"], ["created_at", "session_id"], position="pos", descending=True)
    return first_n_per_group(history, ["user_id"], [F.col("created_at").desc(), F.col("session_id").desc()], n, "pos")


def _as_ts(c: Column, is_string: bool) -> Column:
    return F.try_to_timestamp(c) if is_string else c.cast("timestamp")


def live_sessions(sessions: DataFrame, now, ttl_hours: float | None = SESSION_TTL_HOURS,
                  ts_col: str = "last_updated") -> DataFrame:
    """A10: keep sessions updated within ``ttl_hours`` of ``now``; unparseable stamps are expired."""
    if ttl_hours is None:
        return sessions
    is_string = dict(sessions.dtypes)[ts_col] == "string"
    ts = _as_ts(F.col(ts_col), is_string)
    now_c = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    age_s = now_c.cast("double") - ts.cast("double")
    return sessions.filter(ts.isNotNull() & (age_s <= F.lit(float(ttl_hours) * 3600.0)))


def upsert_sessions(old: DataFrame, new: DataFrame, now, key: str = "session_id") -> DataFrame:
    """Merge ``new`` fields over ``old`` rows (new wins when not null); stamp ``last_updated``."""
    cols = [c for c in old.columns if c != key]
    extra = [c for c in new.columns if c not in old.columns and c != key]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    now_c = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    out = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in cols:
        if c == "last_updated":
            continue
        if c in new.columns:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    out += [F.col(f"n.{c}").alias(c) for c in extra]
    out.append(F.when(F.col(f"n.{key}").isNotNull(), now_c)
               .otherwise(F.col("o.last_updated").cast("timestamp")).alias("last_updated"))
    return j.select(*out)


def user_totals(history: DataFrame) -> DataFrame:
    """Sessions and reviews per user."""
    return history.groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"),
                                          F.sum("total_reviews").alias("total_reviews"))


def report_rows(results: DataFrame, n: int | None = None, cut: int | None = None) -> DataFrame:
    """Numbered rows of each session's results, total row count and an example.

    ``n`` keeps the first rows of a session only, ``cut`` shortens the example.
    """
    totals = results.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_rows"))
    order = [F.col("review_id").asc()]
    first = (ranked(results, ["session_id"], order, "row_no") if n is None
             else first_n_per_group(results, ["session_id"], order, n, "row_no"))
    short = F.col("core_issue") if cut is None else F.when(
        F.length("core_issue") > cut, F.concat(F.substring("core_issue", 1, cut), F.lit("…"))).otherwise(F.col("core_issue"))
    return first.join(totals, "session_id").select(
        "session_id", "row_no", "review_id", "sentiment", "primary_category", "urgency",
        short.alias("example"), "total_rows")
