"""Trends across each user's sessions (E1-E5), for every user in one job.

The series holds every history entry of a user, or the newest ``keep`` where a
caller asks for that; a user's points stay rows of the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.scan import segmented
from revlens.operators.sessions import latest_history


def session_series(history: DataFrame, dashboards: DataFrame, live: DataFrame | None = None,
                   keep: int | None = None) -> DataFrame:
    """History entries joined to finished (live) dashboards, ascending in time.

    ``overall_score`` comes from the history entry, percentages from the dashboard.
    Adds ``seq`` (1 = oldest) and ``n_sessions`` per user.
    """
    h = history if keep is None else latest_history(history, keep).drop("pos")
    if live is not None:
        h = h.join(live.select("session_id"), "session_id", "left_semi")
    d = dashboards.select("session_id", "positive_pct", "negative_pct", "neutral_pct",
                          "critical_count", "critical_pct", "top_category")
    return segmented(h.join(d, "session_id"), ["user_id"], ["created_at", "session_id"], position="seq", total="n_sessions")


def sentiment_trajectory(series: DataFrame) -> DataFrame:
    """first/last score, change rounded to 2 places, trend (strict +-5); the points are the series' rows."""
    agg = series.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.min_by("overall_score", "seq").alias("first_score"),
        F.max_by("overall_score", "seq").alias("last_score"),
    )
    change = F.bround(F.col("last_score") - F.col("first_score"), 2)
    enough = F.col("session_count") >= 2
    return agg.select(
        "user_id", "session_count", "first_score", "last_score",
        F.when(enough, change).otherwise(F.lit(0.0)).alias("change"),
        F.when(~enough, "insufficient_data").when(change > 5, "improving")
         .when(change < -5, "declining").otherwise("stable").alias("trend"),
    )


def _ends(series: DataFrame, which: str) -> DataFrame:
    multi = series.filter(F.col("n_sessions") >= 2)
    if which == "first":
        cond = F.col("seq") == 1
    elif which == "last":
        cond = F.col("seq") == F.col("n_sessions")
    else:  # previous
        cond = F.col("seq") == F.col("n_sessions") - 1
    return multi.filter(cond).select("user_id", "session_id")


def category_drift(series: DataFrame, categories: DataFrame) -> DataFrame:
    """First vs latest session category shares, one full outer join.

    ``categories`` is the D2 table (session_id, category, pct).
    """
    cat = categories.select("session_id", "category", "pct")
    first = _ends(series, "first").join(cat, "session_id").select("user_id", "category", F.col("pct").alias("first_pct"))
    last = _ends(series, "last").join(cat, "session_id").select("user_id", "category", F.col("pct").alias("latest_pct"))
    j = first.join(last, ["user_id", "category"], "full_outer")
    change = F.bround(F.col("latest_pct") - F.col("first_pct"), 2)
    status = (F.when(F.col("first_pct").isNull(), "new").when(F.col("latest_pct").isNull(), "dropped")
              .when(change > 5, "growing").when(change < -5, "shrinking").otherwise("stable"))
    return j.select("user_id", "category", "first_pct", "latest_pct",
                    F.when(F.col("first_pct").isNotNull() & F.col("latest_pct").isNotNull(), change).alias("change"),
                    status.alias("status"))


def emerging_issues(series: DataFrame, issues: DataFrame) -> DataFrame:
    """Previous vs latest session issues on critical count (missing = 0).

    ``issues`` is the uncut D7 table: a cut list would report what slipped off it as resolved.
    """
    iss = issues.select("session_id", "category", "critical_count")
    prev = _ends(series, "previous").join(iss, "session_id") \
        .select("user_id", "category", F.col("critical_count").alias("previous_critical"))
    last = _ends(series, "last").join(iss, "session_id") \
        .select("user_id", "category", F.col("critical_count").alias("current_critical"))
    j = prev.join(last, ["user_id", "category"], "full_outer").na.fill(0, ["previous_critical", "current_critical"])
    change = F.col("current_critical") - F.col("previous_critical")
    status = (F.when(change > 0, "emerging")
              .when((F.col("current_critical") == 0) & (F.col("previous_critical") > 0), "resolved")
              .otherwise("unchanged"))
    return j.select("user_id", "category", "previous_critical", "current_critical", change.alias("change"),
                    status.alias("status"))


def trends(series: DataFrame, drift: DataFrame, emerging: DataFrame) -> DataFrame:
    """E5: one row per user with availability, trajectory and counts of each drift/issue status."""
    traj = sentiment_trajectory(series)
    d = drift.groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}")
                                       for s in ["growing", "shrinking", "stable", "new", "dropped"]])
    e = emerging.groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}")
                                          for s in ["emerging", "resolved", "unchanged"]])
    out = traj.join(d, "user_id", "left").join(e, "user_id", "left")
    counts = ["n_growing", "n_shrinking", "n_stable", "n_new", "n_dropped", "n_emerging", "n_resolved", "n_unchanged"]
    out = out.na.fill(0, counts)
    return out.select("user_id", (F.col("session_count") >= 2).alias("available"), "session_count",
                      "trend", "change", *counts)
