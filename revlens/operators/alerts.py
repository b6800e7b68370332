"""Alert rules (G1-G6) evaluated for every analysis of every user.

The previous analysis is the entry just before the current one in the
user's history (``lag``); if that session is not finished/live there is no
previous, and the two comparison rules are skipped (no search further back).
All three rules are evaluated in one pass: an array of optional event
structs per session, exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.scan import segmented
from revlens.types import ALERT_EVENTS, CRITICAL_SPIKE_PCT, SENTIMENT_DROP_POINTS

_EVENT = "struct<event:string,critical_count:bigint,critical_pct:double,threshold:double," \
         "current_score:double,previous_score:double,drop:double,new_issue:string,previous_issue:string>"


def _event(name: str, **fields) -> Column:
    cols = {"critical_count": F.lit(None).cast("bigint"), "critical_pct": F.lit(None).cast("double"),
            "threshold": F.lit(None).cast("double"), "current_score": F.lit(None).cast("double"),
            "previous_score": F.lit(None).cast("double"), "drop": F.lit(None).cast("double"),
            "new_issue": F.lit(None).cast("string"), "previous_issue": F.lit(None).cast("string")}
    cols.update(fields)
    return F.struct(F.lit(name).alias("event"), *[v.alias(k) for k, v in cols.items()])


def alerts(history: DataFrame, dashboards: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """One row per triggered event.

    ``dashboards`` needs session_id, critical_count, critical_pct, overall_score, top_issue.
    """
    h = segmented(history.select("user_id", "session_id", "created_at"), ["user_id"], ["created_at", "session_id"],
                  before={"prev_session_id": "session_id"}).drop("created_at")
    d = dashboards.select("session_id", "critical_count", "critical_pct", "overall_score", "top_issue")
    prev = d if live is None else d.join(live.select("session_id"), "session_id", "left_semi")
    prev = prev.select(F.col("session_id").alias("prev_session_id"),
                       F.col("overall_score").alias("prev_score"), F.col("top_issue").alias("prev_top_issue"),
                       F.lit(True).alias("has_prev"))
    cur = h.join(d, "session_id").join(prev, "prev_session_id", "left")
    has_prev = F.coalesce(F.col("has_prev"), F.lit(False))
    drop = F.col("prev_score") - F.col("overall_score")
    spike = F.when(F.col("critical_pct") > CRITICAL_SPIKE_PCT,
                   _event("critical_spike", critical_count=F.col("critical_count"),
                          critical_pct=F.col("critical_pct"), threshold=F.lit(CRITICAL_SPIKE_PCT)))
    sdrop = F.when(has_prev & (drop > SENTIMENT_DROP_POINTS),
                   _event("sentiment_drop", current_score=F.col("overall_score"),
                          previous_score=F.col("prev_score"), drop=F.bround(drop, 2)))
    newtop = F.when(has_prev & F.col("top_issue").isNotNull() & ~F.col("top_issue").eqNullSafe(F.col("prev_top_issue")),
                    _event("new_top_issue", new_issue=F.col("top_issue"), previous_issue=F.col("prev_top_issue")))
    events = F.filter(F.array(spike, sdrop, newtop), lambda x: x.isNotNull())
    return (cur.select("user_id", "session_id", F.explode(events).alias("e"))
               .select("user_id", "session_id", "e.*"))


def critical_spike(dashboards: DataFrame) -> DataFrame:
    """G1 alone: sessions whose critical share is above the threshold."""
    return dashboards.filter(F.col("critical_pct") > CRITICAL_SPIKE_PCT) \
        .select("session_id", "critical_count", "critical_pct", F.lit(CRITICAL_SPIKE_PCT).alias("threshold"))


def subscriptions_from_customers(customer: DataFrame) -> DataFrame:
    """Alert subscriptions derived from the customer table (one per customer).

    Segment decides which events are subscribed, the sign of the balance
    whether the subscription is active, and the nation whether the URL uses
    https (only https deliveries are allowed).
    """
    seg = F.col("c_mktsegment")
    events = (F.when(seg == "AUTOMOBILE", F.array(*[F.lit(e) for e in ALERT_EVENTS]))
              .when(seg == "BUILDING", F.array(F.lit("critical_spike")))
              .when(seg == "FURNITURE", F.array(F.lit("sentiment_drop"), F.lit("new_top_issue")))
              .when(seg == "MACHINERY", F.array(F.lit("new_top_issue"), F.lit("unknown_event")))
              .otherwise(F.array(F.lit("critical_spike"), F.lit("sentiment_drop"))))
    scheme = F.when(F.col("c_nationkey") == 0, F.lit("http://")).otherwise(F.lit("https://"))
    return customer.select(F.col("c_custkey").alias("user_id"),
                           F.concat(scheme, F.lit("hooks.example.org/"), F.col("c_custkey").cast("string")).alias("url"),
                           events.alias("events"), (F.col("c_acctbal") >= 0).alias("active"))


def match_subscriptions(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Active https subscriptions that list the event (valid names only)."""
    s = subs.filter(F.col("active") & F.col("url").startswith("https://"))
    j = events.join(s, "user_id")
    return j.filter(F.col("event").isin(*ALERT_EVENTS) & F.array_contains("events", F.col("event"))).drop("events", "active")


def alert_outbox(matched: DataFrame, profiles: DataFrame, now) -> DataFrame:
    """Delivery records (version, event, time, session, company, industry, JSON data)."""
    data = F.to_json(F.struct("critical_count", "critical_pct", "threshold", "current_score",
                              "previous_score", "drop", "new_issue", "previous_issue"))
    now_c = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    return matched.join(profiles.select("user_id", "company_name", "industry"), "user_id", "left").select(
        F.lit("1.0").alias("version"), "event", now_c.alias("triggered_at"), "session_id", "user_id",
        "company_name", "industry", "url", data.alias("data"))
