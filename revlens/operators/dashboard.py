"""Per-session dashboard aggregates.

Input is the fact table of classified reviews (``revlens.types.FACT_COLUMNS``).
Percentages are ``round(count / total * 100, 1)`` (half-even) over all rows of
the session.  The wide per-session aggregate is one hash aggregation with
map-side partial combine, so a session holding a third of all rows costs no
more than any other key; the long tables aggregate on (session, key) first
and rank the small aggregated result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.exprs import first_n_per_group, pct, ranked
from revlens.types import NO_SECONDARY

SESSION_KEYS = ["session_id"]


def _counts(df: DataFrame, keys=None, *more) -> DataFrame:
    """All per-session counters (and ``more``) in one aggregation."""
    keys = keys or SESSION_KEYS
    s, u, c = F.col("sentiment"), F.col("urgency"), F.col("confidence")
    sec = F.coalesce(F.col("secondary_category"), F.lit(NO_SECONDARY))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(s == "positive").alias("positive_count"),
        F.count_if(s == "negative").alias("negative_count"),
        F.count_if(s == "neutral").alias("neutral_count"),
        F.count_if(u == "critical").alias("critical_count"),
        F.count_if(u == "medium").alias("medium_count"),
        F.count_if(u == "low").alias("low_count"),
        F.count_if(c == "high").alias("high_confidence_count"),
        F.count_if(c == "medium").alias("medium_confidence_count"),
        F.count_if(c == "low").alias("low_confidence_count"),
        F.count_if(sec != NO_SECONDARY).alias("multi_aspect_count"), *more,
    )


def _overall_score(pos, neg, total):
    return F.when(F.col(total) > 0,
                  F.bround((F.col(pos) - F.col(neg)).cast("double") / F.col(total).cast("double")
                           * F.lit(100.0) + F.lit(50.0), 1)).otherwise(F.lit(0.0))


def sentiment_breakdown(df: DataFrame, keys=None) -> DataFrame:
    """Counts, percentages and overall score (-50..150)."""
    keys = keys or SESSION_KEYS
    t = _counts(df, keys)
    return t.select(
        *keys, "total_reviews", "positive_count", "negative_count", "neutral_count",
        pct("positive_count", "total_reviews").alias("positive_pct"),
        pct("negative_count", "total_reviews").alias("negative_pct"),
        pct("neutral_count", "total_reviews").alias("neutral_pct"),
        _overall_score("positive_count", "negative_count", "total_reviews").alias("overall_score"),
    )


def _known(df: DataFrame, keys: list) -> DataFrame:
    """Rows without a null in ``keys``."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def _value_breakdown(df: DataFrame, column: str, name: str, keys=None) -> DataFrame:
    """Volume and share of each value of ``column``; rank = count desc, first seen first."""
    keys = keys or SESSION_KEYS
    per_value = (_known(df, keys).groupBy(*keys, F.col(column).alias(name))
                 .agg(F.count(F.lit(1)).alias("count"), F.min("review_id").alias("first_id")))
    # rows without a value count for the total alone
    out = per_value.withColumn("total", F.sum("count").over(Window.partitionBy(*keys))).filter(F.col(name).isNotNull())
    out = out.withColumn("pct", pct("count", "total"))
    out = ranked(out, keys, [F.col("count").desc(), F.col("first_id").asc()])
    return out.select(*keys, name, "count", "pct", "rank")


def category_breakdown(df: DataFrame, keys=None) -> DataFrame:
    """Category volume and share, ranked count desc (ties: first seen)."""
    return _value_breakdown(df, "primary_category", "category", keys)


def emotion_breakdown(df: DataFrame, keys=None) -> DataFrame:
    """Emotion volume and share."""
    return _value_breakdown(df, "emotion", "emotion", keys)


def urgency_breakdown(df: DataFrame, keys=None) -> DataFrame:
    """D3: urgency counts and critical share."""
    keys = keys or SESSION_KEYS
    return _counts(df, keys).select(
        *keys, "critical_count", "medium_count", "low_count",
        pct("critical_count", "total_reviews").alias("critical_pct"))


def urgency_shares(df: DataFrame, keys=None) -> DataFrame:
    """Urgency shares over critical+medium+low (the display denominator)."""
    keys = keys or SESSION_KEYS
    u = urgency_breakdown(df, keys)
    denom = F.col("critical_count") + F.col("medium_count") + F.col("low_count")
    return u.select(*keys,
                    pct("critical_count", denom).alias("critical_share"),
                    pct("medium_count", denom).alias("medium_share"),
                    pct("low_count", denom).alias("low_share"))


def urgency_matrix(df: DataFrame, keys=None) -> DataFrame:
    """Category x urgency cross-tab with fixed columns; rank = critical desc, category asc."""
    keys = keys or SESSION_KEYS
    u = F.col("urgency")
    m = (df.filter(F.col("primary_category").isNotNull() & u.isNotNull())
         .groupBy(*keys, F.col("primary_category").alias("category"))
         .agg(F.count_if(u == "critical").alias("critical"),
              F.count_if(u == "medium").alias("medium"),
              F.count_if(u == "low").alias("low")))
    return ranked(m, keys, [F.col("critical").desc(), F.col("category").asc()])


def multi_aspect_stats(df: DataFrame, keys=None) -> DataFrame:
    """Reviews with a secondary category vs. those without."""
    keys = keys or SESSION_KEYS
    t = _counts(df, keys)
    return t.select(*keys, "multi_aspect_count",
                    pct("multi_aspect_count", "total_reviews").alias("multi_aspect_pct"),
                    (F.col("total_reviews") - F.col("multi_aspect_count")).alias("single_aspect_count"))


def confidence_breakdown(df: DataFrame, keys=None) -> DataFrame:
    """Confidence counts and low-confidence share."""
    keys = keys or SESSION_KEYS
    t = _counts(df, keys)
    return t.select(*keys, F.col("high_confidence_count").alias("high_count"),
                    F.col("medium_confidence_count").alias("medium_count"),
                    F.col("low_confidence_count").alias("low_count"),
                    pct("low_confidence_count", "total_reviews").alias("low_pct"))


def top_issues(df: DataFrame, n: int | None = 5, keys=None) -> DataFrame:
    """Negative reviews per category; order critical desc, count desc, category asc.

    ``example`` is the first non-null core issue; ``example_list`` the first
    three core issues in review order (nulls kept, duplicates kept).  ``n`` None keeps all categories.
    """
    keys = keys or SESSION_KEYS
    neg = df.filter((F.col("sentiment") == "negative") & F.col("primary_category").isNotNull())
    gkeys = keys + ["category"]
    neg = neg.withColumn("category", F.col("primary_category"))
    agg = neg.groupBy(*gkeys).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("urgency") == "critical").alias("critical_count"),
        F.min_by("core_issue", F.when(F.col("core_issue").isNotNull(), F.col("review_id"))).alias("example"),
    )
    first3 = (first_n_per_group(neg, gkeys, [F.col("review_id").asc()], 3, "_k")
              .groupBy(*gkeys)
              .agg(F.array_sort(F.collect_list(F.struct("review_id", "core_issue"))).alias("_ex")))
    # every group has a first row; as a left join it is left out where nobody reads the list
    out = _known(agg, gkeys).join(first3, gkeys, "left").withColumn("example_list", F.transform("_ex", lambda x: x["core_issue"]))
    order = [F.col("critical_count").desc(), F.col("count").desc(), F.col("category").asc()]
    out = ranked(out, keys, order, "rank") if n is None else first_n_per_group(out, keys, order, n, "rank")
    return out.select(*keys, "rank", "category", "count", "critical_count", "example", "example_list")


def top_category(df: DataFrame, keys=None) -> DataFrame:
    """Most frequent primary category (ties: first seen); "—" for an empty session."""
    keys = keys or SESSION_KEYS
    cats = category_breakdown(df, keys).filter(F.col("rank") == 1).select(*keys, F.col("category").alias("top_category"))
    return df.select(*keys).distinct().join(cats, keys, "left") \
        .select(*keys, F.coalesce("top_category", F.lit(NO_SECONDARY)).alias("top_category"))


def health_score(d: DataFrame) -> DataFrame:
    """From positive_pct, critical_pct, low_pct -> 0..100 score and label."""
    raw = (F.col("positive_pct") * F.lit(0.5) + (F.lit(100.0) - F.col("critical_pct")) * F.lit(0.3)
           + (F.lit(100.0) - F.col("low_pct")) * F.lit(0.2))
    score = F.least(F.greatest(F.bround(raw, 0).cast("int"), F.lit(0)), F.lit(100))
    d = d.withColumn("health_score", score)
    return d.withColumn("health_label",
                        F.when(F.col("health_score") >= 75, "Strong")
                        .when(F.col("health_score") >= 50, "Mixed")
                        .when(F.col("health_score") >= 25, "Needs Attention")
                        .otherwise("Critical"))


def score_band(c) -> "F.Column":
    """Display band of an overall score (70 / 40)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 70, "Strong").when(c >= 40, "Mixed").otherwise("Concerning")


def dashboard(df: DataFrame, keys=None) -> DataFrame:
    """One wide row per session with every scalar of the dashboard.

    Long parts (categories, emotions, matrix, issues) stay separate tables:
    ``category_breakdown``, ``emotion_breakdown``, ``urgency_matrix``, ``top_issues``.
    """
    keys = keys or SESSION_KEYS
    # one pass over the fact: counters per (session, category); the session level sums that small table
    neg = F.col("sentiment") == "negative"
    per = _counts(df, [*keys, "primary_category"], F.min("review_id").alias("_first"), F.count_if(neg).alias("_neg"),
                  F.count_if(neg & (F.col("urgency") == "critical")).alias("_neg_critical"))
    named = F.col("primary_category").isNotNull()
    issue_order = F.when(named & (F.col("_neg") > 0), F.struct(-F.col("_neg_critical"), -F.col("_neg"), F.col("primary_category")))
    t = per.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in per.columns if c not in (*keys, "primary_category") and not c.startswith("_")],
        F.max_by("primary_category", F.when(named, F.struct(F.col("total_reviews"), -F.col("_first")))).alias("top_category"),
        F.min_by("primary_category", issue_order).alias("top_issue"), F.min_by("_neg_critical", issue_order).alias("top_issue_critical_count"))
    out = t.select(
        *keys, "total_reviews", "positive_count", "negative_count", "neutral_count",
        pct("positive_count", "total_reviews").alias("positive_pct"),
        pct("negative_count", "total_reviews").alias("negative_pct"),
        pct("neutral_count", "total_reviews").alias("neutral_pct"),
        _overall_score("positive_count", "negative_count", "total_reviews").alias("overall_score"),
        "critical_count", "medium_count", "low_count",
        pct("critical_count", "total_reviews").alias("critical_pct"),
        "multi_aspect_count",
        pct("multi_aspect_count", "total_reviews").alias("multi_aspect_pct"),
        (F.col("total_reviews") - F.col("multi_aspect_count")).alias("single_aspect_count"),
        "high_confidence_count", "medium_confidence_count", "low_confidence_count",
        pct("low_confidence_count", "total_reviews").alias("low_pct"),
        F.coalesce("top_category", F.lit(NO_SECONDARY)).alias("top_category"), "top_issue", "top_issue_critical_count")
    return health_score(out)


def top_k_per_session(long_df: DataFrame, k: int, keys=None) -> DataFrame:
    """Keep the first ``k`` ranked rows of a long dashboard table."""
    keys = keys or SESSION_KEYS
    return long_df.filter(F.col("rank") <= k)
