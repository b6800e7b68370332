"""Review text preparation.

Lines carry ``session_id`` and an order key ``(row_ord, line_no)`` assigned at
the source, so "first" always means input order regardless of partitioning.
``clean_reviews`` tags every line with the stage that removed it and derives
the cleaned reviews, the per-session quality report and rejected sessions
from that one trace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.functions.exprs import dense_index
from revlens.operators.neardup import near_dedup
from revlens.session import cut_lineage
from revlens.types import BATCH_SIZE, MIN_REVIEW_LENGTH, MIN_REVIEWS, NEAR_DUP_THRESHOLD

KEYS = ["session_id"]
ORDER = ["row_ord", "line_no"]
LINE_BLOCK = 1024


def lines_from_text(df: DataFrame, text_col: str = "text", session_col: str = "session_id",
                    ord_col: str = "row_ord") -> DataFrame:
    """Split each cell on '\\n' only, strip, drop blank lines.

    A multi-line cell becomes several lines; order = (cell order, line position).
    """
    x = df.select(F.col(session_col).alias("session_id"), F.col(ord_col).cast("long").alias("row_ord"),
                  F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "raw"))
    return x.select("session_id", "row_ord", "line_no", X.ustrip("raw").alias("text")).filter(F.col("text") != "")


def limit_per_session(df: DataFrame, n: int | None = None) -> DataFrame:
    """A3: keep the first ``n`` rows of each session (None = no cap)."""
    if n is None:
        return df
    idx = dense_index(df, KEYS, ORDER, ["row_ord"], "_pos")
    return idx.filter(F.col("_pos") < n).drop("_pos")


def extract_reviews(df: DataFrame, column: str) -> DataFrame:
    """A5: drop nulls, cast to string, strip, drop '' and case-insensitive 'nan'."""
    t = X.ustrip(F.col(column).cast("string"))
    return df.withColumn(column, t).filter(F.col(column).isNotNull() & (F.col(column) != "")
                                           & (F.lower(F.col(column)) != "nan"))


def add_line_block(df: DataFrame) -> DataFrame:
    return df.withColumn("line_blk", F.floor(F.col("line_no") / LINE_BLOCK))


def text_digest(c) -> "F.Column":
    """SHA-256 of a text: 32 bytes that stand for it where only equality matters."""
    return F.unhex(F.sha2(F.col(c).cast("binary"), 256))


def prepared_text(c) -> "F.Column":
    """B1 then B2-B4."""
    return X.normalise(X.emoji_to_text(c))


def min_gate(lines: DataFrame, n: int = MIN_REVIEWS) -> DataFrame:
    """B11 (first gate): per-session input count and acceptance."""
    c = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("input_count"))
    return c.withColumn("accepted", F.col("input_count") >= n).withColumn(
        "error", F.when(~F.col("accepted"), F.format_string(
            f"too_few_lines: %d of {n}", F.col("input_count"))))


@dataclass
class Cleaned:
    trace: DataFrame      # every line with drop_reason (NULL = kept) and final review_id
    clean: DataFrame      # session_id, review_id, text  (accepted sessions only)
    report: DataFrame     # one row per accepted session
    rejected: DataFrame   # session_id, error


def clean_reviews(lines: DataFrame, near_threshold: float = NEAR_DUP_THRESHOLD, min_reviews: int = MIN_REVIEWS,
                  lo: int = MIN_REVIEW_LENGTH, hi: int | None = None) -> Cleaned:
    """The fixed stage order: gate, emoji, normalise, noise, exact, near (on full text), length, re-index, gate."""
    gate = min_gate(lines, min_reviews)
    ok = lines.join(gate.filter("accepted").select("session_id", "input_count"), "session_id")
    x = ok.withColumn("text", prepared_text("text")).withColumn("noise", X.is_noise("text"))
    x = cut_lineage(add_line_block(x))

    # B6 exact de-duplication: first occurrence of each exact text wins (aggregation, skew-safe)
    good = x.filter(~F.col("noise"))
    firsts = good.groupBy("session_id", text_digest("text").alias("digest")).agg(F.min(F.struct(*ORDER)).alias("o")) \
        .select("session_id", "o.row_ord", "o.line_no").withColumn("exact_first", F.lit(True))
    x = x.join(firsts, ["session_id", "row_ord", "line_no"], "left") \
        .withColumn("exact_dup", ~F.col("noise") & F.col("exact_first").isNull()).drop("exact_first")

    # B7/B8 near duplicates among the survivors, compared on full text
    surv = dense_index(x.filter(~F.col("noise") & ~F.col("exact_dup")), KEYS, ORDER, ["row_ord", "line_blk"], "idx")
    surv = cut_lineage(surv.select(*KEYS, *ORDER, "idx", X.comparison_key("text").alias("key")))
    near = near_dedup(surv.select("session_id", "idx", "key"), KEYS, near_threshold)
    x = x.join(surv.select("session_id", "row_ord", "line_no", "idx").join(near, ["session_id", "idx"]),
               ["session_id", "row_ord", "line_no"], "left")

    # B9 length rule on what is left
    cut = X.enforce_length("text", lo, hi)
    reason = (F.when(F.col("noise"), "noise").when(F.col("exact_dup"), "exact")
              .when(F.col("near_dup"), "near").when(cut.isNull(), "short"))
    x = cut_lineage(x.withColumn("drop_reason", reason)).withColumn("cut", cut)  # written without the shortened copy

    # B10 dense re-index of the kept lines
    kept = dense_index(x.filter(F.col("drop_reason").isNull()), KEYS, ORDER, ["row_ord", "line_blk"], "review_id")
    trace = x.join(kept.select("session_id", "row_ord", "line_no", "review_id"),
                   ["session_id", "row_ord", "line_no"], "left")

    # B12 report and B11 second gate
    rep = trace.groupBy("session_id").agg(
        F.first("input_count").alias("input_count"),
        F.count_if(F.col("drop_reason") == "noise").alias("noise_removed"),
        F.count_if(F.col("drop_reason") == "exact").alias("exact_duplicates_removed"),
        F.count_if(F.col("drop_reason") == "near").alias("near_duplicates_removed"),
        F.count_if(F.col("drop_reason") == "short").alias("short_removed"),
        F.count_if(F.col("drop_reason").isNull()).alias("final_count"))
    final_ok = F.col("final_count") >= min_reviews
    report = rep.filter(final_ok)
    late = rep.filter(~final_ok).select("session_id", F.format_string(
        f"too_few_after_cleaning: %d of {min_reviews}", F.col("final_count")).alias("error"))
    rejected = gate.filter(~F.col("accepted")).select("session_id", "error").unionByName(late)
    clean = trace.filter(F.col("review_id").isNotNull()).join(report.select("session_id"), "session_id", "left_semi") \
        .select("session_id", "review_id", F.col("cut").alias("text"), "row_ord", "line_no")
    return Cleaned(trace=trace, clean=clean, report=report, rejected=rejected)


def assign_batches(reviews: DataFrame, size: int = BATCH_SIZE, id_col: str = "review_id") -> DataFrame:
    """Consecutive reviews in batches of ``size`` (batch_no from 0, pos from 1)."""
    return reviews.withColumn("batch_no", F.floor(F.col(id_col) / size).cast("int")) \
        .withColumn("pos", (F.col(id_col) % size + 1).cast("int"))


def validate_profiles(profiles: DataFrame, lo: int = 2, hi: int = 8) -> DataFrame:
    """Trim fields; categories trimmed, blanks removed; 2..8 categories required."""
    cats = F.filter(F.transform("categories", lambda c: X.ustrip(c)), lambda c: c != "")
    p = profiles.withColumn("categories", cats)
    for c in ["company_name", "industry", "description", "urgency_definition"]:
        if c in profiles.columns:
            p = p.withColumn(c, F.coalesce(X.ustrip(F.col(c)), F.lit("")))
    n = F.size("categories")
    return p.withColumn("valid", (n >= lo) & (n <= hi)).withColumn(
        "error", F.when(n < lo, F.lit(f"too_few_categories: minimum {lo}"))
        .when(n > hi, F.lit(f"too_many_categories: maximum {hi}")))


def overlapping_categories(profiles: DataFrame, denom: str = "max", threshold: float = 0.6,
                           key: str = "user_id") -> DataFrame:
    """Pairs of categories (i < j) within one profile whose word sets overlap >= 0.6.

    A pair needs at least one shared word to pass, so pairs are generated by an
    equi-join on (profile, word), never as all pairs of a profile.
    """
    c = profiles.select(key, F.posexplode("categories").alias("i", "cat")).withColumn("ws", X.word_set("cat"))
    sizes = c.select(key, "i", "cat", F.size("ws").alias("n"))
    words = c.select(key, "i", F.explode("ws").alias("w"))
    a, b = words.alias("a"), words.alias("b")
    shared = (a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.w") == F.col("b.w"))
                     & (F.col("a.i") < F.col("b.i")))
              .groupBy(F.col(f"a.{key}").alias(key), F.col("a.i").alias("i"), F.col("b.i").alias("j"))
              .agg(F.count(F.lit(1)).alias("inter")))
    sa = sizes.select(key, "i", F.col("cat").alias("category_a"), F.col("n").alias("na"))
    sb = sizes.select(key, F.col("i").alias("j"), F.col("cat").alias("category_b"), F.col("n").alias("nb"))
    j = shared.join(sa, [key, "i"]).join(sb, [key, "j"])
    d = (F.greatest if denom == "max" else F.least)(F.col("na"), F.col("nb"))
    ratio = F.col("inter").cast("double") / d
    return j.filter(ratio >= threshold).select(key, "i", "j", "category_a", "category_b",
                                               F.bround(ratio, 4).alias("overlap"))
