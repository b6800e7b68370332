"""Column expressions shared by the operators (all JVM-side, code-generated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Python's str.isspace() set, expressed for Java regex (Java's \s is ASCII only).
PY_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same characters one by one, for the trim functions.
PY_SPACES = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Values of a block's first column that ``dense_index`` sums up together.
COARSE = 4096
# Python's \w for str patterns: letters, digits and underscore in Unicode.
PY_WORD = r"[\p{L}\p{N}_]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(count, total) -> Column:
    """round(count / total * 100, 1) with Python's half-even rounding; 0 when total is 0."""
    count, total = col_(count), col_(total)
    return F.when(total > 0, F.bround(count.cast("double") / total.cast("double") * F.lit(100.0), 1)) \
        .otherwise(F.lit(0.0))


def ustrip(c) -> Column:
    """str.strip(): remove leading and trailing Unicode whitespace (Spark trim alone only removes spaces)."""
    return F.btrim(col_(c), F.lit(PY_SPACES))


def strip_fences(c) -> Column:
    """Strip, drop a leading ``` / ```json fence and a trailing ``` fence, strip."""
    t = ustrip(c)
    fence, named = F.lit("```"), F.lit("```json")
    t = (F.when(F.startswith(t, named), F.ltrim(F.substr(t, F.lit(8)), F.lit(PY_SPACES)))
         .when(F.startswith(t, fence), F.ltrim(F.substr(t, F.lit(4)), F.lit(PY_SPACES))).otherwise(t))
    return F.when(F.endswith(t, fence), F.rtrim(F.substr(t, F.lit(1), F.char_length(t) - 3), F.lit(PY_SPACES))).otherwise(t)


def first_n_per_group(df: DataFrame, keys: list, order: list, n: int, rank_col: str = "rank") -> DataFrame:
    """Exact first ``n`` rows of each group in ``order``.

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so a hot group ships at most ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def ranked(df: DataFrame, keys: list, order: list, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w))


def dense_index(df: DataFrame, keys: list, order: list, block: list, out: str = "idx") -> DataFrame:
    """0-based position (long) of each row within its group, in ``order``.

    ``block`` is a prefix of ``order`` whose groups are bounded in size (e.g.
    document id and a line block); its first column is an integer.  Rows are
    counted per block, blocks summed per range of COARSE values of that column, so
    of a hot group one task orders the ranges' sums, others a range's blocks,
    others a block's rows.
    """
    coarse = F.floor(F.col(block[0]) / COARSE)
    blocks = df.groupBy(*keys, *block).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", coarse)
    before = (Window.unboundedPreceding, -1)
    ranges = blocks.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
    ranges = ranges.withColumn("_roff", F.coalesce(F.sum("_rn").over(
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(*before)), F.lit(0))).drop("_rn")
    inside = Window.partitionBy(*keys, "_range").orderBy(*block).rowsBetween(*before)
    offsets = (blocks.withColumn("_off", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
               .join(ranges, [*keys, "_range"]).withColumn("_off", F.col("_off") + F.col("_roff")).drop("_range", "_roff"))
    w2 = Window.partitionBy(*keys, *block).orderBy(*order)
    return (df.join(offsets, keys + block)
              .withColumn(out, (F.col("_off") + F.row_number().over(w2) - 1).cast("long"))
              .drop("_off"))
