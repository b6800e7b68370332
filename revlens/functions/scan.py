"""Segmented scan: running sums, positions, totals and the row before, in the order of a group.

A window over a group of any size would order it in one task.  Here rows are range-partitioned
by (group, order), so a large group lies in several *pieces*, each in one task; a window per
piece gives the local values, and what a piece's rows lack is the sum, count or last row of
the pieces before it.  Only the first group of a piece can have begun in an earlier one, so
these carries are at most one row a piece and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import cut_lineage


def _same(keys: list, prefix: str) -> Column:
    """Group columns equal those with ``prefix``; null equals null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond


def segmented(rows: DataFrame, keys: list, order: list, sums: dict[str, Column] | None = None, position: str | None = None,
              total: str | None = None, before: dict[str, str] | None = None, descending: bool = False, pieces: int | None = None) -> DataFrame:
    """``rows`` with columns computed in ``order`` (``descending`` turns all of it) within each group of ``keys``.

    ``sums``: new column -> number to sum up to and with the row; ``position``: name of the
    position from 1; ``total``: name of the group's row count; ``before``: new column -> column
    of the row before, null for the first.  ``order`` must decide between a group's rows.
    ``pieces`` sets the number of pieces, by default Spark's shuffle partitions.
    """
    sums, before = sums or {}, before or {}
    way = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    by = [*[F.col(k) for k in keys], *way]
    held = rows.withColumns({f"_s_{n}": c for n, c in sums.items()})
    held = held.repartitionByRange(*([pieces] if pieces else []), *by).withColumn("_piece", F.spark_partition_id())
    held = cut_lineage(held)

    w = Window.partitionBy("_piece", *keys).orderBy(*way)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_s_{n}": F.sum(f"_s_{n}").over(upto) for n in sums}
    if position:
        local["_pos"] = F.row_number().over(w)
    if total:
        local["_n"] = F.count(F.lit(1)).over(Window.partitionBy("_piece", *keys))
    if before:
        local["_row"] = F.lag(F.struct(*before.values())).over(w)

    # groups at the ends of a piece, the only ones that can lie in two; their rows per piece
    group = F.struct(*keys)
    ends = held.groupBy("_piece").agg(F.min(group).alias("a"), F.max(group).alias("z"))
    ends = ends.select("_piece", F.explode(F.array_distinct(F.array("a", "z"))).alias("g")).select(
        F.col("_piece").alias("_ep"), *[F.col(f"g.{k}").alias(f"_e{k}") for k in keys])
    at_end = held.join(F.broadcast(ends), (F.col("_piece") == F.col("_ep")) & _same(keys, "_e"))  # at most two rows a piece
    pick = F.max_by if not descending else F.min_by
    parts = at_end.groupBy("_piece", *keys).agg(
        F.count(F.lit(1)).alias("_pn"), *[F.sum(f"_s_{n}").alias(f"_p_{n}") for n in sums],
        *([pick(F.struct(*before.values()), F.struct(*[F.col(c) for c in order])).alias("_last")] if before else []))
    pw = Window.partitionBy(*keys).orderBy("_piece")
    past = pw.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    carry = parts.select(
        F.col("_piece").alias("_cp"), *[F.col(k).alias(f"_c{k}") for k in keys], F.coalesce(F.sum("_pn").over(past), F.lit(0)).alias("_cn"),
        F.sum("_pn").over(every).alias("_ct"), *[F.coalesce(F.sum(f"_p_{n}").over(past), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *([F.lag("_last").over(pw).alias("_cl")] if before else []), F.count(F.lit(1)).over(every).alias("_cs")).where("_cs > 1").drop("_cs")

    out = held.withColumns(local).join(F.broadcast(carry), (F.col("_piece") == F.col("_cp")) & _same(keys, "_c"), "left")
    new = [(F.col(f"_s_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums]
    if position:
        new.append((F.col("_pos") + F.coalesce("_cn", F.lit(0))).cast("int").alias(position))
    if total:
        new.append(F.coalesce("_ct", "_n").alias(total))
    prior = F.coalesce("_row", "_cl") if before else None
    new += [prior[c].alias(n) for n, c in before.items()]
    return out.select(*rows.columns, *new)
