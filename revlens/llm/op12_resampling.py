"""Target-distribution importance resampling: draw documents in proportion to a target's feature odds.

Texts become words by one 256-byte table (lower-case A-Z, separators to blanks) and
``bytes.split``; a run of words is hashed by ``zlib.crc32``, each further word continuing from
the run's value so far (``crc32(b" " + word, value)`` is the hash of the joined run).  Features
fall into ``buckets`` buckets.  Counters per batch add up to bucket counts per partition, these
to the counts of the table; both tables are counted in full.

A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for its s of the S raw and t of the
T target features, B buckets.  A document's weight is the floored mean gain of its features, its
score the weight plus a Gumbel noise from a hash of its id, so the highest scores are a draw
without replacement in proportion to exp(weight / 1000).

Ranks need no global sort in one task: scores are whole numbers of a bounded range (below 10^5
values), so a histogram gives the least score drawn; only the candidates at or above it are
range-partitioned in order, and a partition's ranks follow those of the partitions before it.

Cases: null and empty texts have no feature, weight 0, and are never drawn unless
``min_words`` is 0; ties go to the smaller id, a null id last (its noise is that of an empty id),
repeated rows each count and each take a rank, in any order among themselves; an empty table
gives no rows, an empty target makes all weights follow the raw counts alone; long texts are
read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import byte_words, map_batches, written

BUCKETS = 10_000
HELD = 200_000  # distinct hashes a Counter may hold before it is added to the bucket counts


def run_hashes(words: list[bytes], longest: int) -> Iterator[list[int]]:
    """crc32 of every run of 1, 2, ... ``longest`` consecutive words joined by blanks, one list a length."""
    values = list(map(crc32, words))
    yield values
    for n in range(1, min(longest, len(words))):
        values = [crc32(b" " + w, v) for v, w in zip(values, words[n:])]
        yield values


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket (at most ``buckets`` rows reach the driver)."""
    def run(batches):
        total, seen = np.zeros(buckets, np.int64), Counter()

        def fold():
            if seen:
                at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()
        for b in batches:
            for text in b.column("text"):
                for values in run_hashes(byte_words(text.as_py()), longest):
                    seen.update(values)
                if len(seen) > HELD:
                    fold()
        fold()
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log odds of the target against the raw counts, per bucket."""
    size, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored thousandfold Gumbel noise from the first 32 bits of sha256(``seed:id``)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = len(gain)

    def run(b):
        ids, out = b.column("doc_id").to_pylist(), []
        for i, text in zip(ids, b.column("text")):
            words = byte_words(text.as_py())
            n, total = 0, 0
            for values in run_hashes(words, longest):
                n += len(values)
                total += int(gain[np.array(values, np.int64) % size].sum())
            weight = total // n if n else 0
            out.append((len(words), n, weight, weight + noise(i, seed)))
        if out:
            n_words, n, weight, score = zip(*out)
            yield {"doc_id": ids, "n_words": n_words, "n_features": n, "weight": weight, "score": score}

    return map_batches(rows, run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, longest: int = 1,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows not drawn.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    # a number per row, fixed by the write, orders and splits equal rows
    ready = written(scored(docs, gain, seed, longest, id_col, text_col).withColumn("place", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= min_words
    histogram = sorted(((r["score"], r["n"]) for r in ready.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in histogram) // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if draw <= 0:
        return ready.select(*columns, F.lit(None).cast("long").alias("rank"))
    least, upto = None, 0
    for score, n in histogram:
        least, upto = score, upto + n
        if upto >= draw:
            break
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    ordered = ready.where(fit & (F.col("score") >= least)).repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts the rows of each sorted partition from 0, its upper bits number the partition
    ordered = written(ordered.select(*columns, F.monotonically_increasing_id().alias("at")), "ordered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:  # one row a partition
        starts.append((p, before))
        before += n
    offsets = docs.sparkSession.createDataFrame(starts, "part long, before long")
    ranked = (ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
              .withColumn("rank", F.col("before") + within + 1))
    drawn = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = ready.where(~fit | (F.col("score") < least)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
