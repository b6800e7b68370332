r"""Hard-negative mining by a GNAT-style multiway hyperplane tree.

Rows are whole-number vectors (floor(scale * x)); scores are inner products.  With one more
component sqrt(M^2 - |x|^2) every row has the length M (the longest row's), and for an anchor q
with a 0 there, the distance d has d^2 = |q|^2 + M^2 - 2 score: scores in a window are exactly
the rows in an annulus around the anchor, and the triangle inequality holds.

The tree: a node's rows go to the nearest of its split points; per split point it stores the
least and largest distance to the rows of every sibling subtree.  A subtree is left out when
for any split point its distance range, seen from the anchor's distance to that point, misses
the annulus.  The top level (``TOP`` split points from a sample of about ``SAMPLE`` rows) spans
the whole table: its subtrees, cut into blocks of about ``BLOCK`` rows, are shuffled to tasks
with just the anchors that need them, and the lower levels are built in the task.  Leaves are
compared exactly, so every row is indexed and recall is 1.

Search: an anchor's first positives in its own subtree give a least score; then the other
subtrees that may hold a better one.  The positives' windows (low * positive <= 100 * negative
<= high * positive) make the annuli of a second search over rows of other labels.  Windows close
in as they fill: a tile keeps the best few of each window, these meet in a window per anchor.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part;
vectors of another length never meet; ties go to the smaller id; the anchor's own id is never
its positive or negative; repeated rows each count, a repeated anchor or positive gives its rows
once; an id with several different rows asks with each; anchors without a positive, and
positives without a negative in the window, give no rows; an empty table gives none.  Scores
are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm.common import written

TOP, SAMPLE, BLOCK, CHUNK = 24, 1024, 8192, 2048
WAYS, LEAF = 12, 96
SLACK = 1e-6  # of the lengths: far above the rounding of distances
INF = float("inf")


# --- the tree of one block ----------------------------------------------------------

def far_points(d2, n: int, ways: int) -> list[int]:
    """Up to ``ways`` of ``n`` points, each the farthest from those before; ``d2(i)`` gives squared distances to point i."""
    chosen, least = [0], None
    while len(chosen) < min(ways, n):
        row = d2(chosen[-1])
        least = row if least is None else np.minimum(least, row)
        at = int(np.argmax(least))
        if least[at] <= 0:
            break
        chosen.append(at)
    return chosen


@dataclass
class Points:
    """Rows lifted to a common length; ``lift`` is the last component."""
    x: np.ndarray
    lift: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, m2: float) -> Points:
        return cls(x, np.sqrt(np.maximum(m2 - np.einsum("nd,nd->n", x, x), 0)))

    def take(self, at) -> Points:
        return Points(self.x[at], self.lift[at])

    def distances(self, to: Points, m2: float) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (m2 - self.x @ to.x.T - np.multiply.outer(self.lift, to.lift)), 0))


@dataclass
class Node:
    splits: Points
    low: np.ndarray   # low[i, j], high[i, j]: distances from split point i to the rows of child j
    high: np.ndarray
    children: list    # Node, or row numbers of a leaf


def split_ranges(dist: np.ndarray, child: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance from every split point to every child's rows (rows x split points)."""
    low, high = np.full((ways, ways), INF), np.full((ways, ways), -INF)
    for j in range(ways):
        on = dist[child == j]
        if len(on):
            low[:, j], high[:, j] = on.min(axis=0), on.max(axis=0)
    return low, high


def build(points: Points, at: np.ndarray, m2: float):
    """The subtree over rows ``at``; a leaf when they are few or cannot be told apart."""
    if len(at) <= LEAF:
        return at
    pool = points.take(at[:: max(1, len(at) // (4 * WAYS))][:8 * WAYS])
    chosen = far_points(lambda i: pool.distances(pool.take([i]), m2)[:, 0], len(pool.lift), WAYS)
    splits = pool.take(chosen)
    dist = points.take(at).distances(splits, m2)
    child = dist.argmin(axis=1)
    if np.bincount(child).max() == len(at):
        return at
    low, high = split_ranges(dist, child, len(chosen))
    return Node(splits, low, high, [build(points, at[child == j], m2) for j in range(len(chosen))])


def annulus(q2, m2: float, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the rows whose score lies in [low, high], widened by the slack."""
    slack = SLACK * np.sqrt(q2 + m2)
    near = np.where(np.isinf(high), 0.0, np.sqrt(np.maximum(q2 + m2 - 2 * np.where(np.isinf(high), 0, high), 0))) - slack
    far = np.where(np.isinf(low), INF, np.sqrt(np.maximum(q2 + m2 - 2 * np.where(np.isinf(low), 0, low), 0))) + slack
    return near, far


def meets(dq: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Windows x children: whether the child's distance ranges from all split points meet the annulus."""
    alive = np.broadcast_to(high[0] >= low[0], (len(dq), low.shape[1])).copy()
    for i in range(low.shape[0]):
        d = dq[:, i:i + 1]
        alive &= (d - high[i] <= far[:, None]) & (low[i] - d <= far[:, None]) & (d + high[i] >= near[:, None])
    return alive


class Search:
    """Best ``k`` rows of every window over one block."""

    def __init__(self, x, ids, labels, m2: float, k: int, same: bool):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids, self.labels = Points.of(x[order], m2), ids[order], labels[order]
        self.m2, self.k, self.same = m2, k, same
        self.root = build(self.points, np.arange(len(ids)), m2)

    def run(self, q, q_ids, q_labels, of, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, windows x k, of windows [low, high] of anchors ``of``; -inf where there is none."""
        self.q, self.q2, self.q_ids, self.q_labels = q, np.einsum("nd,nd->n", q, q), q_ids, q_labels
        self.of, self.low, self.high = of, low, high
        self.best = np.full((len(of), self.k), -INF)
        self.best_id = np.full((len(of), self.k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(of)))
        return self.best, self.best_id

    def _visit(self, node, on: np.ndarray) -> None:
        if not isinstance(node, Node):
            for a in range(0, len(node), 4 * LEAF):
                self._leaf(node[a:a + 4 * LEAF], on)
            return
        asks, back = np.unique(self.of[on], return_inverse=True)
        dq = np.sqrt(np.maximum(self.q2[asks][:, None] + self.m2 - 2 * (self.q[asks] @ node.splits.x.T), 0))
        for j in np.argsort(dq.mean(axis=0), kind="stable").tolist():  # the child nearest to most first: windows close in sooner
            near, far = annulus(self.q2[self.of[on]], self.m2, np.maximum(self.low[on], self.best[on, -1]), self.high[on])
            alive = meets(dq[back], node.low[:, [j]], node.high[:, [j]], near, far)[:, 0]
            if alive.any():
                self._visit(node.children[j], on[alive])

    def _leaf(self, rows: np.ndarray, on: np.ndarray) -> None:
        asks, back = np.unique(self.of[on], return_inverse=True)
        score = np.rint(self.q[asks] @ self.points.x[rows].T)
        fit = (self.q_labels[asks][:, None] == self.labels[rows]) == self.same
        fit &= self.q_ids[asks][:, None] != self.ids[rows]
        score = np.where(fit, score, -INF)[back]
        score[(score < np.maximum(self.low[on], self.best[on, -1])[:, None]) | (score > self.high[on][:, None])] = -INF
        hit = (score > -INF).any(axis=1)
        if not hit.any():
            return
        on, score = on[hit], score[hit]
        ids = np.concatenate([self.best_id[on], np.broadcast_to(self.ids[rows], score.shape)], axis=1)
        score = np.concatenate([self.best[on], score], axis=1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, by_id, 1), np.take_along_axis(score, by_id, 1)
        top = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
        self.best[on] = np.take_along_axis(score, top, 1)
        self.best_id[on] = np.where(self.best[on] > -INF, np.take_along_axis(ids, top, 1), np.iinfo(np.int64).max)


# --- the top level over the whole table -----------------------------------------------

@dataclass
class Top:
    """Top-level split points of one vector length with their distance ranges to the subtrees."""
    splits: Points
    m2: float
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length from an array column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.float64)


def _by_dim(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of a batch."""
    dims = np.array([len(v) for v in b.column(column)], np.int64)
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, _matrix(b.column(column).take(pa.array(at)), d)


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (vec_id, label, vector) that take part, components floor(scale * x), with length and squared norm."""
    ok = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('infinity') AND NOT isnan(x))"

    def run(batches):
        for b in batches:
            flat = b.column("vector")
            v = pa.ListArray.from_arrays(flat.offsets, pa.array(np.floor(scale * flat.values.to_numpy(zero_copy_only=False))))
            n2 = [float(np.dot(m, m)) for m in (x.values.to_numpy() for x in v)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v, pa.array([len(x) for x in v], pa.int32()), pa.array(n2, pa.float64())],
                                             names=["vec_id", "label", "v", "dim", "n2"])

    return rows.where(ok).mapInArrow(run, "vec_id long, label string, v array<double>, dim int, n2 double")


def top_level(rows: DataFrame) -> dict[int, Top]:
    """Split points per vector length from a bounded sample; lengths it lacks have none and are never left out."""
    sizes = {r["dim"]: (r["m2"], r["n"]) for r in rows.groupBy("dim").agg(F.max("n2").alias("m2"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n for _, n in sizes.values())
    share = int(1_000_000 * min(1.0, SAMPLE / max(total, 1)))
    sample: dict[int, list] = {}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < share).select("vec_id", "dim", "v").orderBy("vec_id", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for d, vs in sample.items():
        m2 = sizes[d][0]
        pool = Points.of(np.array(vs, np.float64).reshape(len(vs), d), m2)
        out[d] = Top(pool.take(far_points(lambda i: pool.distances(pool.take([i]), m2)[:, 0], len(vs), TOP)), m2)
    return out


def with_cells(rows: DataFrame, tops) -> DataFrame:
    """Rows with ``cell``, their nearest top-level split point (-1 for a length without any)."""
    def run(batches):
        for b in batches:
            cell = np.full(len(b), -1)
            for d, at, m in _by_dim(b, "v"):
                if d in tops.value:
                    t = tops.value[d]
                    cell[at] = Points.of(m, t.m2).distances(t.splits, t.m2).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    return rows.mapInArrow(run, "vec_id long, label string, v array<double>, dim int, n2 double, cell int")


def with_ranges(rows: DataFrame, tops: dict[int, Top], sent) -> dict[int, Top]:
    """Distance ranges of all split points to all subtrees, TOP^2 numbers a length."""
    def run(batches):
        held = {}
        for b in batches:
            cells = np.array(b.column("cell").to_pylist(), np.int64)
            for d, at, m in _by_dim(b, "v"):
                if d in sent.value:
                    t = sent.value[d]
                    n = len(t.splits.lift)
                    low, high = split_ranges(Points.of(m, t.m2).distances(t.splits, t.m2), cells[at], n)
                    old = held.get(d)
                    held[d] = (low, high) if old is None else (np.minimum(old[0], low), np.maximum(old[1], high))
        for d, (low, high) in held.items():
            i, j = np.divmod(np.arange(low.size), len(low))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(low.size, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(low.ravel()), pa.array(high.ravel())], names=["dim", "i", "j", "low", "high"])

    found = (rows.select("v", "cell").mapInArrow(run, "dim int, i int, j int, low double, high double")
             .groupBy("dim", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    for t in tops.values():
        n = len(t.splits.lift)
        t.low, t.high = np.full((n, n), INF), np.full((n, n), -INF)
    for r in found:
        tops[r["dim"]].low[r["i"], r["j"]], tops[r["dim"]].high[r["i"], r["j"]] = r["low"], r["high"]
    return tops


ASK = "vec_id long, tag long, label string, v array<double>, dim int, chunk long, own int, pos array<long>, low array<double>, high array<double>"


def routed(asks: DataFrame, sent) -> DataFrame:
    """Asks once per top-level subtree that some window of theirs meets, with ``cell``; empty subtrees are left out."""
    def run(batches):
        for b in batches:
            for d, at, m in _by_dim(b, "v"):
                part = b.take(pa.array(at))
                if d not in sent.value:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), -1), pa.int32())], names=[*part.schema.names, "cell"])
                    continue
                t = sent.value[d]
                q2 = np.einsum("nd,nd->n", m, m)
                dq = np.sqrt(np.maximum(q2[:, None] + t.m2 - 2 * (m @ t.splits.x.T), 0))
                of, low, high = _windows(part)
                need = np.zeros((len(at), len(t.splits.lift)), bool)
                np.logical_or.at(need, of, meets(dq[of], t.low, t.high, *annulus(q2[of], t.m2, low, high)))
                for j in range(need.shape[1]):
                    on = np.flatnonzero(need[:, j])
                    if len(on):
                        take = part.take(pa.array(on))
                        yield pa.RecordBatch.from_arrays([*take.columns, pa.array(np.full(len(on), j), pa.int32())], names=[*take.schema.names, "cell"])

    return asks.mapInArrow(run, ASK + ", cell int")


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask number, low, high) of every window of a batch of asks."""
    sizes = [len(x) for x in b.column("low")]
    return (np.repeat(np.arange(len(b)), sizes), b.column("low").flatten().to_numpy(zero_copy_only=False),
            b.column("high").flatten().to_numpy(zero_copy_only=False))


def search(rows: DataFrame, asks: DataFrame, fans: DataFrame, m2: dict[int, float], k: int, same: bool) -> DataFrame:
    """Best ``k`` per window and block: (vec_id, tag, pos, id, score).  ``asks`` are routed; each block meets its asks in chunks."""
    need = asks.select("dim", "cell", "chunk").distinct()
    tile = ["dim", "cell", "block", "chunk"]
    left = (rows.join(fans, ["dim", "cell"]).withColumn("block", F.expr("pmod(xxhash64(place), fan)")).join(need, ["dim", "cell"])
            .select(*tile, F.lit(0).alias("side"), "vec_id", F.lit(None).cast("long").alias("tag"), "label", "v",
                    F.lit(None).cast("array<long>").alias("pos"), *(F.lit(None).cast("array<double>").alias(c) for c in ("low", "high"))))
    right = (asks.join(fans, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)))
             .select(*tile, F.lit(1).alias("side"), "vec_id", "tag", "label", "v", "pos", "low", "high"))
    tiles = left.unionByName(right).repartition(*tile).sortWithinPartitions(*tile, "side")

    def finish(parts: list[pa.RecordBatch], dim: int) -> pa.RecordBatch | None:
        both = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        side = both.column("side").to_numpy()
        cut = int(np.searchsorted(side, 1))
        data, ask = both.slice(0, cut), both.slice(cut)
        if not len(data) or not len(ask):
            return None
        names: dict = {}
        labels = [np.array([names.setdefault(x, len(names)) for x in t.column("label").to_pylist()]) for t in (data, ask)]
        of, low, high = _windows(ask)
        q = _matrix(ask.column("v"), dim)
        found = Search(_matrix(data.column("v"), dim), data.column("vec_id").to_numpy(), labels[0], m2[dim], k, same)
        best, ids = found.run(q, ask.column("vec_id").to_numpy(), labels[1], of, low, high)
        w, r = np.nonzero(best > -INF)
        if not len(w):
            return None
        pos = ask.column("pos").flatten()
        return pa.RecordBatch.from_arrays([ask.column("vec_id").take(pa.array(of[w])), ask.column("tag").take(pa.array(of[w])), pos.take(pa.array(w)),
                                           pa.array(ids[w, r]), pa.array(np.clip(best[w, r], -9e18, 9e18).astype(np.int64))],
                                          names=["vec_id", "tag", "pos", "id", "score"])

    def run(batches):
        key, held = None, []
        for b in batches:
            if not len(b):
                continue
            heads = np.stack([b.column(c).to_numpy() for c in tile])
            starts = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
            for a, z in zip(starts, starts[1:]):
                own = tuple(heads[:, a].tolist())
                if own != key:
                    if held and (out := finish(held, key[0])) is not None:
                        yield out
                    key, held = own, []
                held.append(b.slice(a, z - a))
        if held and (out := finish(held, key[0])) is not None:
            yield out

    return tiles.mapInArrow(run, "vec_id long, tag long, pos long, id long, score long")


def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` per key over all blocks, with ``rank`` from 1 (partial limits before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("vector"))
    whole = whole_vectors(given, scale)
    tops = top_level(whole)
    sent = spark.sparkContext.broadcast(tops)  # TOP vectors a length
    rows = written(with_cells(whole, sent).withColumn("place", F.monotonically_increasing_id()), "gnat")
    sent = spark.sparkContext.broadcast(with_ranges(rows, tops, sent))
    counts = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("m2"))
    fans = counts.select("dim", "cell", F.ceil(F.col("n") / BLOCK).alias("fan"))
    m2: dict[int, float] = {}
    for r in counts.groupBy("dim").agg(F.max("m2").alias("m2")).collect():  # one row a vector length
        m2[r["dim"]] = r["m2"]

    anchors = (rows.where(is_anchor).withColumn("tag", F.xxhash64("label", "v"))
               .groupBy("vec_id", "tag").agg(*(F.first(c).alias(c) for c in ("label", "v", "dim", "cell"))))
    chunks = max(1, -(-anchors.count() // CHUNK))
    anchors = written(anchors.select("vec_id", "tag", "label", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"),
                                     F.col("cell").alias("own")), "anchors")
    none = F.array(F.lit(None).cast("long"))

    def window(at: Column) -> list[Column]:
        return [none.alias("pos"), F.array(at).alias("low"), F.array(F.lit(INF)).alias("high")]

    near = written(first(search(rows, anchors.select("*", *window(F.lit(-INF))).withColumn("cell", F.col("own")), fans, m2, positives, True),
                         ["vec_id", "tag"], positives), "near")
    least = near.where(F.col("rank") == positives).select("vec_id", "tag", F.col("score").cast("double").alias("least"))
    wider = (anchors.join(least, ["vec_id", "tag"], "left").select(*anchors.columns, *window(F.coalesce("least", F.lit(-INF)))))
    wider = written(routed(wider, sent).where("cell <> own"), "wider")
    found = near.drop("rank").unionByName(search(rows, wider, fans, m2, positives, True))
    best = first(found, ["vec_id", "tag"], positives).select("vec_id", "tag", F.col("id").alias("positive"), "score").distinct()
    best = (best.withColumn("lo", -_floor_div(-F.lit(low) * F.col("score"), 100)).withColumn("hi", _floor_div(F.lit(high) * F.col("score"), 100)))
    best = written(best.where("lo <= hi"), "positives")

    asks = (best.groupBy("vec_id", "tag").agg(F.sort_array(F.collect_list(F.struct("positive", "lo", "hi"))).alias("w"))  # at most ``positives`` each
            .join(anchors, ["vec_id", "tag"]).select(*anchors.columns, F.col("w.positive").alias("pos"),
                                                     F.col("w.lo").cast("array<double>").alias("low"), F.col("w.hi").cast("array<double>").alias("high")))
    asks = written(routed(asks, sent), "asks")
    hard = first(search(rows, asks, fans, m2, negatives, False), ["vec_id", "tag", "pos"], negatives)
    scores = best.select("vec_id", "tag", F.col("positive").alias("pos"), F.col("score").alias("positive_score"))
    return hard.join(scores, ["vec_id", "tag", "pos"]).select(
        F.col("vec_id").alias("anchor_id"), F.col("pos").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
