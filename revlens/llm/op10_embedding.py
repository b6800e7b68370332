r"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors with equal components and label form a class; its smallest id stands for it and
its size weighs its links.  One rotation per vector length, the eigenvectors of the
second-moment matrix of all unit vectors (dimension squared numbers, summed by Spark),
keeps every inner product and puts the large components first.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, so along the first component as
well: classes lie in cells of that width and only equal or neighbouring cells of a
label meet, in tiles of about ``BLOCK`` classes by ``BLOCK``.  A tile accumulates the
leading dimensions first; the rest of a product is at most the product of the suffix norms,
and a pair stops as soon as the threshold is out of reach.  Pairs that reach the end
are decided by the cosine of the original vectors in double precision.

A tile gives link counts and the edges of a spanning forest, so its rows stay in
proportion to the vectors in it, whatever the number of links.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label or id, link with nothing (own component); vectors of different lengths never
link; a repeated row is a vector of its own with the same id, and the id's smallest rules hold;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import connected_components, written

BLOCK = 4096
STRIPE = 512
STEPS = (8, 16, 32)


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, None where it links with nothing."""
    if not vector or None in vector:
        return None
    v = np.array(vector, float)
    n = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
    return v if n > 0 and math.isfinite(n) else None


def _unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row numbers, vectors, norms) of the usable vectors, per vector length."""
    by: dict[int, list] = {}
    for i, v in enumerate(batch.column("embedding").to_pylist()):
        if (u := usable(v)) is not None:
            by.setdefault(len(u), []).append((i, u))
    for rows in by.values():
        m = np.stack([u for _, u in rows])
        yield np.array([i for i, _ in rows]), m, np.sqrt((m * m).sum(axis=1))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the eigenvectors of the second-moment matrix, largest first."""
    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, m, n in _unit_rows(b):
                u = m / n[:, None]
                total[m.shape[1]] = total.get(m.shape[1], 0) + u.T @ u
        for d, s in total.items():
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(d * d, d)), "i": pa.array(i), "j": pa.array(j), "v": pa.array(s.ravel())})

    sums = (vectors.select("embedding").mapInArrow(moments, "d long, i long, j long, v double")
            .groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect())
    out = {}
    for d in {r["d"] for r in sums}:
        m = np.zeros((d, d))
        for r in sums:
            if r["d"] == d:
                m[r["i"], r["j"]] = r["v"]
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rotated unit vectors whose product may reach the threshold (i < j if same)."""
    d = a.shape[1]
    steps = [s for s in STEPS if s < d] + [d]
    rest_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    least = threshold - 1e-9
    out_i, out_j = [], []
    for at in range(0, len(a), STRIPE):
        first = steps[0]
        part = a[at:at + STRIPE, :first] @ b[:, :first].T
        bound = np.multiply.outer(rest_a[at:at + STRIPE, first], rest_b[:, first]) if first < d else 0.0
        i, j = np.nonzero(part + bound >= least)
        value = part[i, j]
        i = i + at
        if same:
            on = i < j
            i, j, value = i[on], j[on], value[on]
        for lo, hi in zip(steps, steps[1:]):
            value = value + np.einsum("nd,nd->n", a[i, lo:hi], b[j, lo:hi])
            on = value + (rest_a[i, hi] * rest_b[j, hi] if hi < d else 0.0) >= least
            i, j, value = i[on], j[on], value[on]
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module for the method."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("embedding"))

    turn = vectors.sparkSession.sparkContext.broadcast(rotations(rows.where("label IS NOT NULL AND vec_id IS NOT NULL")))

    def prepare(batches):
        for b in batches:
            n = len(b)
            key, first = [None] * n, [None] * n
            ids, label = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
            for at, m, norm in _unit_rows(b):
                basis = turn.value.get(m.shape[1])
                lead = (m / norm[:, None]) @ basis[:, 0] if basis is not None else np.zeros(len(m))
                for i, v, x in zip(at.tolist(), m, lead.tolist()):
                    if label[i] is not None and ids[i] is not None:
                        key[i] = xxhash.xxh3_128_digest((v + 0.0).tobytes() + label[i].encode())
                        first[i] = x
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("embedding"), pa.array(key, pa.binary()),
                                              pa.array(first, pa.float64())], names=["vec_id", "label", "embedding", "key", "first"])

    ready = written(rows.mapInArrow(prepare, "vec_id long, label string, embedding array<double>, key binary, first double"), "vectors")
    classes = ready.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    width = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    reps = (ready.where("key IS NOT NULL").join(classes, "key").where("vec_id = rep").dropDuplicates(["key"])
            .select("rep", "size", "label", "embedding", F.size("embedding").alias("dim"), F.floor(F.col("first") / width).alias("cell")))
    reps = written(reps, "classes")
    cells = reps.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("fan"))
    dealt = reps.join(cells, ["label", "dim", "cell"]).withColumn("block", F.expr("pmod(xxhash64(rep), fan)"))
    # tiles (cell, block) x (cell or the next, block); a class goes to each of its tiles
    here = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1))).select(
        "*", F.lit(0).alias("step"), F.col("cell").alias("low"), F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"),
        (F.col("block") > F.col("o")).alias("right")).drop("o")

    def beside(shift: int, right: bool) -> DataFrame:
        other = cells.select("label", "dim", (F.col("cell") + shift).alias("cell"), F.col("fan").alias("others"))
        d = dealt.join(other, ["label", "dim", "cell"]).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
        p, q = ("o", "block") if right else ("block", "o")
        return d.select(*dealt.columns, F.lit(1).alias("step"), (F.col("cell") - (1 if right else 0)).alias("low"),
                        F.col(p).alias("p"), F.col(q).alias("q"), F.lit(right).alias("right"))

    tiles = here.unionByName(beside(-1, False)).unionByName(beside(1, True))
    tiles = tiles.select("label", "dim", "low", "step", "p", "q", "right", "rep", "size", "embedding")
    order = ["label", "dim", "low", "step", "p", "q"]
    tiles = tiles.repartition(*order).sortWithinPartitions(*order)

    def compare(batches):
        key, held = None, []

        def finish():
            left = [h for h in held if not h[0]]
            right = [h for h in held if h[0]]
            same = key[3] == 0 and key[4] == key[5]
            if same:
                left, right = held, held
            if not left or not right:
                return None
            basis = turn.value[key[1]]

            def side(part):
                m = np.array([h[3] for h in part])
                n = np.sqrt((m * m).sum(axis=1))
                return m, n, (m / n[:, None]) @ basis
            (ma, na, a), (mb, nb, b) = side(left), side(right)
            i, j = links(a, b, threshold, same)
            sure = np.concatenate([np.einsum("nd,nd->n", ma[i[k:k + 65536]], mb[j[k:k + 65536]])
                                   / (na[i[k:k + 65536]] * nb[j[k:k + 65536]]) for k in range(0, max(len(i), 1), 65536)]) >= threshold
            i, j = i[sure], j[sure]
            if not len(i):
                return None
            ids_a, ids_b = np.array([h[1] for h in left]), np.array([h[1] for h in right])
            size_a, size_b = np.array([h[2] for h in left]), np.array([h[2] for h in right])
            n_a = np.bincount(i, weights=size_b[j], minlength=len(a)).astype(np.int64)
            n_b = np.bincount(j, weights=size_a[i], minlength=len(b)).astype(np.int64)
            root: dict[int, int] = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x
            for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            counted = [(x, n) for ids, ns in ((ids_a, n_a), (ids_b, n_b)) for x, n in zip(ids.tolist(), ns.tolist()) if n]
            forest = [(x, find(x)) for x in root]
            forest = [e for e in forest if e[0] != e[1]]
            rows_ = [(x, n, None) for x, n in counted] + [(x, 0, y) for x, y in forest]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.int64()),
                                               pa.array([r[2] for r in rows_], pa.int64())], names=["rep", "n", "root"])

        for b in batches:
            heads = list(zip(*(b.column(c).to_pylist() for c in order)))
            for k, right, rep, size, vector in zip(heads, b.column("right").to_pylist(), b.column("rep").to_pylist(), b.column("size").to_pylist(),
                                                   b.column("embedding")):
                if k != key:
                    if key is not None and (out := finish()) is not None:
                        yield out
                    key, held = k, []
                held.append((right, rep, size, vector.values.to_numpy()))
        if key is not None and (out := finish()) is not None:
            yield out

    found = written(tiles.mapInArrow(compare, "rep long, n long, root long"), "tiles")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("root IS NOT NULL"), "rep", "root")
    per = (classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
           .select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    out = ready.select("vec_id", "key").join(per, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
