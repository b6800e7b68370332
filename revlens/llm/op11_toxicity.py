"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs with one word
between them (A-Z lower-cased), hashed into 2^``BITS`` places; each is on or off.  Training is
follow-the-regularised-leader: every place keeps a sum of adjusted gradients ``z`` and of
squared gradients ``n``; its weight is 0 while |z| stays within the L1 strength and otherwise
-(z -+ l1) / ((beta + sqrt(n)) / alpha + l2), so each place has a learning rate of its own and
places without steady evidence carry no weight.  Only the non-zero weights leave the training
task; they are the model that is broadcast.

Training reads a bounded sample of the labelled rows: at most about ``max_train_docs`` documents
and ``max_train_features`` features (shares by hash of the id and text, whole documents only,
both from counts over all labelled rows or the whole sample).  Labels are sampled before the
join, so no text is shuffled; equal texts of an id count once.  The sample's feature places are
one bounded table that one task passes over ``epochs`` times, in an order by hash.

Cases: null and empty texts have no feature and score by the bias alone; repeated label rows
count as toxic if any is; labels other than 0 and 1, and null ids, teach nothing; without a
labelled row of each kind every score is the share of toxic ones (0 without any); repeated
rows score alike; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.common import byte_words, map_batches, written

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0


def places(text: bytes | None) -> np.ndarray:
    """Hashed places of all words, neighbour pairs and pairs one apart, repeats included."""
    words = byte_words(text)
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    near = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    apart = (h[:-2] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[2:] * np.uint64(0xA0761D6478BD642F))
    every = np.concatenate([h, near, apart])
    every ^= every >> np.uint64(32)
    every *= np.uint64(0xFF51AFD7ED558CCD)
    return (every >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Weights:
    """Non-zero weights by place, and the bias."""
    place: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(1 << BITS, np.float32)
        t[self.place] = self.weight
        return t


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


class Ftrl:
    """Sums of one model; place 2^BITS is the bias, which L1 leaves alone."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, on: np.ndarray) -> np.ndarray:
        z, n = self.z[on], self.n[on]
        l1 = np.where(on == 1 << BITS, 0.0, self.l1)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int) -> None:
        """One step on distinct ``features``."""
        on = np.append(features, 1 << BITS)
        w = self.weights(on)
        g = logistic(float(w.sum())) - label
        n = self.n[on]
        self.z[on] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[on] += g * g

    def model(self) -> Weights:
        on = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return Weights(on.astype(np.int32), self.weights(on).astype(np.float32), float(self.weights(np.array([1 << BITS]))[0]))


def _share(bound: int, total: int) -> Column:
    return F.lit(int(1_000_000 * min(1.0, bound / max(total, 1))))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 20_000, max_train_features: int = 40_000_000, epochs: int = 4,
          id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """The model of the labelled rows of ``docs``; ``labels`` has doc_id and toxic."""
    judged = (labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("long").alias("y"))
              .where(F.col("y").isin(0, 1) & F.col("i").isNotNull()).groupBy("i").agg(F.max("y").alias("y")))
    n = judged.count()
    chosen = judged.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < _share(max_train_docs, n))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sample = rows.join(F.broadcast(chosen), "i")  # about max_train_docs rows of (id, label)

    def features(b):
        yield {"i": b.column("i"), "y": b.column("y"), "on": [np.unique(places(t.as_py())) for t in b.column("text")]}

    found = map_batches(sample.select("i", "y", "text"), features, "i long, y long, on array<int>")
    found = written(found.withColumn("key", F.xxhash64("i", "on")).groupBy("i", "key").agg(F.first("y").alias("y"), F.first("on").alias("on")), "toxic")
    r = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("on")).alias("f"), F.sum("y").alias("toxic")).first()
    if not r["n"] or r["toxic"] in (0, r["n"]):
        share = r["toxic"] / r["n"] if r["n"] else 0.0
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), math.inf if share == 1 else -math.inf)
    held = found.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < _share(max_train_features, r["f"] + r["n"]))

    def fit(batches):
        seqs = [(y, on.values.to_numpy()) for b in batches for y, on in zip(b.column("y").to_pylist(), b.column("on"))]
        ftrl = Ftrl()
        for _ in range(epochs):
            for y, on in seqs:
                ftrl.learn(on, y)
        m = ftrl.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.place, -1), pa.int32()), pa.array(np.append(m.weight, m.bias), pa.float64())],
                                         names=["place", "weight"])

    order = [F.xxhash64("key", F.lit(17)), F.col("i")]
    got = {r["place"]: r["weight"] for r in held.select("i", "key", "y", "on").repartition(1).sortWithinPartitions(*order)
           .mapInArrow(fit, "place int, weight double").collect()}
    bias = got.pop(-1, 0.0)
    return Weights(np.array(sorted(got), np.int32), np.array([got[k] for k in sorted(got)], np.float32), bias)


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_weighted) of every row; n_weighted counts the text's places with a weight."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights

    def run(batches):
        table, bias = sent.value.table(), sent.value.bias
        on = table != 0
        for b in batches:
            points, hits = [], []
            for t in b.column("text"):
                at = places(t.as_py())
                at = np.unique(at[on[at]])
                hits.append(len(at))
                points.append(logistic(float(table[at].sum()) + bias) if math.isfinite(bias) else float(bias > 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(points, pa.float64()), pa.array([int(p >= 0.5) for p in points], pa.int32()),
                                              pa.array(hits, pa.int64())], names=["doc_id", "score", "predicted", "n_weighted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_weighted long")
