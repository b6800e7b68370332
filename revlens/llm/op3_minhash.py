r"""MinHash near-duplicate documents, candidates checked by odd sketches.

1. Every text becomes the set of its distinct five-word shingles (fewer words: the whole
   sequence; no words: empty), the set a MinHash signature of ``BANDS * ROWS`` samples,
   and the samples an odd sketch: each (sample number, value) flips one of ``BITS`` bits,
   so the XOR of two sketches holds the parities of the samples that differ and its
   population count estimates high similarities precisely.
2. Documents with equal sets (digest of the set) form a class, a numbered node; its smallest id and that text stand for it.
3. Banding: representatives that agree in a band share a bucket.  Within a bucket,
   block against block, pairs whose set sizes and sketches allow the threshold (see
   ``sketch_limit``) are candidates; a task gives a spanning forest of its candidates, so
   its rows stay in proportion to its members.  Components of those forests are the
   candidate groups: both ends of every candidate are in one group.
4. The texts of a group meet, block against block.  A candidate whose ends are not yet
   in one component of the task is compared on the full shingle sets; links that hold are
   confirmed on the sets of strings and come out as a spanning forest.
5. Links and equal sets give the components.

So a large group of copies costs comparisons in memory, but never a row per pair.

At the threshold 0.85 a pair misses all bands with probability 5e-11, at 0.8 with 5e-8.

Cases: null text is empty; a document without words has no shingles, links with nothing
and is its own component; rows with the same id are tied (the links of all their texts add up), each
row gives its own result; null ids link with nothing; texts of any length are taken
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import connected_components, map_batches, texts, written

BANDS, ROWS, BITS = 32, 4, 256
SHINGLE = 5
#: documents, and shingles, of a block that a task holds at once
BLOCK = 1024
TILE_SHINGLES = 2_000_000
#: members of candidate groups (four longs each) up to this number go to all tasks to pick their texts
BROADCAST_NODES = 500_000


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(seed: int, n: int) -> np.ndarray:
    return _splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _constants(1, 256)
_FACTOR = (_constants(2, BANDS * ROWS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = _constants(3, BANDS * ROWS).reshape(BANDS, ROWS) | np.uint64(1)
_PLACE = _constants(4, BANDS * ROWS)
_SEGMENT = 1 << 20
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_tables: list = [_powers(1 << 14)]


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between the characters 09-0D and 20."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], k: int = SHINGLE) -> set[bytes]:
    if not tokens:
        return set()
    if len(tokens) < k:
        return {b" ".join(tokens)}
    return set(map(b" ".join, zip(*(tokens[i:] for i in range(k)))))


def shingle_hashes(tokens: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles: a polynomial over the bytes from prefix sums, mixed."""
    if not tokens:
        return np.zeros(0, np.uint64)
    k = min(k, len(tokens))
    parts, at, step = [], 0, max(k, 50_000)
    while at == 0 or at + k <= len(tokens):
        body = b" ".join(tokens[at:at + step + k - 1])
        a = np.frombuffer(body, np.uint8)
        if len(a) > len(_tables[0][0]):
            _tables[0] = _powers(1 << (len(a) - 1).bit_length())
        up, down = _tables[0]
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * up[:len(a)], out=total[1:])
        gaps = np.flatnonzero(a == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(a)]))
        s, e = starts[:len(starts) - k + 1], ends[k - 1:]
        parts.append(_splitmix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        at += step
    return np.unique(np.concatenate(parts))


def samples(h: np.ndarray) -> np.ndarray:
    """MinHash values: per factor the smallest product, 32 bits."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(best, np.multiply.outer(low[at:at + 2048], _FACTOR).min(axis=0), out=best)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of signatures (documents x samples), the band's number included."""
    rows = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
    return _splitmix((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps of signatures, as BITS/64 longs each."""
    place = (_splitmix(sig.astype(np.uint64) * np.uint64(_BASE) + _PLACE) % np.uint64(BITS)).astype(np.int64)
    flat = np.zeros((len(sig), BITS), np.uint8)
    np.bitwise_xor.at(flat, (np.arange(len(sig))[:, None], place), np.uint8(1))
    return np.packbits(flat, axis=1).view(np.int64)


def sketch_limit(threshold: float) -> int:
    """Largest XOR population count of a pair at the threshold: its samples' mismatches plus
    seven standard deviations, each flipping two bits, folded into BITS parities."""
    n = BANDS * ROWS
    differ = n * (1 - threshold) + 7 * math.sqrt(n * threshold * (1 - threshold))
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ)))


WORDS = BITS // 64
SIGNED = "doc_id long, body long, n_shingles long, digest binary, " + ", ".join(f"k{i} long" for i in range(WORDS)) + ", bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, set size, set digest, odd sketch and bucket keys of every row of (doc_id, text, body)."""
    def run(b):
        ids = b.column("doc_id").to_pylist()
        sizes, digests, sigs = [], [], []
        for text in texts(b.column("text")):
            h = shingle_hashes(words(text))
            sizes.append(len(h))
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            sigs.append(samples(h))
        sig = np.stack(sigs) if sigs else np.zeros((0, BANDS * ROWS), np.uint32)
        odd, keys = odd_sketches(sig), bands(sig)
        yield {"doc_id": ids, "body": b.column("body"), "n_shingles": sizes, "digest": digests, **{f"k{i}": odd[:, i] for i in range(WORDS)},
               "bands": pa.array(list(keys), pa.list_(pa.int64()))}

    return map_batches(docs, run, SIGNED)


class _Forest:
    """Union-find that keeps the edges that joined two components."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.edges.append((max(x, y), min(x, y)))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": pa.array([e[0] for e in self.edges], pa.int64()), "y": pa.array([e[1] for e in self.edges], pa.int64())})


def _tiles(rows: DataFrame, key: str, fan: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a key dealt to its ``fan`` blocks, every two blocks in a tile of their own (own: the row's block)."""
    own = rows.join(fan, key).withColumn("own", F.expr("pmod(xxhash64(doc_id), fan)"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)))
    own = own.select(key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *columns)
    return own.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _each_tile(batches, key: str, columns: list[str]) -> Iterator[tuple[bool, dict[str, list]]]:
    """(whether it is a block with itself, columns) of each tile of sorted batches."""
    at, held = None, None
    for b in batches:
        for row in zip(*(b.column(c) for c in (key, "lo", "hi", "own", *columns))):
            row = [v.as_py() for v in row]
            if at != row[:3]:
                if held and len(held["doc_id"]) > 1:
                    yield at[1] == at[2], held
                at, held = row[:3], {c: [] for c in ("own", *columns)}
            for c, v in zip(("own", *columns), row[3:]):
                held[c].append(v)
    if held and len(held["doc_id"]) > 1:
        yield at[1] == at[2], held


SKETCH = [f"k{i}" for i in range(WORDS)]


def _candidates(tile: dict[str, list], same: bool, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(j, places i < j) of the tile's pairs whose set sizes and odd sketches allow the threshold."""
    n, own = np.array(tile["n_shingles"], np.int64), np.array(tile["own"])
    odd = np.array([tile[k] for k in SKETCH], np.int64)
    limit = sketch_limit(num / den)
    for j in range(1, len(n)):
        differ = np.bitwise_count((odd[:, :j] ^ odd[:, j:j + 1]).view(np.uint64)).sum(axis=0, dtype=np.int64)
        near = (differ <= limit) & (np.minimum(n[:j], n[j]) * den >= np.maximum(n[:j], n[j]) * num)
        if not same:
            near &= own[:j] != own[j]
        at = np.flatnonzero(near)
        if len(at):
            yield j, at


def candidate_groups(members: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning forests (x, y) of the candidates in each bucket; members: bucket, doc_id, n_shingles, sketch."""
    columns = ["doc_id", "n_shingles", *SKETCH]
    fan = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("fan"))

    def run(batches):
        for same, tile in _each_tile(batches, "bucket", columns):
            forest, ids = _Forest(), tile["doc_id"]
            for j, at in _candidates(tile, same, num, den):
                for i in at.tolist():
                    forest.join(ids[i], ids[j])
            if forest.edges:
                yield forest.batch()

    return _tiles(members, "bucket", fan, columns).mapInArrow(run, "x long, y long").distinct()


def links(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning forests (x, y) of the links in each group; nodes: grp, doc_id, n_shingles, sketch, text."""
    columns = ["doc_id", "n_shingles", *SKETCH, "text"]
    fan = nodes.groupBy("grp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / TILE_SHINGLES)).alias("fan"))

    def run(batches):
        for same, tile in _each_tile(batches, "grp", columns):
            forest, ids, body = _Forest(), tile["doc_id"], tile["text"]
            hashes: dict[int, np.ndarray] = {}

            def held(i):
                if i not in hashes:
                    hashes[i] = shingle_hashes(words(body[i] or ""))
                return hashes[i]

            def linked(a, b, both):
                return den * both >= num * (a + b - both)

            for j, at in _candidates(tile, same, num, den):
                for i in at.tolist():
                    if forest.find(ids[i]) == forest.find(ids[j]):
                        continue
                    x, y = held(i), held(j)
                    if not linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))):
                        continue
                    x, y = shingles(words(body[i] or "")), shingles(words(body[j] or ""))
                    if linked(len(x), len(y), len(x & y)):
                        forest.join(ids[i], ids[j])
            if forest.edges:
                yield forest.batch()

    return _tiles(nodes, "grp", fan, columns).mapInArrow(run, "x long, y long").distinct()


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; see the module for the method."""
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("body", F.xxhash64("text"))
    signed = written(sign(body), "signed")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class of equal sets is a numbered node; its smallest id and that row's text stand for it.  An id with several texts has a node for each
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    reps = usable.join(classes, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = reps.select(F.col("node").alias("doc_id"), "n_shingles", *SKETCH)

    buckets = reps.select(F.col("node").alias("doc_id"), F.explode("bands").alias("bucket"))
    ends = buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("bucket")
    members = written(buckets.join(ends, "bucket", "left_semi"), "buckets").join(nodes, "doc_id")
    groups = connected_components(candidate_groups(members, num, den), "x", "y").select("node", F.col("component").alias("grp"))
    picked = groups.join(reps.select("node", "doc_id", "body"), "node")
    if groups.count() <= BROADCAST_NODES:  # else a shuffle of all texts by id
        picked = F.broadcast(picked)
    texts_ = body.join(picked, ["doc_id", "body"]).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "grp", "text")
    found = links(texts_.join(nodes, "doc_id"), num, den)

    # rows that share an id tie their classes together
    repeated = usable.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("doc_id")
    shared = usable.join(repeated, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "node"), "digest")
    ties = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("y")), "doc_id").select(F.col("node").alias("x"), "y")
    last = connected_components(found.union(ties), "x", "y")
    first = last.join(reps.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("first"))
    place = (reps.select("digest", "node", F.col("doc_id").alias("rep")).join(last.join(first, "component").select("node", "first"), "node", "left")
             .select("digest", "rep", "first"))

    out = signed.select("doc_id", "n_shingles", "digest").join(place, "digest", "left")
    component = F.coalesce("first", F.when(F.col("doc_id").isNotNull(), F.col("rep")), "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component only; columns stay."""
    found = near_duplicates(docs, num, den, id_col, text_col)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__id"], "left_anti")
