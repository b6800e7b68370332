import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import op11_toxicity, op12_resampling, op13_negatives
from revlens.llm.common import byte_words
from revlens.llm.queries import QUERIES
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in ("i", "y", "on", "key", "score", "weight", "rank", "place", "bucket", "n", "toxic", "part")})


ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "word"), (3, "word"), (3, "another text of this id"), (None, "no id here"), (None, None),
       (4, "x" * 70_000 + " end"), (5, "é漢字 ​’s 😀 'll İ ſ K"), (6, "tab\tand\x0bvertical\x1c\x85separators \x00nul"), (7, "a_b-c[d]{e}~f`g@H^i")]


def test_byte_words_are_the_words_of_the_pattern():
    rng = random.Random(3)
    pool = [chr(c) for c in range(128)] * 3 + list("äéßñ漢字😀\u0085  ​İK")
    for _ in range(400):
        text = "".join(rng.choices(pool, k=rng.randrange(60)))
        assert [w.decode() for w in byte_words(text.encode())] == WORD.findall(low(text))
    assert byte_words(None) == [] and byte_words(b"") == []


# --- 11 ------------------------------------------------------------------------
def test_ftrl_equals_a_plain_version(rng):
    """Per-coordinate sums in dicts, one coordinate at a time."""
    ftrl, z, n = op11_toxicity.Ftrl(alpha=0.7, beta=1.5, l1=0.4, l2=0.3), Counter(), Counter()
    bias = 1 << op11_toxicity.BITS

    def weight(k):
        if k != bias and abs(z[k]) <= 0.4:
            return 0.0
        l1 = 0 if k == bias else 0.4
        return -(z[k] - math.copysign(l1, z[k])) / ((1.5 + math.sqrt(n[k])) / 0.7 + 0.3)
    for _ in range(300):
        on, y = sorted(rng.sample(range(40), rng.randrange(12))), rng.randrange(2)
        ftrl.learn(np.array(on, np.int32), y)
        w = {k: weight(k) for k in (*on, bias)}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for k, wk in w.items():
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.7 * wk
            n[k] += g * g
    model = ftrl.model()
    assert model.place.tolist() == sorted(k for k in z if k != bias and weight(k)) and 0 < len(model.place) < 40
    assert np.allclose(model.weight, [weight(k) for k in model.place.tolist()], atol=1e-6) and model.bias == pytest.approx(weight(bias))


def test_toxic_features_are_words_pairs_and_skip_pairs():
    one = op11_toxicity.places("alpha BETA gamma beta".encode()).tolist()
    assert len(one) == 4 + 3 + 2 and one[1] == one[3]
    same = op11_toxicity.places(b"x beta gamma")
    assert one[5] == same[4]                                        # beta gamma as neighbours
    assert op11_toxicity.places(b"alpha zzz gamma")[-1] == one[7]   # alpha _ gamma
    assert one[4] != one[7] and len(op11_toxicity.places(None)) == 0 and len(op11_toxicity.places(b"w")) == 1


def toxic_rows(rng, n):
    docs, labels = [], []
    for i in range(100, 100 + n):
        y = int(rng.random() < 0.2)
        w = prose(rng, rng.randrange(5, 120)).split()
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(["nastyone", "vile creature", "utter x fool"]))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_finds_held_out_toxic_texts(spark, rng):
    docs, labels = toxic_rows(rng, 1500)
    docs = docs + ODD
    labels_ = spark.createDataFrame([*labels, (0, 0), (1, 0), (None, 1), (3, None), (100, labels[0][1]), (9999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    frame_ = frame(spark, docs)
    train = frame_.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = op11_toxicity.train(train, labels_)
    assert 0 < len(model.place) < 1000
    got = op11_toxicity.score(frame_, model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    found = {r["doc_id"]: r for r in got}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i]["predicted"] for i, y in held if y]) >= 0.95 and np.mean([found[i]["predicted"] for i, y in held if not y]) <= 0.01
    assert found[0]["score"] == found[1]["score"] == found[2]["score"] < 0.5 and found[0]["n_weighted"] == 0
    table = model.table()
    for i, t in docs[:50]:  # plain sum over distinct places
        s = sum(float(table[p]) for p in set(op11_toxicity.places((t or "").encode()).tolist())) + model.bias
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-s)), rel=1e-5)
    again = op11_toxicity.train(train.repartition(7), labels_)
    assert again.place.tolist() == model.place.tolist() and again.bias == pytest.approx(model.bias)


def test_toxicity_without_labels_or_rows(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, want in ((none, 0.0), (spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int"), 1.0),
                         (spark.createDataFrame([(1, 0), (3, 0), (4, 7)], "doc_id long, toxic int"), 0.0)):
        got = op11_toxicity.score(docs, op11_toxicity.train(docs, labels)).collect()
        assert len(got) == len(ODD) and {r["score"] for r in got} == {want}
    empty = frame(spark, [])
    assert op11_toxicity.score(empty, op11_toxicity.train(empty, none)).count() == 0


def test_toxicity_sample_is_bounded_by_documents_and_features(spark, rng):
    docs, labels = toxic_rows(rng, 400)
    args = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    few = op11_toxicity.train(*args, max_train_features=4000)
    all_ = op11_toxicity.train(*args)
    assert abs(few.bias) < abs(all_.bias) and op11_toxicity.train(*args, max_train_docs=100).bias != all_.bias


# --- 12 ------------------------------------------------------------------------
def plain_resample(docs, target, percent, least, seed, longest, buckets):
    def features(text):
        w = WORD.findall(low(text))
        return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)
    raw, tgt = Counter(), Counter()
    for c, ts in ((raw, [t for _, t in docs]), (tgt, target)):
        for t in ts:
            c.update(zlib.crc32(f.encode()) % buckets for f in features(t)[0])
    s_all, t_all = sum(raw.values()), sum(tgt.values())
    rows = []
    for i, t in docs:
        f, n = features(t)
        g = [math.floor(1000 * math.log((tgt[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in (zlib.crc32(x.encode()) % buckets for x in f)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return Counter(r[:4] for r in rows), [r[:4] for r in fit[:percent * len(fit) // 100]]


@pytest.mark.parametrize("percent,least,longest,buckets", [(10, 20, 1, 10_000), (40, 1, 3, 97), (100, 0, 2, 1000), (0, 5, 1, 50)])
def test_resampling_equals_a_plain_version(spark, rng, percent, least, longest, buckets):
    docs = ODD + [(i, prose(rng, rng.randrange(1, 60), 80)) for i in range(100, 260)] + [(8, prose(rng, 30_000))] + [(9, "same words again")] * 40
    target = [None, "", *(prose(rng, 30, 20) for _ in range(12))]
    got = op12_resampling.resample(frame(spark, docs), frame(spark, [(t,) for t in target], "text string"), percent, least, 11, longest, buckets).collect()
    want, drawn = plain_resample(docs, target, percent, least, 11, longest, buckets)
    assert Counter(tuple(r)[:4] for r in got) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [tuple(r)[:4] for r in ranked] == drawn


def test_resampling_long_runs_of_equal_scores_and_empty_tables(spark):
    docs = spark.range(0, 3000, 1, 7).select(F.lit(5).alias("doc_id"), F.lit("one two three").alias("text"))  # one id, one score
    got = op12_resampling.resample(docs, docs.limit(0), percent=50, min_words=3).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1501)) and len(got) == 3000
    assert op12_resampling.resample(docs.limit(0), docs).count() == 0
    values = list(op12_resampling.run_hashes([b"a", b"bc", b"d"], 3))
    assert values == [[zlib.crc32(x) for x in y] for y in ([b"a", b"bc", b"d"], [b"a bc", b"bc d"], [b"a bc d"])]
    assert list(op12_resampling.run_hashes([], 3)) == [[]]


# --- 13 ------------------------------------------------------------------------
def plain_negatives(rows, k=5, kn=5, lo=80, hi=100, scale=256, every=100):
    ok = [(i, lab, tuple(math.floor(scale * x) for x in v)) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, lab, v in {r for r in ok if r[0] % every == 0}:
        s = [(-sum(a * b for a, b in zip(v, w)), j, lj) for j, lj, w in ok if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in s if x[2] == lab)[:k]:
            fit = sorted(x for x in s if x[2] != lab and -lo * p <= -100 * x[0] <= -hi * p)[:kn]
            out |= {(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(fit, 1)}
    return out


def vectors(rng, n, dim=6, groups=8):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c], rng.randrange(4)))
    return rows


ODD_VECTORS = [(None, [1.0] * 6, 1), (1001, None, 1), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1003, [float("nan")] * 6, 1),
               (1004, [float("inf")] * 6, 1), (1005, [1.0] * 6, None), (1010, [1.0, 2.0], 1), (1011, [1.0, 2.0], 1), (1012, [1.0, 1.9], 2),
               (1020, [], 1), (1021, [], 1), (1022, [], 2), (1030, [0.0] * 6, 1), (1031, [0.0] * 6, 1), (1032, [0.0] * 6, 3)]


@pytest.mark.parametrize("block,chunk,top,sample", [(8192, 2048, 24, 1024), (20, 7, 5, 60), (50, 3, 3, 1)])
def test_hard_negatives_equal_brute_force(spark, rng, monkeypatch, block, chunk, top, sample):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("TOP", top), ("SAMPLE", sample)):
        monkeypatch.setattr(op13_negatives, name, value)
    rows = vectors(rng, 400) + ODD_VECTORS
    rows += [(500 + i, rows[10][1], i % 3) for i in range(60)] + [(601, rows[3][1], 2)]  # copies, ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *(F.lit(1).alias(c) for c in ("cell", "v", "tag", "low", "place")))
    got = [tuple(r) for r in op13_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()]
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(as_float, every=10) and len(got) > 100


def test_hard_negatives_with_repeats_other_windows_and_empty_tables(spark, rng):
    rows = vectors(rng, 120, dim=3, groups=2)
    rows += [rows[0], rows[0], (0, [9.0, 9.0, 9.0], 2), (10, rows[20][1], 3)]  # a repeated anchor, ids with several rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in op13_negatives.mine(df, F.col("vec_id") % 10 == 0, 3, 4, 50, 120, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows, 3, 4, 50, 120, 16, 10)
    assert op13_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert op13_negatives.mine(df, F.col("vec_id") < 0).count() == 0
    assert op13_negatives.mine(df.withColumn("label", F.lit(1)), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_searches_skip_subtrees_and_lose_nothing(rng):
    """Windows over one block's tree against all rows; leaves visited are counted."""
    gen = np.random.default_rng(5)
    centres = gen.normal(0, 200, (30, 8))
    x = np.floor(centres[gen.integers(0, 30, 3000)] + gen.normal(0, 8, (3000, 8)))
    x[100:300] = x[100]  # copies that no split tells apart
    ids, labels = gen.permutation(3000), gen.integers(0, 3, 3000)
    m2 = float((x * x).sum(axis=1).max())
    q = x[:40] + gen.integers(-3, 3, (40, 8))
    of = np.repeat(np.arange(40), 2)
    s = q @ x.T
    top = np.sort(s, axis=1)[:, -20]
    low = np.column_stack([np.full(40, -np.inf), top]).ravel()
    high = np.column_stack([np.full(40, np.inf), top + 400]).ravel()
    seen = Counter()

    class Counting(op13_negatives.Search):
        def _leaf(self, rows, on):
            seen["pairs"] += len(rows) * len(on)
            super()._leaf(rows, on)
    for same in (True, False):
        tree = Counting(x, ids, labels, m2, 5, same)
        best, got = tree.run(q, np.full(40, -1), labels[:40], of, low, high)
        for w in range(80):
            a = of[w]
            fit = [(-v, i) for v, i, lab in zip(s[a], ids, labels) if (lab == labels[a]) == same and low[w] <= v <= high[w]]
            assert [(-v, i) for v, i in zip(best[w], got[w]) if v > -np.inf] == sorted(fit)[:5]
    assert seen["pairs"] < 0.5 * 2 * 80 * 3000


def test_new_queries_read_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    toxic = QUERIES["op11_toxicity"](spark, sf)
    assert toxic.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and toxic.count() == n
    drawn = QUERIES["op12_importance_resampling"](spark, sf)
    assert drawn.columns == ["doc_id", "n_features", "weight", "score", "rank"] and drawn.count() == n
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op13_hard_negatives"](spark, sf).collect()}
    assert got == plain_negatives([(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows])
