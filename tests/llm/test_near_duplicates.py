import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import common, op3_minhash, op9_lines, op10_embedding
from .brute import components, line_components, near_documents, word_shingles


def frame(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("digest", "rep", "component", "node", "x", "y", "bucket", "h1", "line", "kept", "n_shingles"):
        df = df.withColumn(c, F.lit(5))
    return df


def test_components_long_chain_and_hub(spark):
    """A chain needs many rounds, a hub has a third of all edges; both come out whole."""
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (2000, 1999)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = components(range(3000), [e for e in edges if None not in e])
    assert got == {n: want[n] for n in got} and len(got) == 301 + 200 + 2
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shingles_and_hashes_agree(varied):
    for _, text in varied:
        w = op3_minhash.words(text or "")
        assert len(op3_minhash.shingle_hashes(w)) == len(op3_minhash.shingles(w)) == len(word_shingles(text))


def test_hashes_do_not_depend_on_the_segment(monkeypatch):
    w = [b"w%d" % (i % 977) for i in range(60_000)]
    whole = op3_minhash.shingle_hashes(w)
    assert np.array_equal(whole, np.unique(np.concatenate([op3_minhash.shingle_hashes(w[:30_004]), op3_minhash.shingle_hashes(w[30_000:])])))


def test_odd_sketch_estimates(rng):
    """XOR counts of pairs at the threshold stay under the limit, those of unlike sets do not."""
    limit = op3_minhash.sketch_limit(0.85)
    near, far = [], []
    for _ in range(60):
        a = np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64)
        for share, out in ((0.92, near), (0.2, far)):
            b = a.copy()
            k = int(1000 * (1 - share))
            b[:k] = [rng.getrandbits(64) for _ in range(k)]
            odd = op3_minhash.odd_sketches(np.stack([op3_minhash.samples(a), op3_minhash.samples(b)]))
            out.append(int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum()))
    assert max(near) <= limit < min(far)


@pytest.mark.parametrize("num", [85, 80])
def test_near_documents_equal_brute_force(spark, varied, num):
    want = near_documents(varied, num, 100)
    got = op3_minhash.near_duplicates(frame(spark, varied), num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_and_null_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")]
    got = op3_minhash.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == 4 and {r["component_id"] for r in got if r["doc_id"] is not None} == {0}
    assert op3_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_large_group_of_copies(spark, rng, monkeypatch):
    """Buckets and groups over several blocks give the same components."""
    monkeypatch.setattr(op3_minhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(100)] = f"x{i}"
        docs.append((i, " ".join(w)))
    want = near_documents(docs, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3_minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == want


def test_lines_equal_brute_force(spark, rng):
    base = " ".join(f"word{rng.randrange(50)}" for _ in range(30))
    docs = [(0, None), (1, ""), (2, "\n \n"), (3, "short\nshort\nshort line"), (4, "naïve café 漢字 text that is long enough\nshort")]
    for i in range(5, 30):
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(30)] = f"other{rng.randrange(9)}"
        docs.append((i, "\n".join([f"line {i} {rng.random()}", " ".join(w), "short" if i % 3 else "a shared closing line of some length"])))
    docs.append((30, "z" * 5000 + "\n" + base))
    want = line_components(docs)
    got = op9_lines.line_components(frame(spark, docs)).collect()
    assert {(r["doc_id"], r["line_no"]): (r["component_doc_id"], r["component_line_no"]) for r in got} == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["component_doc_id"], r["component_line_no"])) for r in got)
    out = op9_lines.drop_repeated_lines(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in docs:
        visible = [(n, x) for n, x in enumerate((t or "").split("\n")) if x.strip()]
        stay = [x for n, x in visible if want[(i, n)] == (i, n)]
        if stay or not visible:
            assert [x for x in (kept[i] or "").split("\n") if x.strip()] == stay
        else:
            assert i not in kept
    assert op9_lines.line_components(frame(spark, [])).count() == 0


def test_lines_with_one_changed_character(spark, rng):
    """A typo or changed digit in a line of 40 to 70 characters makes a near copy; longer ones and other lines as before."""
    def text(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789    ") for _ in range(n - 2)).join("xy")

    docs, pairs = [], []
    for i, n in enumerate([*range(40, 71), 100, 160, 161, 300]):
        line = text(n)
        at = rng.randrange(5, n - 5)
        docs += [(2 * i, line), (2 * i + 1, line[:at] + "#" + line[at + 1:])]
        pairs.append((2 * i, 2 * i + 1))
    docs.append((1000, "\n".join(text(n) for n in range(40, 71))))
    got = {(r["doc_id"], r["line_no"]): r["component_doc_id"] for r in op9_lines.line_components(frame(spark, docs)).collect()}
    assert all(got[(a, 0)] == a and got[(b, 0)] == a for a, b in pairs)
    assert all(got[(1000, n)] == 1000 for n in range(31))
    # both kinds of shingles against plain sets
    sets = [{k: {t[j:j + k.shingle] for j in range(len(t) - k.shingle + 1)} for k in (op9_lines.LONG, op9_lines.SHORT) if k.upto is None or len(t) <= k.upto} for _, t in docs[:-1]]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if any(len(sets[a][k] & sets[b][k]) >= 0.8 * len(sets[a][k] | sets[b][k]) - 1e-9 for k in sets[a].keys() & sets[b].keys())]
    assert {i: got[(i, 0)] for i in range(len(sets))} == components(range(len(sets)), links)


def test_line_dedup_runs_no_python(spark):
    plan = op9_lines.line_components(frame(spark, [(1, "some line\nsome line")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python")


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("key", "size", "cell", "rep", "n")})


def test_embeddings_equal_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(op10_embedding, "BLOCK", 16)
    rows = []
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    for i in range(200):
        c = centres[i % 12]
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c], i % 3))
    rows += [(200 + i, [float(x) for x in rows[0][1]], 0) for i in range(30)]
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] + [1.0] * 23, 1), (303, [None] + [1.0] * 23, 1), (304, [], 1),
             (305, rows[0][1], None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [float("inf")] * 24, 0)]
    unit = {}
    for i, v, label in rows:
        v32 = None if not v or None in v else np.array(v, np.float32).astype(float)
        if v32 is not None and label is not None and np.isfinite(v32).all() and (v32 != 0).any():
            unit[i] = (label, v32)
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1])
             and float(unit[a][1] @ unit[b][1]) / math.sqrt(float(unit[a][1] @ unit[a][1]) * float(unit[b][1] @ unit[b][1])) >= 0.93]
    comp = components([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = op10_embedding.near_duplicates(vectors_frame(spark, rows), 0.93).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (count[i], comp[i]) for i in count}
    assert op10_embedding.near_duplicates(vectors_frame(spark, [])).count() == 0


def test_residual_bound_loses_nothing(rng):
    g = np.random.default_rng(3)
    a = g.normal(size=(300, 40)) * np.linspace(3, 0.1, 40)
    a /= np.linalg.norm(a, axis=1)[:, None]
    i, j = op10_embedding.links(a, a, 0.8, True)
    want = {(x, y) for x, y in combinations(range(300), 2) if a[x] @ a[y] >= 0.8}
    assert want <= set(zip(i.tolist(), j.tolist())) and len(i) < len(want) + 10


def test_an_id_with_two_texts_keeps_all_links(spark, rng):
    """Each text of id 5 is a near copy of another document; both links are found and tie the documents together."""
    from tests.llm.conftest import prose
    one, two = prose(rng, 200).split(), prose(rng, 200).split()
    docs = [(5, " ".join(one)), (5, " ".join(two)), (8, " ".join([*one[:-1], "x"])), (2, " ".join([*two[:-1], "y"])), (9, prose(rng, 60)), (9, prose(rng, 60)), (11, None), (11, " ".join(one))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in op3_minhash.near_duplicates(frame(spark, docs), 85, 100).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 2, False), (8, 2, False), (9, 9, True), (9, 9, True), (11, 2, False), (11, 11, True)]


def test_lines_go_from_the_text_that_holds_them(spark):
    """Two rows with id 2: only the first one's second line repeats an earlier document."""
    docs = [(1, "one line that stands in several documents\nopening words of the first document"), (2, "a heading of its own kind, long enough\none line that stands in several documents"),
            (2, "some other heading, also long enough\na unique second line that has to stay here"), (3, "last words"), (3, "last words")]
    got = sorted((r.doc_id, r.text) for r in op9_lines.drop_repeated_lines(frame(spark, docs)).collect())
    assert got == [(1, docs[0][1]), (2, "a heading of its own kind, long enough"), (2, docs[2][1]), (3, "last words"), (3, "last words")]


def test_line_verification_counts_characters_not_code_units(spark):
    """Lines of emoji and accents against the plain version."""
    import random
    rnd = random.Random(2)
    base = ["".join(rnd.choices("aé😀漢b c", k=60)) + f" z{i}" for i in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, t[:30] + "😀" + t[31:]) for i, t in enumerate(base)]
    got = {(r.doc_id, r.line_no): (r.component_doc_id, r.component_line_no) for r in op9_lines.line_components(frame(spark, docs)).collect()}
    long_, short = line_components(docs, q=8), line_components(docs, q=4)
    assert all(got[p] <= min(long_[p], short[p]) for p in got) and any(got[(100 + i, 0)] == (i, 0) for i in range(12))


def test_bitmaps_rule_out_unlike_lines_and_lose_no_link(spark):
    """Lines of 20 to 900 characters that share from none to nearly all of their words."""
    import random
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghé漢😀", k=6)) for _ in range(400)]
    base, found = [rnd.choice(vocabulary) for _ in range(120)], ["z", "zz"]
    for n in (3, 20, 60, 120):
        for share in (0.0, 0.05, 0.1, 0.3, 0.6, 1.0):
            found += [" ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base[:n]) for _ in range(2)]
    found = sorted(set(found))
    text = spark.createDataFrame([(i, i, t) for i, t in enumerate(found)], "h1 long, h2 long, line string")
    text = text.select("h1", "h2", F.encode("line", "UTF-32").alias("wide"))
    pairs = spark.createDataFrame(list(combinations(range(len(found)), 2)), "x long, y long")
    for q in (8, 4):
        sets = [{t[j:j + q] for j in range(len(t) - q + 1)} or {t} for t in found]
        alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(found)), 2)}
        links = {p for p, j in alike.items() if j >= 0.8 - 1e-9}
        got = {(r.x, r.y) for r in op9_lines._possible(pairs, text, 0.8, q).collect()}
        assert links and links <= got
        assert not any(alike[p] < 0.4 for p in got)
        assert {(r.x1, r.y1) for r in op9_lines._verified(pairs, text, 0.8, q).collect()} == links


@pytest.mark.parametrize("few", [0, 32])
def test_a_common_passage_pairs_no_lines_but_alike_ones(spark, rng, monkeypatch, few):
    """Lines that hold one passage share buckets; few of their pairs are compared, and those that are alike are found."""
    monkeypatch.setattr(op9_lines, "FEW", few, raising=False)
    compared, verified = [], op9_lines._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(op9_lines, "_verified", counted)

    def text(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    passage, docs = "z" + text(198) + "z", []
    for i in range(200):
        own = text(78)
        docs += [(i, f"{passage}x{own}x")]
        if i % 10 == 0:
            docs += [(1000 + i, f"{passage}x{own[:40]}#{own[41:]}x"), (2000 + i, f"{passage}x{own[:40]}#{own[41:60]}#{own[61:]}x")]
    want = line_components(docs)
    got = {(r.doc_id, r.line_no): (r.component_doc_id, r.component_line_no) for r in op9_lines.line_components(frame(spark, docs)).collect()}
    assert got == want and sum(p != c for p, c in want.items()) == 40
    assert sum(compared) < 20 * len(docs)


def test_tables_of_the_steps_are_removed(spark, rng, monkeypatch, tmp_path):
    """What line dedup and the components write on their way goes as soon as nothing reads it any more."""
    held, most = [], []

    def listed(df, label, own=op9_lines.written):
        out = own(df, label)
        held.append(label)
        most.append(sum(p.name.startswith("llm-") for p in tmp_path.iterdir()))
        return out

    monkeypatch.setattr(op9_lines, "written", listed)
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    words = [f"word{i}" for i in range(300)]
    lines_ = [" ".join(rng.choices(words, k=30)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(lines_)] + [(100 + i, t.replace("word1", "wird1")) for i, t in enumerate(lines_)]
    got = op9_lines.line_components(frame(spark, docs))
    assert {(r.doc_id, r.line_no): (r.component_doc_id, r.component_line_no) for r in got.collect()} == line_components(docs)
    assert len(held) > 40 and max(most) < 20
