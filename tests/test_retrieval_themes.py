import os
import numpy as np
from pyspark.sql import functions as F

from revlens.operators import retrieval as H
from revlens.operators import themes as I


def test_top_k_matches_numpy(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(30, 8)); c = rng.normal(size=(40, 8))
    qi = ["A", "B", "", "Other", "General"] * 6
    ci = ["A", "B", "General", "C"] * 10
    qdf = spark.createDataFrame([(i, qi[i], q[i].tolist()) for i in range(30)], "qid long, industry string, vec array<double>")
    cdf = spark.createDataFrame([(j, ci[j], c[j].tolist()) for j in range(40)], "doc_id long, industry string, vec array<double>")
    got = {}
    for r in H.similar_top_k(qdf, cdf, k=3, floor=None, query_block=7, corpus_block=5).collect():
        got.setdefault(r.qid, []).append((r.rank, r.doc_id))
    for i in range(30):
        allowed = [j for j in range(40) if qi[i] in ("", "Other") or ci[j] in (qi[i], "General")]
        sims = {j: q[i] @ c[j] / np.linalg.norm(q[i]) / np.linalg.norm(c[j]) for j in allowed}
        best = sorted(allowed, key=lambda j: (-sims[j], j))[:3]
        assert [d for _, d in sorted(got[i])] == best


def test_floor_applies_after_k(spark):
    qdf = spark.createDataFrame([(1, "A", [1.0, 0.0])], "qid long, industry string, vec array<double>")
    cdf = spark.createDataFrame([(1, "A", [1.0, 0.1]), (2, "A", [0.0, 1.0]), (3, "General", [0.5, 1.0])],
                                "doc_id long, industry string, vec array<double>")
    out = H.similar_top_k(qdf, cdf, k=2, floor=0.45).collect()
    assert [(r.doc_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(1, 0.995)]


def test_best_by_parts_equals_one_sort():
    rng = np.random.default_rng(4)
    for whole in (True, False):
        q, d = rng.normal(size=(40, 6)), rng.normal(size=(300, 6))
        if whole:  # many equal cosines
            q, d = np.rint(q), np.rint(d)
        q[3] = 0.0
        d[[5, 250]] = 0.0
        d[260, 2] = np.nan
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = (q @ d.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1))
            sims = np.where(np.isfinite(sims), sims, -np.inf)
            want = np.argsort(-sims, axis=1, kind="stable")[:, :4]
            at, vals = H._best(q, d, 4, rows=16, cols=32)
        held = np.isfinite(vals)
        assert (held == np.isfinite(np.take_along_axis(sims, want, 1))).all() and held.sum() == 39 * 4
        assert np.allclose(vals[held], np.take_along_axis(sims, want, 1)[held], atol=1e-12)
        if not whole:
            assert (at[held] == want[held]).all()
    at, _ = H._best(np.ones((1, 4)), np.ones((100, 4)), 3, cols=8)
    assert at.tolist() == [[0, 1, 2]]


def test_vectors_are_sent_once_while_a_target_fits_a_task(spark, monkeypatch):
    sent = []
    deal = H.dealt
    monkeypatch.setattr(H, "dealt", lambda tiles, tile: sent.append(tiles) or deal(tiles, tile))
    q = spark.range(3000).selectExpr("id AS qid", "'Other' AS industry", "array(1.0D, id + 0.5D) AS vec")
    c = spark.range(5000).selectExpr("id AS doc_id", "'General' AS industry", "array(id + 0.5D, 1.0D) AS vec")
    assert H.similar_top_k(q, c, k=1, floor=None).count() == 3000
    assert sent[0].count() == 3000 + 5000


def test_tiles_are_sent_in_waves(spark, monkeypatch):
    """With many blocks no wave sends all tiles' rows, and the best of all waves are those of one."""
    rng = np.random.default_rng(3)
    q = spark.createDataFrame([(i, ["A", "Other", None, "B"][i % 4], rng.normal(size=6).tolist()) for i in range(60)], "qid long, industry string, vec array<double>")
    c = spark.createDataFrame([(j, ["A", "B", "General"][j % 3], rng.normal(size=6).tolist()) for j in range(50)], "doc_id long, industry string, vec array<double>")
    want = sorted(map(tuple, H.similar_top_k(q, c, k=3, floor=0.3).collect()))
    sent, deal = [], H.dealt
    monkeypatch.setattr(H, "dealt", lambda tiles, tile: sent.append(tiles.count()) or deal(tiles, tile))
    monkeypatch.setattr(H, "WAVE", 300, raising=False)
    assert sorted(map(tuple, H.similar_top_k(q, c, k=3, floor=0.3, query_block=8, corpus_block=8).collect())) == want
    assert len(want) > 60 and len(sent) > 2 and max(sent) < sum(sent) / 2


def test_average_linkage_matches_reference(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(3, 6))
    vecs = [centers[i % 3] + 0.4 * rng.normal(size=6) for i in range(24)]
    df = spark.createDataFrame([("s", "cat", "negative", i, vecs[i].tolist()) for i in range(24)],
                               "session_id string, category string, sentiment string, item long, vec array<double>")
    for th in (0.45, 0.9):
        got = {r.item: r.cid for r in I.average_linkage(df, th, block=5).collect()}
        ref = I.average_linkage_reference(vecs, th)
        part = lambda lab: sorted(sorted(i for i in range(24) if lab[i] == c) for c in set(lab))
        assert part([got[i] for i in range(24)]) == part(ref)


def test_themes_and_reconcile(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(2, 5))
    rows = []
    for i in range(20):
        v = c[i % 2] + 0.05 * rng.normal(size=5)
        rows.append(("s", i, f"r{i}", "Delivery" if i < 18 else "Price", "negative", "critical" if i % 5 == 0 else "low",
                     v.tolist()))
    df = spark.createDataFrame(rows, "session_id string, review_id int, review string, category string, "
                                     "sentiment string, urgency string, vec array<double>")
    themes, members, unique = I.cluster_themes(df)
    t = themes.orderBy("rank").collect()
    assert [r["count"] for r in t] == [9, 9]
    assert unique.count() == 2                     # category "Price" has < 4 reviews
    assert all(r.ok for r in I.reconcile(themes, unique, df).collect())


def test_average_linkage_over_many_rounds(spark):
    """Nested distances: one merge a round, more than twelve rounds, several tiles."""
    n = 16
    angles, at = [], 0.0
    for i in range(n):
        angles.append(at)
        at += 0.004 * 1.35 ** i
    vecs = [np.array([np.cos(a), np.sin(a)]) for a in angles]
    df = spark.createDataFrame([("s", "c", "x", i, v.tolist()) for i, v in enumerate(vecs)],
                               "session_id string, category string, sentiment string, item long, vec array<double>")
    got = {r.item: r.cid for r in I.average_linkage(df, 0.45, block=6).collect()}
    ref = I.average_linkage_reference(vecs, 0.45)
    assert [got[i] for i in range(n)] == ref


def test_group_goes_once_to_a_block_and_is_compared_in_parts(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    sent, deal = [], I.dealt
    monkeypatch.setattr(I, "dealt", lambda tiles, tile: sent.append(tiles.count()) or deal(tiles, tile))
    many = spark.createDataFrame([("s", "c", "neutral", i, [float(x) for x in rng.normal(size=8)]) for i in range(1500)],
                                 "session_id string, category string, sentiment string, item long, vec array<double>")
    assert I.average_linkage(many, 1e-6).count() == 1500
    assert sent == [3000]  # each vector once as asker and once as partner
    # parts of a block, ties and equal ids as one comparison of all with all
    a, b = np.array([4, 1, 1, 9, 6, 0]), np.array([9, 1, 4, 0, 1, 7, 8])
    am, bm = rng.integers(0, 2, (6, 3)).astype(float), rng.integers(0, 2, (7, 3)).astype(float)
    d = 1.0 - am @ bm.T
    d[a[:, None] == b[None, :]] = np.inf
    monkeypatch.setattr(I, "PART", 4)
    nn, dist = I._best(a, am, b, bm)
    assert dist.tolist() == d.min(axis=1).tolist()
    assert nn.tolist() == [min(b[j] for j in range(7) if d[i, j] == d[i].min()) for i in range(6)]


def test_norm_is_made_once_a_vector(spark):
    """The norm is no part of what is done for every element."""
    found = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(I._unit(F.col("v")).alias("u"))
    assert [r.u for r in found.collect()] == [[0.6, 0.8], None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_linkage_looks_again_only_where_something_merged(spark):
    """Tight and loose groups, a zero vector, ties; clusters that look again fall with the merges."""
    rng = np.random.default_rng(9)
    vecs, rows = {}, []
    for g in range(3):
        centers = rng.normal(size=(14, 12))
        for i in range(80):
            v = centers[i % 14] + (0.1 + 0.25 * (i % 3)) * rng.normal(size=12)
            if i in (40, 41):
                v = vecs[(g, 3)]  # copies
            vecs[(g, i)] = v
            rows.append(("s", f"c{g}", "x", i, v.tolist()))
    rows.append(("s", "c0", "x", 999, [0.0] * 12))
    df = spark.createDataFrame(rows, "session_id string, category string, sentiment string, item long, vec array<double>").repartition(5)
    rounds = []
    got = {(r.category, r.item): r.cid for r in I.average_linkage(df, 0.6, block=17, watch=lambda again, open_: rounds.append((again, open_))).collect()}
    assert got.pop(("c0", 999)) == 999
    for g in range(3):
        assert [got[(f"c{g}", i)] for i in range(80)] == I.average_linkage_reference([vecs[(g, i)] for i in range(80)], 0.6)
    assert rounds[0] == (240, 240) and rounds[1][0] < rounds[1][1] < 240 and all(a <= o for a, o in rounds)
    assert sum(a for a, _ in rounds) < 0.5 * 240 * len(rounds)
    assert [o for _, o in rounds] == sorted((o for _, o in rounds), reverse=True)


def test_stored_index_is_built_once(spark, tmp_path):
    rows = [("1", None, "t", "late parcel", "ship earlier", "high", None, None, ["late"]), ("2", "A", "t", "rude staff", "train them", "high", "low", "long_term", None)]
    s = spark.createDataFrame(rows, "id string, industry string, issue_type string, problem string, solution string, impact string, effort string, timeframe string, tags array<string>")
    path = f"{tmp_path.as_posix()}/index"
    built = H.stored_solution_index(s, H.letter_counts_encoder, path)
    assert {(r.id, r.industry, r.effort, r.timeframe) for r in built.collect()} == {("1", "General", "medium", "short_term"), ("2", "A", "low", "long_term")}
    assert H.stored_solution_index(s.limit(0), H.letter_counts_encoder, path).count() == 2
    assert H.stored_solution_index(s.filter("id = '1'"), H.letter_counts_encoder, path, force=True).count() == 1


def test_index_refresh_encodes_only_what_changed(spark, tmp_path):
    """New and changed documents are encoded, vanished ones go, an unfinished version does not count."""
    log = tmp_path / "encoded"
    log.mkdir()
    folder, path = log.as_posix(), f"{tmp_path.as_posix()}/index"

    def factory():
        import hashlib
        import numpy as np

        def enc(texts):
            for t in texts:
                open(f"{folder}/{hashlib.md5(t.encode()).hexdigest()}-{np.random.default_rng().integers(1 << 60)}", "w").close()
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32).reshape(len(texts), 2)
        return enc
    schema = "id string, industry string, issue_type string, problem string, solution string, impact string, effort string, timeframe string, tags array<string>"
    row = lambda i, problem, tags=("late",): (i, None, "t", problem, "ship earlier", "high", None, None, list(tags))
    encoded = lambda: len(os.listdir(folder))
    first = H.refreshed_solution_index(spark.createDataFrame([row("1", "late parcel"), row("2", "rude staff"), row("3", "gone soon")], schema), factory, path)
    assert first.count() == 3 and encoded() == 3 and "content" not in first.columns
    rows = [row("1", "late parcel"), row("2", "very rude staff"), row("4", "new one")]
    second = H.refreshed_solution_index(spark.createDataFrame(rows, schema).repartition(3), factory, path)
    assert encoded() == 5 and {r.id: (r.problem, r.embedding[0]) for r in second.collect()} == {
        r.id: (r.problem, float(len(r.document))) for r in H._with_document(spark.createDataFrame(rows, schema)).collect()}
    assert H.refreshed_solution_index(spark.createDataFrame(rows, schema), factory, path).count() == 3 and encoded() == 5
    os.makedirs(f"{path}/3/_temporary")  # a run that died
    assert H.refreshed_solution_index(spark.createDataFrame(rows[:1], schema), factory, path).count() == 1 and encoded() == 5


def test_hashed_encoder_is_the_stated_hash():
    import hashlib
    text, v = " late parcel ", np.zeros(16)
    for i in range(len(text) - 2):
        h = int(hashlib.md5(text[i:i + 3].encode()).hexdigest()[:8], 16)
        v[h % 16] += 1 if h >= 1 << 31 else -1
    assert H.hashed_ngram_encoder(16, 3, unit=False)(["Late parcel"])[0].tolist() == v.tolist()
    assert np.isclose(np.linalg.norm(H.hashed_ngram_encoder(16)(["Late parcel"])[0]), 1) and H.hashed_ngram_encoder(16)([None]).shape == (1, 16)
