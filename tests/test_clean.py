import random

import pytest
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.operators import clean as C
from revlens.operators.neardup import block_pair_edges, near_dedup_reference, similar
from difflib import SequenceMatcher


def run(spark, text, sid="s"):
    df = spark.createDataFrame([(sid, 0, text)], "session_id string, row_ord long, text string")
    return C.clean_reviews(C.lines_from_text(df))


def lines(*rows):
    return "\n".join(rows)


CALM = ["The kettle boils in two minutes flat.", "Courier left the box with a neighbour.", "Hinges squeak when it rains outside.",
        "Refund landed on Tuesday morning.", "Manual is missing its last chapter."]


def test_minimum_gate(spark):
    r = run(spark, lines(*CALM[:4]))
    assert r.report.count() == 0
    assert r.rejected.collect()[0].error == "too_few_lines: 4 of 5"
    assert run(spark, lines(*CALM)).report.collect()[0].final_count == 5


def test_gate_after_cleaning(spark):
    """Enough lines arrive, too few remain."""
    r = run(spark, lines(*CALM[:4], "!!!!", "99999999"))
    assert r.report.count() == 0 and r.clean.count() == 0
    assert r.rejected.collect()[0].error == "too_few_after_cleaning: 4 of 5"


def test_exact_and_noise_and_length(spark):
    rep = run(spark, lines(CALM[0], *CALM)).report.collect()[0]
    assert rep.exact_duplicates_removed == 1 and rep.final_count == 5
    rep = run(spark, lines("zzzzzzzzzz", "20202020", "?!?!?!", *CALM)).report.collect()[0]
    assert rep.noise_removed == 3 and rep.final_count == 5
    long_line = "Every part was labelled twice. " * 60
    df = spark.createDataFrame([("s", 0, lines(long_line, *CALM[:4]))], "session_id string, row_ord long, text string")
    r = C.clean_reviews(C.lines_from_text(df))
    assert len(r.clean.orderBy("review_id").first().text) == len(long_line.strip())
    r = C.clean_reviews(C.lines_from_text(df), hi=1000)
    first = r.clean.orderBy("review_id").first()
    assert len(first.text) <= 1000 and first.text.endswith(".")
    assert [x.review_id for x in r.clean.orderBy("review_id").collect()] == [0, 1, 2, 3, 4]


def test_near_duplicates_in_a_session(spark):
    rep = run(spark, lines("Lid fits well!", "Lid fits well!!", "Lid fits well.", *CALM[:4])).report.collect()[0]
    assert rep.exact_duplicates_removed == 0 and rep.near_duplicates_removed == 2 and rep.final_count == 5


def test_emoji_structure(spark):
    df = spark.createDataFrame([("\U0001F621\U0001F621 furious",)], ["t"])
    out = df.select(X.emoji_to_text("t").alias("x")).collect()[0].x
    assert "pouting_face" in out and "\U0001F621" not in out and out.startswith(" ")


def test_emoji_sequences_are_one_name(spark):
    """Flags, keycaps, skin tones, joined sequences and lone parts against names written out by hand."""
    expected = {
        "\U0001F1E9\U0001F1EA": " flag_de ", "\U0001F1E9\U0001F1EA\U0001F1EB\U0001F1F7": " flag_de  flag_fr ",
        "\U0001F1E9": " regional_indicator_symbol_letter_d ",
        "5\uFE0F\u20E3": " keycap_digit_five ", "#\u20E3": " keycap_number_sign ", "*\uFE0F\u20E3!": " keycap_asterisk !",
        "\U0001F44B\U0001F3FD": " waving_hand_sign_medium_skin_tone ", "\U0001F44D\U0001F3FFok": " thumbs_up_sign_dark_skin_tone ok",
        "\U0001F469\u200D\U0001F4BB": " woman_personal_computer ",
        "\U0001F469\U0001F3FB\u200D\U0001F4BB": " woman_light_skin_tone_personal_computer ",
        "\U0001F468\u200D\U0001F469\u200D\U0001F467": " man_woman_girl ",
        "\U0001F3C3\u200D\u2640\uFE0F": " runner_female_sign ", "\u2764\uFE0F": " heavy_black_heart ",
        "\u2764\uFE0F\u200D\U0001F525": " heavy_black_heart_fire ",
        "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F": " flag_gbeng ",
        "\U0001F600\U0001F600": " grinning_face  grinning_face ", "a\U0001F600b": "a grinning_face b",
        "no pictures 5# é 漢": "no pictures 5# é 漢", "x\u200Dy": "x\u200Dy", "5": "5"}
    df = spark.createDataFrame([(k,) for k in expected], ["t"])
    got = {r.t: r.x for r in df.select("t", X.emoji_to_text("t").alias("x")).collect()}
    assert got == expected


def test_noise_rules_match_python(spark):
    samples = ["", "aaaa", "aaab", "Aaaab", "1234567a", "12 ab", "...", "---", "ok", "ab", "²²²x", "ééééeé", "x y z"]

    def py(t):
        if not t:
            return True
        if len(t) > 3:
            lo = t.lower()
            if any(lo.count(c) / len(lo) > 0.6 for c in set(lo)):
                return True
        if sum(c.isdigit() for c in t) / len(t) > 0.7:
            return True
        return not any(c.isalnum() for c in t)
    df = spark.createDataFrame([(s,) for s in samples], ["t"])
    got = [r.n for r in df.select(X.is_noise("t").alias("n")).collect()]
    assert got == [py(s) for s in samples]


def test_comparison_key_and_length(spark):
    df = spark.createDataFrame([("  Héllo,  WORLD!! \t ok ",)], ["t"])
    assert df.select(X.comparison_key("t")).first()[0] == "héllo world ok"
    df = spark.createDataFrame([("ab",), ("x" * 1200,), ("a. " * 200 + "b" * 700,)], ["t"])
    assert [r[0] and len(r[0]) for r in df.select(X.enforce_length("t")).collect()] == [None, 1200, 1300]
    out = [r[0] for r in df.select(X.enforce_length("t", hi=1000)).collect()]
    assert out[0] is None and len(out[1]) == 1000 and out[2].endswith(".")


def test_similar_equals_difflib():
    rnd = random.Random(7)
    for _ in range(4000):
        a = "".join(rnd.choice("ab cd") for _ in range(rnd.randint(0, 60)))
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            if b and rnd.random() < 0.5:
                del b[rnd.randrange(len(b))]
            else:
                b.insert(rnd.randint(0, len(b)), rnd.choice("ab cd"))
        b = "".join(b)
        assert similar(a, b, 0.9) == (SequenceMatcher(None, a, b).ratio() >= 0.9)


def test_block_edges_equal_brute_force():
    rnd = random.Random(11)
    keys = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    edges = set(block_pair_edges(keys, list(range(150)), keys, list(range(150)), True, 0.9))
    ref = {(i, j) for i in range(150) for j in range(i + 1, 150) if SequenceMatcher(None, keys[i], keys[j]).ratio() >= 0.9}
    assert edges == ref


def test_block_edges_long_keys():
    """Keys of 200 characters and more, where difflib leaves popular characters out, and many different trigrams."""
    rnd = random.Random(5)
    keys = []
    for _ in range(12):
        base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rnd.randint(150, 420)))
        for _ in range(4):
            k = list(base)
            for _ in range(rnd.randint(0, 30)):
                k[rnd.randrange(len(k))] = rnd.choice("abcdefghijklmnopqrstuvwxyz ")
            keys.append("".join(k))
    keys = list(dict.fromkeys(keys))
    n = len(keys)
    edges = set(block_pair_edges(keys, list(range(n)), keys, list(range(n)), True, 0.9))
    assert edges == {(i, j) for i in range(n) for j in range(i + 1, n) if SequenceMatcher(None, keys[i], keys[j]).ratio() >= 0.9}


def test_tiles_find_every_edge(spark):
    """Small blocks, many length classes: the same edges as all pairs."""
    from revlens.operators.neardup import similar_edges
    rnd = random.Random(13)
    keys = list(dict.fromkeys("".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 30))) for _ in range(120)))
    df = spark.createDataFrame([("g", i, k) for i, k in enumerate(keys)], "session_id string, idx long, key string")
    got = {(r.a_idx, r.b_idx) for r in similar_edges(df, 0.9, ["session_id"], block=10).collect()}
    n = len(keys)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if SequenceMatcher(None, keys[i], keys[j]).ratio() >= 0.9}


def test_keys_are_sent_once_while_a_class_fits_a_block(spark, monkeypatch):
    from revlens.operators import neardup as N
    sent = []
    deal = N.dealt
    monkeypatch.setattr(N, "dealt", lambda tiles, tile: sent.append(tiles) or deal(tiles, tile))
    df = spark.range(3000).selectExpr("'g' AS session_id", "id AS idx", "lpad(id, 20, 'x') AS key")
    N.similar_edges(df, 0.9, ["session_id"])
    assert sent[0].count() == 3000


def test_parts_of_a_tile_find_every_edge():
    from revlens.operators.neardup import block_pair_edges, tile_edges
    rnd = random.Random(17)
    keys = list(dict.fromkeys("".join(rnd.choice("ab ") for _ in range(rnd.randint(8, 14))) for _ in range(90)))
    a, b = keys[:50], keys[50:]
    ia, ib = list(range(50)), list(range(50, len(keys)))
    assert sorted(tile_edges(keys, ia + ib, keys, ia + ib, True, 0.9, part=16)) == sorted(block_pair_edges(keys, ia + ib, keys, ia + ib, True, 0.9))
    assert sorted(tile_edges(a, ia, b, ib, False, 0.9, part=16)) == sorted(block_pair_edges(a, ia, b, ib, False, 0.9))


def test_exact_dedup_prepares_a_text_once(spark):
    from revlens.plans.cleaning import b06
    plan = b06(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "regexp_replace" not in plan


def test_greedy_resolution_of_a_long_chain(spark):
    """Item i is similar to i + 1 only: more than twelve rounds, every second item stays."""
    from revlens.operators.neardup import first_independent_set
    n = 28
    v = spark.createDataFrame([("g", i) for i in range(n)], "session_id string, idx long")
    e = spark.createDataFrame([("g", i, i + 1) for i in range(n - 1)], "session_id string, a_idx long, b_idx long")
    got = {r.idx: r.kept for r in first_independent_set(v, e, ["session_id"]).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}


def test_near_dedup_matches_sequential_scan(spark):
    from revlens.operators.neardup import near_dedup
    rnd = random.Random(3)
    base = ["the parcel arrived late and damaged", "support answered within an hour", "price is fair",
            "the app crashes when i pay", "great value for the money"]
    keys = []
    for _ in range(60):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            s[rnd.randrange(len(s))] = rnd.choice("abcdefgh ")
        keys.append("".join(s))
    df = spark.createDataFrame([("g", i, k) for i, k in enumerate(keys)], "session_id string, idx long, key string")
    got = {r.idx: r.near_dup for r in near_dedup(df, ["session_id"], 0.9).collect()}
    assert [got[i] for i in range(60)] == near_dedup_reference(keys, 0.9)


def test_profiles_and_overlap(spark):
    p = spark.createDataFrame([(1, [" Delivery Speed Issues ", "Delivery Speed", "", "Price"]), (2, ["Only"])],
                              "user_id long, categories array<string>")
    v = {r.user_id: r for r in C.validate_profiles(p).collect()}
    assert v[1].valid and v[1].categories == ["Delivery Speed Issues", "Delivery Speed", "Price"] and not v[2].valid
    valid = C.validate_profiles(p).filter("valid")
    pairs = C.overlapping_categories(valid).collect()
    assert [(r.i, r.j, r.overlap) for r in pairs] == [(0, 1, 0.6667)]
    assert [r.overlap for r in C.overlapping_categories(valid, denom="min").collect()] == [1.0]


def test_batches(spark):
    df = spark.range(37).select(F.col("id").cast("int").alias("review_id"))
    sizes = sorted(r[1] for r in C.assign_batches(df).groupBy("batch_no").count().collect())
    assert sizes == [7, 15, 15]
