import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import elias_fano, op1_license, op2_chat, op4_lm, op5_packing, op6_bpe, op7_language, op8_quality
from revlens.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in ("n_words", "labels", "score", "length", "piece", "block", "kept", "mark", "tokens") if c not in df.columns})


ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "word"), (3, "word"), (None, "no id here"), (4, "x" * 70_000 + " end"), (5, "é漢字 ​’s 😀 'll"),
       (6, "tab\tand\x0bvertical\x1c\x85separators")]


# --- 1 -------------------------------------------------------------------------
def test_license_scan(spark):
    rows = ODD + [(10, "Intro.\nReleased under the MIT License.\nMore."), (11, "licensed under CC\nBY-NC 4.0, cc-by"), (12, "All rights reserved. All rights\nreserved"),
                  (13, "This work is licensed under the GNU General Public License, version 3."), (14, "rights reserved"), (15, "ALL RIGHTS RESERVED" + " w" * 50_000 + " all rights reserved")]
    got = {r["doc_id"]: r for r in op1_license.scan(frame(spark, rows)).collect()}
    assert len(op1_license.scan(frame(spark, rows)).collect()) == len(rows)
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted(i for p in op1_license.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        base = sorted(lab for p, lab in op1_license.BASE.items() if any(w[i:i + len(p.split())] == p.split() for i in range(len(w))))
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0] if places else None, places[-1] if places else None)
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(",")))
        want = {lab for lab, ts in op1_license.TEMPLATES.items() for t in ts for line in low.split("\n")
                if len(set(t.split()) & set(op1_license.words(line))) >= 0.9 * len(set(t.split())) - 1e-9}
        assert set(filter(None, r["labels"].split(","))) == want | set(base) and 0 <= r["score"] <= 1
    assert got[10]["labels"] == "notice-mit" and got[14]["labels"] == ""
    assert op1_license.scan(frame(spark, [])).count() == 0


def test_license_filters_lose_nothing(rng):
    """Prefix, length and positional filters against plain containment, at several thresholds."""
    vocabulary = [f"w{i}" for i in range(14)]
    templates = {f"t{i}": [" ".join(rng.sample(vocabulary, rng.randint(1, 9)))] for i in range(12)}
    for threshold in (0.5, 0.75, 0.9, 1.0):
        index = op1_license.Index.build({w: rng.randrange(9) for w in vocabulary}, templates, threshold)
        for _ in range(300):
            block = set(rng.sample(vocabulary, rng.randint(0, 12)))
            want = {lab for lab, (t,) in templates.items() if len(set(t.split()) & block) >= threshold * len(set(t.split())) - 1e-9}
            assert {lab for lab, _ in index.matches(block)} == want


def test_license_query_reads_across_lines(spark, tmp_path):
    rows = [(0, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
            (1, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"),
            (2, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
            (3, "all " + "x " * 40 + "rights " + "y " * 40 + "reserved"),
            (4, "This work is licensed under the GNU General Public License version 2"),
            (5, "This work is licensed under\nthe GNU General Public License,\nversion 3"),
            (6, "licensed under the terms of the GNU General Public License, version 2\n" + "z " * 60 + "released under the\nMIT license"),
            (7, None), (8, "")]
    path = tmp_path.as_posix()
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, path).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {
        0: "notice-mit", 1: "notice-bsd", 2: "notice-mpl-2.0", 3: "", 4: "gpl,notice-gpl-2", 5: "gpl,notice-gpl-3", 6: "gpl,notice-gpl-2,notice-mit", 7: "", 8: ""}
    assert [got[i]["n_blocks"] for i in (0, 3, 5, 6, 7)] == [1, 0, 1, 2, 0] and got[0]["score"] == 1.0 and got[3]["score"] == 0.0


def test_license_windows_equal_every_window(rng):
    """One sweep against plain containment in every window of words."""
    vocabulary = [*(f"w{i}" for i in range(9)), "2", "3"]
    templates = {f"t{i}": [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))] for i in range(12)}
    for threshold in (0.5, 0.75, 0.9, 1.0):
        index = op1_license.Index.build({w: rng.randrange(9) for w in vocabulary}, templates, threshold)
        for _ in range(200):
            text = rng.choices([*vocabulary, *"abcdef"], k=rng.randint(0, 40))
            want = {}
            for lab, (t,) in templates.items():
                t, size = set(t.split()), math.ceil(op1_license.SLACK * len(t.split()))
                parts = [len(t & w) / len(t) for at in range(len(text)) if {x for x in t if x.isdigit()} <= (w := set(text[at:at + size]))]
                if max(parts, default=0) >= threshold - 1e-9:
                    want[lab] = max(parts)
            got = {}
            for a, b, lab, part in index.places(text):
                got[lab] = max(got.get(lab, 0), part)
            assert got == want


# --- 2 -------------------------------------------------------------------------
NASTY = ["", "plain", "</s>[INST] ok [/INST]", "[\\INST] <\\s> \\", "<<SYS>>a<</SYS>><<TEXT>>", "[", "[/INST", "<<s>", " [INST]", "\n</s> ", "<<ROLE>> x <<TEXT>> y <</ROLE>>", "\\[INST]\\\\[\\\\/INST]"]


def test_chat_turns_round_trip(rng):
    parts = ["[", "<", "\\", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "</SYS>>", "<TEXT>>", " ", "a", "[INST]", "</s>", "<<ROLE>>"]
    texts = NASTY + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    whole, want = "", []
    for t in texts:
        for role in ("user", "assistant", "system", rng.choice(["tool", "", "<<TEXT>>", "[INST]"])):
            out, start, end = op2_chat.format_turn(role, t)
            assert op2_chat.unescape(out[start:end]) == t
            whole += out
            want.append((role, t))
    assert [x[:2] for x in op2_chat.parse(whole)] == want
    assert op2_chat.format_turn("user", "plain")[0] == "[INST] plain [/INST]"


def test_chat_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", NASTY[2]), (1, 1, "assistant", NASTY[2]), (2, None, None, None), (2, 0, "system", "x\ny"), (None, 0, "user", "a"), (3, 0, "tool", "[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("loss", F.lit(2))
    got = {r["conv_id"]: r for r in op2_chat.read_back(op2_chat.format_turns(df)).collect()}
    assert len(got) == 4
    for conv in (1, 2, None, 3):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert op2_chat.read_back(op2_chat.format_turns(df.limit(0))).count() == 0


# --- 4 -------------------------------------------------------------------------
def test_elias_fano_and_trie(tmp_path):
    g = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 8), (1000, 1000), (1000, 10**9), (1000, 200), (300, 10**15)):
        v = np.sort(g.integers(0, u, n))
        e = elias_fano.EliasFano.build(v, u)
        if n:
            assert (e.access(np.arange(n)) == v.astype(np.uint64)).all()
        x = np.concatenate((v, g.integers(0, u, 500)))
        place, found = e.successor(x)
        known = set(v.tolist())
        assert (found == np.array([int(a) in known for a in x], bool)).all() and (v[place[found]] == x[found]).all()
    k = np.unique(g.integers(0, 500, 20_000) * 3000 + g.integers(0, 3000, 20_000))
    lp = -g.random(len(k)) * 10
    path = tmp_path / "level"
    path.write_bytes(elias_fano.Trie.build(k // 3000, k % 3000, lp, 3000).to_bytes())
    trie = elias_fano.open_trie(str(path))
    words = np.arange(3000)
    got, known = trie.lookup(words, k // 3000, k % 3000)
    assert known.all() and np.abs(got - lp).max() <= elias_fano.STEP
    q = g.integers(0, 500 * 3000, 20_000)
    assert (trie.lookup(words, q // 3000, q % 3000)[1] == np.isin(q, k)).all()
    assert (trie.successors(17)[0] == k[k // 3000 == 17] % 3000).all() and len(trie.successors(2999)[0]) == 0


def test_lm_scores_equal_plain_model(spark, rng):
    rows = ODD + [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 120)))) for i in range(20, 80)] + [(80, "the " * 3000)]
    df = frame(spark, rows).withColumn("train", F.col("doc_id") % 5 != 1)
    toks = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"] for _, t in rows]
    fit = [t for (i, _), t in zip(rows, toks) if i is not None and i % 5 != 1]
    c, pairs = Counter(w for t in fit for w in t), Counter((v, w) for t in fit for v, w in zip([b"\r", *t], t))
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    c[b"\r"] = len(fit)
    for sizes in ({"block_tokens": 500, "shard_tokens": 400}, {}):
        got = sorted(op4_lm.scores(df, **sizes).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
        want = sorted(zip(rows, toks), key=lambda r: (r[0][0] is None, r[0][0] or 0, len(r[1])))
        assert len(got) == len(rows)
        for r, ((doc_id, _), t) in zip(got, want):
            assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc_id, len(t), sum(c[w] > 0 for w in t), n)
            assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / d) for w in t), rel_tol=1e-9, abs_tol=1e-9)
            score = sum(math.log10((0.3 * pairs[v, w] + (1 + 0.7 * c[v]) * (c[w] + 0.5) / d) / (c[v] + 1)) for v, w in zip([b"\r", *t], t))
            assert abs(r["score"] - score) <= len(t) * elias_fano.STEP
    empty = op4_lm.scores(df.limit(0))
    assert empty.count() == 0
    untrained = op4_lm.scores(frame(spark, [(1, "a b")]).withColumn("train", F.lit(False))).first()
    assert (untrained["train_tokens"], untrained["n_known"], untrained["base_score"]) == (0, 0, 0.0)


def test_lm_scores_of_order_3_equal_plain_model(spark, rng):
    rows = ODD + [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 120)))) for i in range(20, 80)] + [(80, "the " * 3000)]
    df = frame(spark, rows).withColumn("train", F.col("doc_id") % 5 != 1)
    toks = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"] for _, t in rows]
    fit = [[b"\r", *t] for (i, _), t in zip(rows, toks) if i is not None and i % 5 != 1]
    c, c2, c3 = (Counter(x for t in fit for x in zip(*(t[k:] for k in range(n)))) for n in (1, 2, 3))
    d = sum(c.values()) - len(fit) + 0.5 * len(c)  # the begin mark is in c

    def p(*w):
        if len(w) == 1:
            return (c[w] + 0.5) / d
        up, at = ({2: c, 3: c2}[len(w)][w[:-1]], {2: c2, 3: c3}[len(w)][w])
        return (0.3 * at + (1 + 0.7 * up) * p(*w[1:])) / (up + 1)

    for sizes in ({"block_tokens": 500, "shard_tokens": 400}, {}):
        got = sorted(op4_lm.scores(df, order=3, **sizes).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
        want = sorted(zip(rows, toks), key=lambda r: (r[0][0] is None, r[0][0] or 0, len(r[1])))
        assert len(got) == len(rows)
        for r, ((doc_id, _), t) in zip(got, want):
            t = [b"\r", *t]
            score = sum(math.log10(p(*t[max(0, i - 2):i + 1])) for i in range(1, len(t)))
            assert r["doc_id"] == doc_id and abs(r["score"] - score) <= len(t) * elias_fano.STEP
    assert op4_lm.scores(df.limit(0), order=3).count() == 0


# --- 5 -------------------------------------------------------------------------
def best_sum(lengths, room):
    reach = {0}
    for n in lengths:
        reach |= {r + n for r in reach if r + n <= room}
    return max(reach)


def test_fullest_is_the_best_subset(rng):
    for _ in range(300):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 14))]
        room = rng.randint(0, 120)
        got = op5_packing.fullest(sorted(Counter(lengths).items(), reverse=True), room)
        assert not Counter(dict(got)) - Counter(lengths)
        assert sum(n * k for n, k in got) == best_sum(lengths, room)


def test_word_ids_equal_the_tokenizer(rng):
    known = op5_packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    letters = ["a", "B", "z", "é", "É", "ß", "ÿ", "Ö", "'", "s", "t", ".", ",", "!?", "1", "-", "漢", "e\u0301", "ſ", "İ", "µ", "×", "\x1c", "\u00a0", "😀"]
    for _ in range(5000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        want = known.tokenizer.encode(word, add_special_tokens=False).ids
        assert list(np.frombuffer(known[word.encode()], "<u4")) == want, word
    text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(500))
    assert list(np.frombuffer(b"".join(map(known.__getitem__, text.encode().split())), "<u4")) == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, rng):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = ODD + [(100 + i, " ".join(rng.choice(["The", "word,", "naïve", "CAPS", "it's", "x-y.", "漢字", "Été!", "don't;", "3.14"]) for _ in range(rng.randint(0, 700)))) for i in range(40)]
    cut = op5_packing.pieces(frame(spark, rows), path, capacity=256, keep_ids=True)
    got = op5_packing.pack(cut, 256).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for ps in bins.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(w[3] for w in want) / 256) + 1
    assert op5_packing.pack(op5_packing.pieces(frame(spark, []), path)).count() == 0


# --- 6 -------------------------------------------------------------------------
def bpe():
    return op6_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_stitch_equals_whole(rng):
    c = bpe()
    letters = "ab'sTll  \n\t1२é漢.! \x1c\x1d\x85​😀ſ　"
    for _ in range(4000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert c.encode(c.pattern.findall(s)) == c.encoding.encode_ordinary(s)
        step, overlap = rng.choice([3, 5, 8]), rng.choice([1, 2, 4])
        starts = list(range(0, len(s), step))
        bounds = []
        for x in starts:
            body, ahead = s[x:x + step], s[x + step:x + step + overlap]
            bounds.append([x + b for b in c.boundaries(body + ahead + (" " if len(ahead) == overlap else ""), 0, len(body) + len(ahead))])
        true = c.stitch(s, starts, bounds)
        assert [s[a:b] for a, b in zip(true, true[1:])] == c.pattern.findall(s)


def test_bpe_encode_decode(spark, rng):
    path, c = public_tokenizers.path("byte_bpe_50k.tiktoken"), bpe()
    rows = ODD + [(50 + i, " ".join(rng.choice(["word", "naïve", "漢字", "\n\n", "it's"]) for _ in range(400))) for i in range(5)]
    for chunk in (64, 32_768):
        got = op6_bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=16)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((i, tuple(c.encoding.encode_ordinary(t or ""))) for i, t in rows)
    back = op6_bpe.decode(got, path, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in back) == Counter((i, (t or "").encode()) for i, t in rows)
    assert op6_bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


# --- 7 -------------------------------------------------------------------------
def test_language_id(spark, rng):
    stock = {"aa": "banana canal papaya malaga", "bb": "kitten fitting sitting mitten", "cc": "öde über grün schön"}
    rows = [(i, " ".join(rng.choice(stock[la].split()) for _ in range(12)), la) for i in range(120) for la in [rng.choice(list(stock))]]
    odd = next(i for i in range(503, 600) if i != 504 and zlib.crc32(str(i).encode()) % 3 == 1)  # never learned from
    rows += [(500, None, "aa"), (501, "12 !", "aa"), (502, "kitten", None), (None, "über grün", "aa"), (odd, "qqqq", "bb"), (odd, "qqqq", "bb"), (504, "banana " * 20_000, "cc")]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    masks = op7_language.train(df)
    assert masks.langs == ["aa", "bb", "cc"]
    got = op7_language.predict(df, masks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 20 and all(by[i]["lang_pred"] == truth[i] for i in held)
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[501]["score"] == 0
    assert by[502]["lang_pred"] == "bb" and by[None]["lang_pred"] == "cc" and by[504]["lang_pred"] == "aa" and by[odd]["score"] < 0.1
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in op7_language.drop_unidentified(df, masks).collect()} == set(by) - {500, 501, odd}
    none = op7_language.train(df.limit(0))
    assert op7_language.predict(df.limit(0), none).count() == 0 and op7_language.predict(df, none).first()["lang_pred"] == "und"
    assert op7_language.drop_unidentified(df, none).count() == len(rows) - 2


def test_bloom_masks_contain_their_ngrams():
    m = op7_language.Masks([f"l{i}" for i in range(70)], 1 << 12, 3, 4)
    for i in range(70):
        m.add(f"gram{i}", i)
        m.add("common", i)
    m.close()
    assert all(i in m.languages(f"gram{i}") for i in range(70)) and m.languages("common") == list(range(70)) and m.rate.max() < 0.01


# --- 8 -------------------------------------------------------------------------
def test_quality_counts_and_verdicts(spark, rng):
    def good():
        return "\n".join(" ".join(f"word{rng.randrange(300)}" for _ in range(12)) + "." for _ in range(8))

    def bad():
        return "\n".join(" | ".join(f"nav{rng.randrange(300)}" for _ in range(12)) + " |" for _ in range(8))
    docs = ODD + [(100 + i, good() if i % 2 else bad()) for i in range(80)] + [(300, "same line here\n" * 40), (301, "a b c " * 30)]
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    crf = op8_quality.train(df, labels)
    got = op8_quality.judge(df, crf).collect()
    assert len(got) == len(docs)
    for (doc_id, text), r in zip(sorted(docs, key=str), sorted(got, key=lambda r: str((r["doc_id"], dict(docs)[r["doc_id"]])))):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(w, w[1:], w[2:]))
        repeat = len({j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {100 + i for i in range(60, 80) if i % 2} <= kept and not kept & {100 + i for i in range(60, 80) if not i % 2}
    assert {r["doc_id"] for r in op8_quality.drop_rejected(df, crf).collect()} == kept
    plain = op8_quality.train(df, labels.limit(0))
    assert all(r["kept"] == (not r["base_failed"]) for r in op8_quality.judge(df, plain).collect())
    assert op8_quality.judge(df.limit(0), crf).count() == 0


def test_viterbi_finds_the_best_path(rng):
    from itertools import product
    crf = op8_quality.Crf()
    g = np.random.default_rng(2)
    crf.emit, crf.move = g.normal(size=crf.emit.shape), g.normal(size=(2, 2))
    for _ in range(50):
        lines = [rng.getrandbits(len(op8_quality.FEATURES)) for _ in range(rng.randint(1, 7))]

        def total(path):
            return sum(crf.scores(b)[k] for b, k in zip(lines, path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
        assert math.isclose(total(crf.viterbi(lines)), max(map(total, product((0, 1), repeat=len(lines)))))


def test_language_filters_equal_plain_sets(spark, rng):
    """Languages of an n-gram, shares and predictions against plain sets, with exact membership where a filter says more."""
    made = {"aa": "abcdefgh", "bb": "defghijk", "cc": "mnopqräß"}
    docs = [(i, " ".join("".join(rng.choices(made[lang], k=rng.randint(2, 8))) for _ in range(rng.randint(1, 60))), lang)
            for i, lang in enumerate(rng.choices(list(made), k=240))]
    docs += [(1000, None, None), (1001, "² ½ ①12 _ -", None), (1002, "İ", None), (1003, "Ω", None)]
    masks = op7_language.train(frame(spark, docs, "doc_id long, text string, lang string"), slots=1 << 16)
    learned = [(t, lang) for i, t, lang in docs if lang and zlib.crc32(str(i).encode()) % 3 != 1]

    def plain(text):
        return [g for w in re.findall(r"[^\W\d_]+", text.lower()) if any(c.isalpha() for c in w) for g in op7_language.ngrams(w, masks.size)]
    sets = {}
    for lang in made:
        mine = [set(plain(t)) for t, x in learned if x == lang]
        held = Counter(g for s in mine for g in s)
        sets[lang] = {g for g, n in held.items() if n >= 0.02 * len(mine)}
        assert all(masks.langs.index(lang) in masks.languages(g) for g in sets[lang])  # a filter never misses
    wrong = total = 0
    for g in {g for t, _ in learned for g in plain(t)}:
        for lang in made:
            if g not in sets[lang]:
                total += 1
                wrong += masks.langs.index(lang) in masks.languages(g)
    assert wrong <= 0.02 * total + 3
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op7_language.predict(frame(spark, docs, "doc_id long, text string, lang string"), masks).collect()}
    for i, t, _ in docs[:240]:
        grams = plain(t)
        share = {lang: sum(g in sets[lang] for g in grams) / len(grams) for lang in made}
        best = max(share.values())
        assert got[i][1] == pytest.approx(best, abs=0.05) and share[got[i][0]] >= best - 0.05
    assert got[1000] == got[1001] == ("und", 0.0) and got[1003][0] != "und"
    kept = {r["doc_id"] for r in op7_language.drop_unidentified(frame(spark, docs, "doc_id long, text string, lang string"), masks).collect()}
    assert kept == {i for i, (_, score) in got.items() if score >= 0.1}


def test_crf_gradient_equals_differences():
    """One step of the fit against numerical differences of the log likelihood on every labelling."""
    from itertools import product
    rng = np.random.default_rng(3)
    k = len(op8_quality.FEATURES)
    docs = [rng.integers(0, 2, (n, k)).astype(float) for n in (1, 3, 4)]
    gold = [rng.integers(0, 2, len(d)) for d in docs]

    def likelihood(emit, move):
        total = 0.0
        for d, g in zip(docs, gold):
            def score(y):
                return sum(d[t] @ emit[:, y[t]] for t in range(len(d))) + sum(move[y[t - 1], y[t]] for t in range(1, len(d)))
            total += score(g) - np.log(sum(np.exp(score(y)) for y in product((0, 1), repeat=len(d))))
        return total
    crf = op8_quality.Crf()
    crf.emit, crf.move = rng.normal(0, 0.3, crf.emit.shape), rng.normal(0, 0.3, crf.move.shape)
    emit, move = crf.emit.copy(), crf.move.copy()
    n = sum(map(len, docs))
    crf.fit(docs, gold, rounds=1, penalty=0.0, rate=1.0)
    for name, was, now in (("emit", emit, crf.emit), ("move", move, crf.move)):
        for at in np.ndindex(*was.shape):
            e, m = emit.copy(), move.copy()
            up, down = (e, m), (emit.copy(), move.copy())
            (up[0] if name == "emit" else up[1])[at] += 1e-5
            (down[0] if name == "emit" else down[1])[at] -= 1e-5
            assert (now - was)[at] * n == pytest.approx((likelihood(*up) - likelihood(*down)) / 2e-5, abs=1e-4)
