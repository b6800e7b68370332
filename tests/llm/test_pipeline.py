import math
import re

import corpus_pipeline
from pyspark.sql import functions as F

from .brute import line_components, near_documents

import __spark_entry__


def test_stages_equal_plain_versions(spark, rng, tmp_path):
    """Each stage against a plain version of its rule, on its predecessor's documents."""
    def sentence():
        return " ".join(f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('rst')}{rng.randrange(40)}x" for _ in range(14)) + "."
    shared = sentence()
    docs = []
    for i in range(40):
        docs.append((i, "\n".join([*(sentence() for _ in range(7)), *([shared] if i % 4 == 0 else [])]), "aa"))
    docs += [(100, docs[3][1], "aa"), (101, "123 456", "aa"), (102, None, None), (103, "too short", "aa"), (104, docs[5][1] + "\n" + sentence(), "aa")]
    # the same words in other lines: only the document stage sees it
    docs += [(105, docs[7][1].replace("\n", " "), "aa")]
    path = tmp_path.as_posix()
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long")) \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    table = spark.read.parquet(f"{path}/documents.parquet")
    now, state = table, {i: t for i, t, _ in docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        if name == "language_id":
            state = {i: t for i, t in state.items() if t and re.search("[a-z]", t)}
        elif name == "quality_rules":
            state = {i: t for i, t in state.items() if len(t.split()) >= 50}
        elif name == "line_dedup":
            comp = line_components(sorted(state.items()))
            lines = {i: [x for n, x in enumerate(t.split("\n")) if comp[(i, n)] == (i, n)] for i, t in state.items()}
            state = {i: "\n".join(x) for i, x in lines.items() if x}
        elif name == "near_dedup":
            comp = near_documents(sorted(state.items()), 80, 100)
            state = {i: t for i, t in state.items() if comp[i][1] == i}
            assert 105 not in state and 100 not in state and 7 in state
        if name != "best_fit_packing":
            assert out.columns == table.columns
            rows = out.collect()
            assert {r["doc_id"]: r["text"] for r in rows} == state and all(r["n_chars"] == len(r["text"]) for r in rows)
            now = spark.createDataFrame(rows, out.schema)
        else:
            got = out.collect()
            assert {r["doc_id"] for r in got} == set(state)
            assert len({r["sequence_id"] for r in got}) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert {tuple(r) for r in corpus_pipeline.run(spark, path).select("doc_id", "piece", "ids_crc32").collect()} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in got}


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, null and blank texts, ids with two texts, clashing columns; then no rows at all."""
    import random
    rnd = random.Random(8)
    vocabulary = ["garden", "window", "letter", "station", "morning", "paper", "river", "simple", "yellow", "market", "quiet", "summer"]

    def line(tag):
        return " ".join(rnd.choices(vocabulary, k=14)) + f" {tag}."
    texts = ["\n".join(line(f"{i} {k}") for k in range(6)) for i in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (4, texts[29] + "\n" + line("own"), "en"), (None, texts[5], "en"), (None, texts[5], None), (50, None, "en"), (51, "", None), (52, " \n ", "en"),
             (53, texts[7], "en"), (54, "²² ½½ ①①", None)]
    clash = ["label", "score", "kept", "line", "node", "component", "digest", "body", "__id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "length(text) AS n_chars", *[f"'x' AS {c}" for c in clash])
    path = tmp_path.as_posix()
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    step = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, path)
        assert step.columns == docs.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in step.select("doc_id", "text").collect()), key=str)
    assert kept["language_id"] == sorted([(i, t) for i, t, _ in rows if t and t.strip() and i != 54], key=str)
    assert kept["quality_rules"] == kept["language_id"]
    ids = [i for i, _ in kept["line_dedup"]]  # document 29 stands whole in the second text of id 4, 53 in document 7
    assert (4, rows[31][1]) in kept["line_dedup"] and (4, texts[4]) in kept["line_dedup"] and 29 not in ids and 53 not in ids
    assert [i for i, _ in kept["line_dedup"]].count(3) == 2 and [i for i, _ in kept["line_dedup"]].count(None) == 2
    assert kept["near_dedup"] == kept["line_dedup"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, step, path)
    assert pieces.count() == len(kept["near_dedup"])
    empty = f"{path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_run_on_small_batches(spark, tmp_path, monkeypatch):
    """Every stage meets the small batch size, which is set back afterwards."""
    seen = []

    def stage(spark, docs, sf_dir):
        sizes = docs.mapInArrow(lambda batches: (b.select(["doc_id"]) for b in batches if b.num_rows <= 1000), "doc_id long")
        seen.append(sizes.count())
        return docs

    spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(corpus_pipeline.BATCH)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2500
    assert seen == [2500, 2500]
    assert spark.conf.get(corpus_pipeline.BATCH) == before
