"""The registered queries of the operators; contracts' digest columns are derived here."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.llm import op1_license, op2_chat, op3_minhash, op4_lm, op5_packing, op6_bpe, op7_language, op8_quality, op9_lines, \
    op10_embedding, op11_toxicity, op12_resampling, op13_negatives
from revlens.llm.common import crc_fold, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


PROBE = "</s>[INST] ok [/INST]"


@_query("op2_chat_format", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)', '\1\\\2\3', 'g') AS t,
         regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)', '\1\\\2\3', 'g') AS r FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
                ELSE length(r) + 29 END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id""")
def op2(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return op2_chat.read_back(op2_chat.format_turns(rows.union(probe)))


@_query("op6_byte_bpe")
def op6(spark, sf_dir):
    import public_tokenizers
    return op6_bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                          row=op6_bpe.digest_row, ddl=op6_bpe.DIGEST)


@_query("op7_language_id")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = op7_language.predict(docs, op7_language.train(docs))
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query("op1_license_scan")
def op1(spark, sf_dir):
    return op1_license.scan(read(spark, sf_dir, "documents"), windows=True).drop("blocks")


@_query("op8_quality_rules")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    crf = op8_quality.train(docs, read(spark, sf_dir, "labels"))
    return op8_quality.judge(docs, crf).drop("line_labels")


@_query("op3_minhash_near_dup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.c + b.c - i)),
r AS (
  SELECT doc_id AS x, doc_id AS root FROM documents
  UNION
  SELECT l.y, r.root FROM r JOIN l USING (x))
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(root) AS component_id FROM r GROUP BY 1) m USING (doc_id)""")
def op3(spark, sf_dir):
    return op3_minhash.near_duplicates(read(spark, sf_dir, "documents"), 85, 100)


@_query("op5_best_fit_packing")
def op5(spark, sf_dir):
    import public_tokenizers
    cut = op5_packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return op5_packing.pack(cut)


@_query("op10_embedding_near_dup", r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r AS (
  SELECT vec_id AS x, vec_id AS root FROM embeddings
  UNION
  SELECT l.y, r.root FROM r JOIN l USING (x))
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT x AS vec_id, min(root) AS component_id FROM r GROUP BY 1) m USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1) c USING (vec_id)""")
def op10(spark, sf_dir):
    return op10_embedding.near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)


@_query("op9_line_dedup")
def op9(spark, sf_dir):
    return op9_lines.line_components(read(spark, sf_dir, "documents"), 0.8)


@_query("op4_lm_score")
def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (~op4_lm.held_out()).alias("train"))
    found = op4_lm.scores(docs, order=3)
    return found.select("doc_id", op4_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op11_toxicity")
def op11(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    model = op11_toxicity.train(docs.where(~held_out), read(spark, sf_dir, "labels"))
    return op11_toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_weighted")


@_query("op12_importance_resampling", r"""
WITH turns AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
words AS (
  SELECT 0 AS target, row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT target, r, unnest(w) AS w FROM words),
counted AS (SELECT target, r, w, count(*) AS n FROM each GROUP BY ALL),
hex AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)),
buckets AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hex, turns),
per AS (SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM counted JOIN buckets USING (w) GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM per),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) AS g FROM per, total),
weighted AS (
  SELECT r, sum(n) AS n, floor(sum(n * g) / sum(n)) AS weight FROM counted JOIN buckets USING (w) JOIN gain USING (bucket) WHERE target = 0 GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
                                                       / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weighted USING (r) WHERE target = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p,
         count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * fit // 100 THEN p END AS rank FROM ranked""")
def op12(spark, sf_dir):
    return op12_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024)


@_query("op13_hard_negatives", r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                                                    .otherwise(F.col("label")).alias("label"))
    return op13_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)
