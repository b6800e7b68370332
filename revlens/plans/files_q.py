"""Registered file sources and sinks (A1, A3-A5, A7-A9) and positions.

Files are written from the driver's tables into the shared folder and read back by the
operator under test; the SQL twins state what must come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revlens.functions.exprs import dense_index
from revlens.operators import clean as C
from revlens.plans.catalog import register
from revlens.plans.cleaning import LINES_SQL, doc_lines
from revlens.plans.retrieval_q import part_solutions
from revlens.plans.sqlbits import with_feedback
from revlens.session import checkpoint_dir
from revlens.sources import files as S
from revlens.sources.tables import feedback, read_table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


REVIEW = "CASE WHEN p_size % 10 = 0 THEN 'NaN' WHEN p_size % 10 = 1 THEN '  ' ELSE p_name || ', \"' || p_type || '\"' END"


@register("a01_csv_source", f"""
SELECT regexp_replace(text, '^ +| +$', '', 'g') AS text FROM (SELECT {REVIEW} AS text FROM part)
WHERE trim(text) <> '' AND lower(text) <> 'nan'""")
def a01(spark, sf_dir):
    """Two kinds of files in one folder, with the review column at other places under other names."""
    p = read_table(spark, sf_dir, "part").withColumn("r", F.expr(REVIEW.replace('"', '\\"')))
    path = _folder(spark, "csv")
    first = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("r").alias("Customer Review"))
    second = p.filter("p_partkey % 2 = 1").select(F.col("r").alias("comment"), "p_size", "p_brand")
    for df in (first, second):
        df.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_reviews_csv(spark, path).select("text")


@register("a03_row_cap", "WITH " + LINES_SQL + """
SELECT session_id, row_ord, line_no, text FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY row_ord, line_no) AS k FROM lines) WHERE k <= 50""")
def a03(spark, sf_dir):
    return C.limit_per_session(doc_lines(spark, sf_dir), 50)


@register("a05_extract_reviews", f"""
SELECT p_partkey, trim(text) AS text FROM (SELECT p_partkey, CASE WHEN p_size % 10 <> 2 THEN {REVIEW} END AS text FROM part)
WHERE text IS NOT NULL AND trim(text) <> '' AND lower(trim(text)) <> 'nan'""")
def a05(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 10 != 2, F.expr(REVIEW.replace('"', '\\"')))
    return C.extract_reviews(p.select("p_partkey", text.alias("text")), "text")


@register("a07_solution_files", """
SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(CASE WHEN ends_with(p_brand, '1') THEN NULL ELSE split_part(p_type, ' ', 1) END, 'General') AS industry,
       p_type AS issue_type, p_name AS problem, 'Replace with ' || p_brand AS solution, 'medium' AS impact, 'medium' AS effort, 'short_term' AS timeframe,
       p_name AS tags
FROM part""")
def a07(spark, sf_dir):
    """JSON documents as written by several tasks, and one file that cannot be read."""
    path = _folder(spark, "json")
    part_solutions(spark, sf_dir).write.json(path)
    read_table(spark, sf_dir, "region").select(F.lit("{broken").alias("value")).limit(1).write.mode("append").text(path)
    return S.read_solutions(spark, path, lines=True).withColumn("tags", F.array_join("tags", " "))


@register("a08_results_round_trip", with_feedback() + "SELECT session_id, review_id, sentiment, primary_category, core_issue, CAST(created_at AS VARCHAR) AS created_on FROM feedback")
def a08(spark, sf_dir):
    path = _folder(spark, "results")
    S.write_results(feedback(spark, sf_dir), path)
    return S.read_results(spark, path).select("session_id", "review_id", "sentiment", "primary_category", "core_issue", F.col("created_at").cast("string").alias("created_on"))


@register("a09_csv_export", with_feedback() + """
SELECT session_id, CAST(review_id AS VARCHAR) AS "ID", review AS "Review", sentiment AS "Sentiment", coalesce(secondary_category, '—') AS "Secondary Category"
FROM feedback""")
def a09(spark, sf_dir):
    path = _folder(spark, "export")
    S.export_csv(feedback(spark, sf_dir), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("session_id", "ID", "Review", "Sentiment", "Secondary Category")


@register("b10_positions", "WITH " + LINES_SQL + """
SELECT session_id, row_ord, line_no, row_number() OVER (PARTITION BY session_id ORDER BY row_ord, line_no) - CAST(1 AS BIGINT) AS idx FROM lines""")
def b10(spark, sf_dir):
    lines = C.add_line_block(doc_lines(spark, sf_dir))
    return dense_index(lines, C.KEYS, C.ORDER, ["row_ord", "line_blk"], "idx").select("session_id", "row_ord", "line_no", "idx")
