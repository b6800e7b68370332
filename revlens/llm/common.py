"""Helpers shared by the operators: tables, shared scratch tables, Arrow batches, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


#: Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``, by whatever path Spark's readers understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a scratch one only in local runs that set none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with fresh size estimates, survives lost executors, and fixes
    whatever the planner or a retry could otherwise compute differently.  The
    shuffle files of the write go when it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave; neither they nor anything planned on them may be read afterwards."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pa_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(pa_type(name[6:-1]))
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}[name]


def pa_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat ``name type, name type`` list."""
    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    return pa.schema([(n, pa_type(t.strip())) for n, t in fields])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` with ``fn`` giving dicts of columns per input batch."""
    schema = pa_schema(ddl)

    def run(batches):
        for b in batches:
            for cols in fn(b):
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return df.mapInArrow(run, ddl)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one by one, null as the empty string."""
    for v in column:
        yield v.as_py() or ""


#: A-Z to a-z; every ASCII byte that is no letter or digit to a blank; bytes of longer characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def byte_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z; none for null."""
    return text.translate(FOLD).split() if text else []


def crc_fold(id_col: str, folds: int) -> F.Column:
    """crc32(id as text) mod ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    Alternating large-star and small-star rounds on the edge set (every round keeps
    connectivity and moves edges to smaller neighbours) until the set is a forest of
    stars.  Minima are hash aggregations with map-side combine and come back by an
    equi-join that Spark may split, so a node with a third of all edges is no
    single task's group.  Rounds write Parquet tables in the shared folder and remove
    those of the round before; a round that does not finish the work never ends the loop silently.
    Null ends and self loops are ignored; an empty edge set gives no rows.
    """
    e = (edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
         .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    e = written(e, "cc")
    for _ in range(200):
        # large star: strictly larger neighbours of u move to the smallest of u's neighbourhood
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        large = written(large, "cc")
        # small star: smaller neighbours of u, and u itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        small = written(small, "cc")
        # done when no node has two parents and no parent is a child
        parents = small.groupBy("a").count().where("count > 1").select("a")
        chains = small.select("b").join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select(F.col("b").alias("a"))
        dropped(e, large)
        e = small
        if parents.union(chains).isEmpty():
            roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    raise RuntimeError("connected components did not settle in 200 rounds")
