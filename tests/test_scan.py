import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.functions.scan import segmented


def rows(seed=3):
    """One user with a third of all rows, one without an id, many small ones, nulls in the order column."""
    rnd = random.Random(seed)
    out = []
    for i in range(900):
        user = 7 if i % 3 == 0 else None if i % 50 == 1 else rnd.randrange(100, 300)
        out.append((user, None if rnd.random() < 0.05 else rnd.randrange(60), i, rnd.randrange(9), f"n{i}" if i % 4 else None))
    return out


def compare(spark, descending, pieces):
    df = spark.createDataFrame(rows(), "user long, at long, id long, x long, name string").repartition(5)
    got = segmented(df, ["user"], ["at", "id"], sums={"sum_x": F.col("x"), "n_named": F.when(F.col("name").isNull(), 0).otherwise(1)}, position="pos",
                    total="n", before={"prev_id": "id", "prev_name": "name"}, descending=descending, pieces=pieces)
    way = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in ("at", "id")]
    w = Window.partitionBy("user").orderBy(*way)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("x").over(upto).alias("sum_x"), F.sum(F.when(F.col("name").isNull(), 0).otherwise(1)).over(upto).alias("n_named"),
                     F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("user")).alias("n"),
                     F.lag("id").over(w).alias("prev_id"), F.lag("name").over(w).alias("prev_name"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_segmented_scan_equals_windows(spark):
    for descending in (False, True):
        compare(spark, descending, 16)
    compare(spark, False, 1)


def test_a_large_group_lies_in_several_pieces(spark, monkeypatch):
    from revlens.functions import scan
    seen = []
    real = scan.cut_lineage
    monkeypatch.setattr(scan, "cut_lineage", lambda d: seen.append(real(d)) or seen[-1])
    df = spark.createDataFrame(rows(), "user long, at long, id long, x long, name string")
    segmented(df, ["user"], ["at", "id"], position="pos", pieces=12).count()
    per = {r["_piece"]: r["n"] for r in seen[0].where("user = 7").groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(per) >= 4 and max(per.values()) < 150 and sum(per.values()) == 300


def test_segmented_scan_of_nothing(spark):
    df = spark.createDataFrame([], "user long, at long")
    assert segmented(df, ["user"], ["at"], sums={"s": F.col("at")}, position="pos", total="n", before={"p": "at"}).count() == 0
