"""Required numbers, outputs that collide, tables replaced as a whole, priors, names."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronoweave.functions import scalars
from chronoweave.operators import alignment, quality
from chronoweave.sources import tables


def test_required_numbers(spark):
    df = spark.createDataFrame([(1, "2.5"), (2, None), (3, "x"), (4, "inf"), (5, " ")], "k int, v string")
    assert [r["s"] for r in df.select("k", scalars.number_status(F.col("v")).alias("s")).orderBy("k").collect()] == ["ready", "missing", "not a number", "not finite", "missing"]
    assert df.where("k = 1").select(scalars.required(F.col("v"), "row").alias("x")).first()["x"] == 2.5
    for k in (2, 3, 4, 5):
        with pytest.raises(PySparkException, match="row has no finite number"):
            df.where(f"k = {k}").select(scalars.required(F.col("v"), "row").alias("x")).collect()


def test_outputs(spark):
    files = spark.createDataFrame([(p,) for p in ("/a/x.mp4", "/b/x.MKV", "/a/y.mp4", "/a/z.txt", "/a/mp4", "/a/.mp4", "/a/v.1.mp4")], "path string")
    got = {r["path"]: (r["output"], r["status"]) for r in quality.outputs(files, ["mp4", ".mkv"], "_p.csv").collect()}
    assert got == {"/a/x.mp4": ("x_p.csv", "collision"), "/b/x.MKV": ("x_p.csv", "collision"), "/a/y.mp4": ("y_p.csv", "ready"), "/a/v.1.mp4": ("v.1_p.csv", "ready")}


def test_tables_are_replaced_whole(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, there boolean")
    assert tables.write_contract(df, at, ["k", "there"]) and not tables.write_contract(df, at, ["k", "there"])
    read = lambda: sorted((r["k"], r["there"]) for r in spark.read.option("header", True).csv(at).collect())
    assert read() == [("1", "true"), ("2", "false"), ("3", None)]  # flags in small letters
    broken = df.select((F.col("k") / F.when(F.col("k") < 9, F.raise_error(F.lit("stop")).cast("int"))).alias("k"), "there")
    with pytest.raises(PySparkException):
        tables.write_contract(broken, at, ["k", "there"], overwrite=True)
    assert read() == [("1", "true"), ("2", "false"), ("3", None)]  # the old table stands
    assert tables.write_contract(df.where("k = 2"), at, ["k", "there"], overwrite=True) and read() == [("2", "false")]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("out.old")] == []


def test_priors_and_names(spark):
    rows = [(1, 5.0, 1), (1, 5.25, 2), (1, None, 3), (1, float("nan"), 4), (1, 5.3, 5), (2, 1.0, 2), (2, 2.0, 1)] + [(3, float(k), k) for k in range(20)]
    got = alignment.merged_priors(spark.createDataFrame(rows, "rec long, prior double, rank long")).orderBy("rec", "rank").collect()
    assert [(r["rec"], r["prior"]) for r in got] == [(1, 5.0), (1, 5.3), (2, 2.0), (2, 1.0)] + [(3, float(k)) for k in range(8)]
    names = spark.createDataFrame([("p", "T1", "V1", None), ("p", "T1", " ", "main"), (None, "T1", "V1", "b")], "a string, b string, c string, d string")
    assert [r["n"] for r in names.select(scalars.identity_text(*[F.col(c) for c in "abcd"]).alias("n")).collect()] == ["p/T1/V1", "p/T1", "T1/V1/b"]
