"""As-of joins with a recording dealt to cells of time: the same rows as in one task, and many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import asof


@pytest.mark.parametrize("cell", [0.5, 7.0, 1e6])
def test_cells_change_nothing(spark, cell):
    rng = random.Random(1)
    keys = ["a", "b", None, "left only"]
    left = spark.createDataFrame([(rng.choice(keys), k, None if rng.random() < 0.05 else round(rng.uniform(-50, 50), 1)) for k in range(300)], "rec string, seq long, t double")
    times = sorted({(rng.choice([*keys[:3], "right only"]), round(rng.uniform(-40, 40), 1)) for _ in range(60)}, key=repr)
    right = spark.createDataFrame([(r, t, k) for k, (r, t) in enumerate(times)], "rec string, t double, hit long")
    told = lambda df, c: sorted(((r["seq"], r[c]) for r in df.collect()), key=repr)
    known = left.where("t IS NOT NULL")
    for bounded in (True, False):
        assert told(asof.backward(known, right, ["rec"], "t", ["hit"], bounded, cell=cell), "hit") == told(asof.backward(known, right, ["rec"], "t", ["hit"], bounded), "hit")
    assert told(asof.nearest(known, right, ["rec"], "t", ["hit"], cell=cell), "hit") == told(asof.nearest(known, right, ["rec"], "t", ["hit"]), "hit")
    values = right.withColumn("value", F.col("hit") * 1.5).drop("hit")
    assert told(asof.interpolated(known, values, ["rec"], "t", "value", cell=cell), "value") == told(asof.interpolated(known, values, ["rec"], "t", "value"), "value")
    assert asof.around(left, right, ["rec"], "t", ["hit"], cell).where("t IS NULL AND (before IS NOT NULL OR after IS NOT NULL)").count() == 0
    assert asof.backward(left.where("false"), right, ["rec"], "t", ["hit"], cell=cell).count() == 0
    assert asof.backward(known, right.where("false"), ["rec"], "t", ["hit"], cell=cell).where("hit IS NOT NULL").count() == 0


def test_a_long_recording_is_many_tasks(spark):
    """A million samples of one recording: no task has more than a few cells of them."""
    left = spark.range(1_000_000).select(F.lit("hot").alias("rec"), (F.col("id") / 10).alias("t"))
    right = spark.range(1000).select(F.lit("hot").alias("rec"), (F.col("id") * 100.0 + 50).alias("t"), F.col("id").alias("hit"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = asof.nearest(left, right, ["rec"], "t", ["hit"], cell=500.0).withColumn("part", F.spark_partition_id())
        sizes = [r["n"] for r in out.groupBy("part").agg(F.count("hit").alias("n")).collect()]
        assert sum(sizes) == 1_000_000 and len(sizes) == 16 and max(sizes) < 150_000
        assert out.where(F.abs(F.col("t") - (F.col("hit") * 100 + 50)) > 50).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
