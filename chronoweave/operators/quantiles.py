"""Exact quantiles of groups of any size. No task holds a group's values: a sketch proposes splitters, exact counts
between them say where a wanted rank lies, and only what lies there is looked at again, until few values are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import new_folder

#: Splitters of a group in a pass, and how many distinct values may be sorted in one window.
SPLITTERS, FEW = 255, 50_000


def _bin(x: Column, splitters: Column, n: int) -> Column:
    """2i for values between the splitters i - 1 and i, 2i + 1 for those equal to splitter i. A search by halves."""
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda i, s: F.when((i + s <= F.size(splitters)) & (F.get(splitters, i + s - 1) < x), i + s).otherwise(i))
    hit = F.coalesce(F.get(splitters, below) == x, F.lit(False))
    return (2 * below + hit.cast("int")).cast("int")


def _kept(spark, df: DataFrame, folder: str, tag: str) -> DataFrame:
    """A small table that later passes must all see alike."""
    df.write.parquet(f"{folder}/{tag}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{tag}")


def exact_quantiles(rows: DataFrame, by: list[str], x: str, shares: list[float], splitters: int = SPLITTERS, few: int = FEW) -> DataFrame:
    """by, n and values: the quantiles of x at the shares, in their order, on the line between the two values around
    (n - 1) * share, as Spark's percentile and numpy have them. Nulls and NaN don't count; a group without a value has
    no row; null keys are a group.

    Each pass reads the rows anew and leaves about one in `splitters` of them; values that are a splitter have a bin of
    their own, so that repeated ones end the search. Two or three passes do for any table; each collects one number."""
    spark = rows.sparkSession
    folder = new_folder(spark, "quantiles")
    # a struct is never null, so joins by it keep null keys; without keys all rows are one group
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    base = rows.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(key.alias("key"), F.col(x).cast("double").alias("x"), F.lit("").alias("path"))
    points = F.array(*[F.lit((k + 1) / (splitters + 1)) for k in range(splitters)])
    sizes = _kept(spark, base.groupBy("key").agg(F.count("*").alias("n")), folder, "sizes")
    rank = lambda s: (F.col("n") - 1) * F.lit(float(s))
    ranks = sizes.select("key", F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(s)), F.ceil(rank(s))) for s in shares])))).alias("rank"))
    open_ = _kept(spark, ranks.select("key", F.lit("").alias("path"), "rank", F.col("rank").alias("left")), folder, "open-0")
    now, found, turn = base, [], 0
    while True:
        # path names the bins that a wanted rank was followed into
        wanted = open_.select("key", "path").distinct()
        now = now.join(wanted, ["key", "path"], "left_semi")
        small = now.groupBy("key", "path").agg(F.approx_count_distinct("x").alias("_d"))
        small = _kept(spark, small.where(F.col("_d") <= few).select("key", "path"), folder, f"small-{turn}")
        # few distinct values: counted by value and summed up in order
        counts = now.join(small, ["key", "path"], "left_semi").groupBy("key", "path", "x").agg(F.count("*").alias("_n"))
        upto = counts.withColumn("_to", F.sum("_n").over(Window.partitionBy("key", "path").orderBy("x")))
        hit = open_.join(upto, ["key", "path"]).where((F.col("left") < F.col("_to")) & (F.col("left") >= F.col("_to") - F.col("_n"))).select("key", "rank", "x")
        found.append(_kept(spark, hit, folder, f"found-{turn}"))
        open_ = open_.join(small, ["key", "path"], "left_anti")
        open_ = _kept(spark, open_, folder, f"rest-{turn}")
        if open_.isEmpty():
            break
        now = now.join(small, ["key", "path"], "left_anti")
        cuts = now.groupBy("key", "path").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", points, splitters * 20))).alias("cuts"))
        cuts = _kept(spark, cuts, folder, f"cuts-{turn}")
        now = now.join(cuts, ["key", "path"]).withColumn("bin", _bin(F.col("x"), F.col("cuts"), splitters)).drop("cuts")
        counts = now.groupBy("key", "path", "bin").agg(F.count("*").alias("_n"))
        upto = counts.withColumn("_to", F.sum("_n").over(Window.partitionBy("key", "path").orderBy("bin")))
        inside = open_.join(upto, ["key", "path"]).where((F.col("left") < F.col("_to")) & (F.col("left") >= F.col("_to") - F.col("_n")))
        next_ = F.concat_ws("/", "path", F.col("bin").cast("string"))
        # a bin of one splitter has one value; the others are followed
        at = inside.join(cuts, ["key", "path"]).where("bin % 2 = 1").select("key", "rank", F.get("cuts", F.floor(F.col("bin") / 2).cast("int")).alias("x"))
        found.append(_kept(spark, at, folder, f"equal-{turn}"))
        turn += 1
        open_ = _kept(spark, inside.where("bin % 2 = 0").select("key", next_.alias("path"), "rank", (F.col("left") - (F.col("_to") - F.col("_n"))).alias("left")), folder, f"open-{turn}")
        if open_.isEmpty():
            break
        now = now.select("key", "x", next_.alias("path"))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    told = values.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    j = sizes.join(told, "key")

    def on_line(s: float) -> Column:
        r = rank(s)
        a, b = F.col("at")[F.floor(r)], F.col("at")[F.ceil(r)]
        # as Spark's percentile weighs the two
        return F.when(F.floor(r) == F.ceil(r), a).when(a == b, a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b)

    return j.select(*[F.col(f"key.{c}").alias(c) for c in by], "n", F.array(*[on_line(s) for s in shares]).alias("values"))
