"""Contracts and audits of sample tables, and coverage counts.

Checks return rows that say what is wrong (and how often), so that a broken recording is a row and not a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timestamp_audit(rows: DataFrame, by: list[str], seq: str, t: str) -> DataFrame:
    """Rows, missing times and steps that don't increase, per key in order of seq, across any chunks."""
    w = Window.partitionBy(*by).orderBy(seq)
    known = F.last(t, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = rows.withColumn("_d", F.col(t) - known)
    return s.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(t).isNull()).alias("missing"), F.count_if(F.col("_d") < 0).alias("backward"), F.count_if(F.col("_d") == 0).alias("repeated"), F.max("_d").alias("longest_step"))


def schema_difference(actual: list[str], wanted: list[str]) -> dict:
    """Of an exact, ordered column contract: counts, the first place that differs, missing, extra and repeated names."""
    first = next((k for k, (a, b) in enumerate(zip(actual, wanted, strict=False)) if a != b), None)
    if first is None and len(actual) != len(wanted):
        first = min(len(actual), len(wanted))
    return {"expected": len(wanted), "actual": len(actual), "first": first, "missing": [c for c in wanted if c not in actual], "extra": [c for c in actual if c not in wanted], "repeated": sorted({c for c in actual if actual.count(c) > 1})}


def exact_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    found = schema_difference(df.columns, wanted)
    if found["first"] is not None or found["repeated"]:
        raise ValueError(f"columns differ from the contract: {found}")
    return df


def row_continuity(rows: DataFrame, by: list[str], order: str, index: str) -> DataFrame:
    """Rows whose index is not their place, per key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("_p", place).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_p") != F.col(index)).alias("misplaced"))


def parallel_streams(a: DataFrame, b: DataFrame, by: list[str], seq: str, t: str) -> DataFrame:
    """Per key: rows of either stream, and rows without a partner of the same place and time."""
    other = b.select(*by, seq, F.col(t).alias("_t"), F.lit(1).alias("_there"))
    j = a.withColumn("_here", F.lit(1)).join(other, [*by, seq], "full")
    return j.groupBy(*by).agg(F.count("_here").alias("n_a"), F.count("_there").alias("n_b"), F.count_if(F.col("_here").isNull() | F.col("_there").isNull() | ~F.col(t).eqNullSafe(F.col("_t"))).alias("unequal"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def map_consistent(intercept: Column, scale: Column, x: Column, y: Column) -> Column:
    """Whether a stored bound is what its map says, within 1e-6 and 1e-10 of its size."""
    return F.abs(intercept + scale * x - y) <= 1e-6 + 1e-10 * F.abs(y)


def coverage(rows: DataFrame, by: list[str], t: str, start: Column, end: Column) -> DataFrame:
    """Counts of all, finite, supported, extrapolated and missing times, and what the invariants say of them."""
    known, inside = F.col(t).isNotNull(), (F.col(t) >= start) & (F.col(t) <= end)
    c = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(known).alias("finite"), F.count_if(known & F.coalesce(inside, F.lit(False))).alias("supported"), F.count_if(~known).alias("missing"))
    return c.withColumn("extrapolated", F.col("finite") - F.col("supported")).withColumn("valid", (F.col("finite") + F.col("missing") == F.col("total")) & (F.col("supported") + F.col("extrapolated") == F.col("finite")))


def module_status(rows: DataFrame, by: list[str], module: str, wanted: list) -> DataFrame:
    """found, missing (sorted) and complete, partial or unavailable per key."""
    ids = F.array(*[F.lit(m) for m in wanted])
    g = rows.groupBy(*by).agg(F.array_sort(F.array_intersect(F.collect_set(module), ids)).alias("found"))
    g = g.withColumn("missing", F.array_sort(F.array_except(ids, "found")))
    return g.withColumn("status", F.when(F.size("missing") == 0, "complete").when(F.size("found") > 0, "partial").otherwise("unavailable"))


def pairing(a: DataFrame, b: DataFrame, by: list[str], path: str) -> DataFrame:
    """Full outer pairing of two listings: paths of either side where single, and what stands in the way."""
    side = lambda d, n: d.groupBy(*by).agg(F.count_distinct(path).alias(f"n_{n}"), F.min(path).alias(f"path_{n}"))
    j = side(a, "a").join(side(b, "b"), by, "full").na.fill(0, ["n_a", "n_b"])
    status = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), "ready").when(F.col("n_a") == 0, "missing_a").when(F.col("n_b") == 0, "missing_b").when(F.col("n_a") > 1, "ambiguous_a").otherwise("ambiguous_b")
    return j.withColumn("status", status)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def outputs(files: DataFrame, extensions: list[str], suffix: str, path: str = "path") -> DataFrame:
    """files of the extensions (whatever the case) with output, their name without the extension and with the suffix, and
    status: collision where several files would get one output (a name with two extensions, or in two folders)."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))
    wanted = files.where(ext.isin(*[e.lower().removeprefix(".") for e in extensions]))
    out = wanted.withColumn("output", F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(suffix)))
    n = F.count("*").over(Window.partitionBy("output"))
    return out.withColumn("status", F.when(n > 1, "collision").otherwise("ready"))


def eye_rows(rows: DataFrame, sensor: str = "Sensor", eye: str = "Eye Tracker") -> DataFrame:
    """Rows of the eye sensor alone; rows without a sensor aren't."""
    return rows.where(F.col(sensor) == eye)
