"""Robust statistics and line fits by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """rows with the facts of their group; null keys are a group like any other."""
    if not by:
        return rows.crossJoin(F.broadcast(facts))  # one row
    named = facts.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in facts.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return rows.join(named, same).drop(*[f"_by_{c}" for c in by])


def robust_scale(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, median, mad, scale: 1.4826 times the median absolute deviation, or the population deviation where that is 0."""
    centre = rows.groupBy(*by).agg(F.percentile(x, 0.5).alias("median"), F.stddev_pop(x).alias("_sd"))
    away = _joined(rows, centre, by).groupBy(*by).agg(F.first("median").alias("median"), F.first("_sd").alias("_sd"), F.percentile(F.abs(F.col(x) - F.col("median")), 0.5).alias("mad"))
    return away.select(*by, "median", "mad", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("_sd")).alias("scale"))


def _clipped(x: str, median: Column, scale: Column, clip: float) -> Column:
    z = F.when(scale > 0, (F.col(x) - median) / scale).otherwise(F.lit(0.0))
    return F.when(F.col(x).isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))


def standardised(rows: DataFrame, by: list[str], x: str, clip: float, name: str = "z") -> DataFrame:
    """rows with (x - median) / scale, clipped; 0 where there is no scale."""
    s = robust_scale(rows, by, x)
    return _joined(rows, s, by).select(*rows.columns, _clipped(x, F.col("median"), F.col("scale"), clip).alias(name))


def line(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"), F.corr(x, y).alias("r"))


def trimmed_line(rows: DataFrame, by: list[str], x: str, y: str, floor: float, k: float = 3.0, rounds: int = 1) -> DataFrame:
    """by, slope, intercept, n, p95 (of absolute residuals): a line from which, each round, points further off than
    max(floor, k * 1.4826 * MAD of residuals) are dropped before it is fitted again. The rounds are unrolled joins of
    one row per group; kernels.robust_line is the same until nothing changes, inside one task per group."""
    kept = rows.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for _ in range(rounds):
        res = _joined(kept, line(kept, by, x, y).drop("n", "r"), by).withColumn("_e", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).drop("slope", "intercept")
        kept = _joined(res, robust_scale(res, by, "_e"), by).where(F.abs(F.col("_e") - F.col("median")) <= F.greatest(F.lit(floor), k * 1.4826 * F.col("mad"))).select(*by, x, y)
    fit = line(kept, by, x, y).drop("r")
    res = _joined(kept, fit, by).withColumn("_e", F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)))
    return res.groupBy(*by).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.count("*").alias("n"), F.percentile("_e", 0.95).alias("p95"))


def box(rows: DataFrame, by: list[str], x: str, large: bool = False) -> DataFrame:
    """Five numbers of a box plot: quartiles, and whiskers at the furthest values within 1.5 interquartile ranges. large:
    groups whose distinct values don't fit into a task, by passes over the rows."""
    if large:
        from .quantiles import exact_quantiles

        q = exact_quantiles(rows, by, x, [0.25, 0.5, 0.75]).select(*by, *[F.get("values", F.lit(k)).alias(f"q{k + 1}") for k in range(3)])
    else:
        q = rows.groupBy(*by).agg(*[F.percentile(x, p).alias(f"q{k}") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = _joined(rows, q, by).where((F.col(x) >= F.col("q1") - reach) & (F.col(x) <= F.col("q3") + reach))
    return inside.groupBy(*by).agg(F.min(x).alias("low"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("q3").alias("q3"), F.max(x).alias("high"))


def histogram(rows: DataFrame, by: list[str], x: str, low: float, high: float, width: float) -> DataFrame:
    """Counts in bins of equal width; the last bin is closed, values outside are dropped."""
    bins = int(round((high - low) / width))
    n = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(x).between(low, high)).groupBy(*by, n.alias("bin")).agg(F.count("*").alias("n"))


def activity_envelope(rows: DataFrame, by: list[str], on: list[str], x: str, trend: int, width: int, stride: int, clip: float = 10.0) -> DataFrame:
    """by, on, envelope of every stride-th row: the root mean square over `width` rows of x less its mean over `trend`
    rows, clipped at `clip` robust scales."""
    from .runs import moving_mean

    # medians over the same partitions as the means: joined facts of each group would need the rows three times
    whole = Window.partitionBy(*by)
    flat = rows.withColumn("_e", F.col(x) - moving_mean(x, by, on, trend))
    flat = flat.withColumn("_median", F.percentile("_e", 0.5).over(whole)).withColumn("_sd", F.stddev_pop("_e").over(whole))
    flat = flat.withColumn("_away", F.abs(F.col("_e") - F.col("_median"))).withColumn("_mad", F.percentile("_away", 0.5).over(whole))
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd"))
    cut = flat.withColumn("_z", _clipped("_e", F.col("_median"), scale, clip)).withColumn("_p", F.col("_z") * F.col("_z"))
    out = cut.withColumn("envelope", F.sqrt(moving_mean("_p", by, on, width))).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*on)) - 1)
    return out.where(F.col("_k") % stride == 0).select(*by, *on, "envelope")
