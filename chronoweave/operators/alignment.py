"""Windowed estimation of clock offset and drift between two recorders.

Per recording and signal group, grouped Arrow tasks run the correlation kernels; between them all is relational:
coarse offsets are clustered into priors, window estimates are gated and clustered per window, lines are fitted, fits
are ranked and graded. A group of tasks' rows is one recording's samples of one signal group.

Both sides are long tables: rec, grp, channel, t, value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be cogrouped with a frame that it was made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _channels(a: pd.DataFrame, b: pd.DataFrame) -> tuple[list, list]:
    """(t, v) per channel that both sides have."""
    if a.empty or b.empty:  # a group that one side lacks has no columns there
        return [], []
    sides = [{c: K.distinct_times(g["t"].to_numpy(float), g["value"].to_numpy(float)) for c, g in side.dropna(subset=["t", "value"]).groupby("channel")} for side in (a, b)]
    names = sorted(c for c in sides[0] if c in sides[1] and len(sides[0][c][0]) >= 10 and len(sides[1][c][0]) >= 10)
    return [sides[0][c] for c in names], [sides[1][c] for c in names]


def checked(**parameters: float) -> None:
    """Q8: lengths, steps and rates are finite and above 0."""
    for name, x in parameters.items():
        if not (np.isfinite(x) and x > 0):
            raise ValueError(f"{name} must be a finite number above 0, not {x}")


def coarse_offsets(source: DataFrame, target: DataFrame, hz: float = 50.0) -> DataFrame:
    """rec, grp, offset (null if there is too little): the lag of the highest correlation of whole recordings."""

    def run(key, a, b):
        x, y = _channels(a, b)
        offset = K.coarse_offset(x, y, hz) if x else np.nan
        return pd.DataFrame([(*key, None if np.isnan(offset) else offset)], columns=["rec", "grp", "offset"])

    return source.groupBy("rec", "grp").cogroup(_apart(target).groupBy("rec", "grp")).applyInPandas(run, "rec long, grp string, offset double")


def micros(x: Column) -> Column:
    """Seconds to whole microseconds, halves away from zero."""
    return F.round(x * 1e6) / 1e6


def priors(coarse: DataFrame, width: float = 0.5, top: int = 5) -> DataFrame:
    """rec, prior, rank: medians of clusters of coarse offsets less than `width` from a seed; most groups first, then
    least spread, then the smallest offset. Spreads and offsets that are alike to a microsecond rank as equal, so that
    the last bits of a sum decide nothing; the members' names decide then."""
    known = coarse.where("offset IS NOT NULL")
    seed = known.select("rec", F.col("grp").alias("seed"), F.col("offset").alias("at"))
    near = seed.join(known, "rec").where(F.abs(F.col("offset") - F.col("at")) < width)
    clusters = near.groupBy("rec", "seed").agg(F.array_join(F.array_sort(F.collect_list("grp")), ",").alias("members"), F.percentile("offset", 0.5).alias("prior"), F.stddev_pop("offset").alias("sd"), F.count("*").alias("n"))
    once = clusters.groupBy("rec", "members").agg(F.first("prior").alias("prior"), F.first("sd").alias("sd"), F.first("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("n"), micros(F.col("sd")), micros(F.col("prior")), "members"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("rec", "prior", "rank")


def merged_priors(priors_: DataFrame, tolerance: float = 0.25, limit: int = 8) -> DataFrame:
    """rec, prior, rank: of priors in order of rank those that no earlier kept one is within `tolerance` of, and of them
    the first `limit`. Nulls and numbers that aren't finite don't count. A recording has a few dozen priors at most."""
    known = priors_.where(F.col("prior").isNotNull() & ~F.isnan("prior") & (F.abs("prior") < float("inf")))
    ordered = known.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "prior"))), lambda x: x["prior"]).alias("all"))
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k - x) <= tolerance)
    kept = F.aggregate("all", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) >= limit) | near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return ordered.select("rec", F.posexplode(kept).alias("rank", "prior")).select("rec", "prior", (F.col("rank") + 1).cast("long").alias("rank"))


def window_offsets(source: DataFrame, target: DataFrame, guesses: DataFrame, length: float = 60.0, step: float = 30.0, radius: float = 2.0, gap: float = 0.2, hz: float = 50.0, overlap_s: float = 10.0) -> DataFrame:
    """rec, prior, windows, centre, grp, offset, peak, margin, boundary of every window, group and prior; a row without
    offset where a window says nothing. Windows begin where both recordings of all groups, on the source's clock, do."""
    checked(length=length, step=step, radius=radius, hz=hz, gap=gap, overlap_s=overlap_s)
    span = lambda d, a, b: d.groupBy("rec").agg(F.min("t").alias(a), F.max("t").alias(b))
    spans = span(source, "s0", "s1").join(span(target, "t0", "t1"), "rec").join(guesses, "rec")
    told = spans.select("rec", "prior", F.greatest("s0", F.col("t0") - F.col("prior")).alias("start"), F.least("s1", F.col("t1") - F.col("prior")).alias("end"))
    # a group's questions are a few rows among its samples: those with a prior and no channel
    asks = source.select("rec", "grp").distinct().join(told, "rec")
    left = source.select("rec", "grp", "channel", "t", "value").unionByName(asks, allowMissingColumns=True)

    def run(key, a, b):
        asked = a[a["prior"].notna()].sort_values("prior")
        x, y = _channels(a[a["prior"].isna()], b)
        rows = []
        for prior, start, end in zip(asked["prior"], asked["start"], asked["end"], strict=True):
            centres, wide = K.window_centres(start, end, length, step)
            for centre in centres:
                got = K.local_offset(x, y, centre, prior, wide, radius, gap, hz, overlap_s) if x else None
                rows.append((*key, prior, len(centres), centre, *((got[k] for k in ("offset", "peak", "margin", "boundary")) if got else (None,) * 4)))
        return pd.DataFrame(rows, columns=["rec", "grp", "prior", "windows", "centre", "offset", "peak", "margin", "boundary"])

    return left.groupBy("rec", "grp").cogroup(_apart(target).groupBy("rec", "grp")).applyInPandas(run, "rec long, grp string, prior double, windows long, centre double, offset double, peak double, margin double, boundary boolean")


def combined_windows(windows: DataFrame, least_peak: float = 0.30, least_margin: float = 0.02, width: float = 0.150, least_groups: int = 1) -> DataFrame:
    """rec, prior, centre, offset, peak, groups: the largest cluster of a window's trusted group estimates (then the
    highest median peak, then the least spread, then the first seed)."""
    good = windows.where((F.col("peak") >= least_peak) & (F.col("margin") >= least_margin) & ~F.col("boundary"))
    seed = good.select("rec", "prior", "centre", F.col("grp").alias("seed"), F.col("offset").alias("at"))
    near = seed.join(good, ["rec", "prior", "centre"]).where(F.abs(F.col("offset") - F.col("at")) <= width)
    c = near.groupBy("rec", "prior", "centre", "seed").agg(F.count("*").alias("n"), F.percentile("peak", 0.5).alias("peak"), F.stddev_pop("offset").alias("sd"), F.percentile("offset", 0.5).alias("offset"), F.array_sort(F.collect_list("grp")).alias("groups"))
    best = F.row_number().over(Window.partitionBy("rec", "prior", "centre").orderBy(F.desc("n"), F.desc("peak"), "sd", "seed"))
    return c.withColumn("_k", best).where((F.col("_k") == 1) & (F.col("n") >= least_groups)).select("rec", "prior", "centre", "offset", "peak", "groups")


FIT = "rec long, prior double, good_windows long, intercept double, scale double, raw_drift_ppm double, inliers long, residual_mad double, residual_p95 double, covered double, groups long, peak double, jump double"


def fits(combined: DataFrame, most_ppm: float | None = 2000.0, least_span: float = 60.0) -> DataFrame:
    """A robust line per recording and prior through its windows (a few dozen rows each)."""

    def run(key, w):
        x, y = w["centre"].to_numpy(float), w["offset"].to_numpy(float)
        fit = K.robust_line(x, y, least_span=least_span, most_ppm=most_ppm)
        groups = len({g for gs in w["groups"] for g in gs})
        return pd.DataFrame([(*key, len(x), *(fit[k] for k in ("intercept", "scale", "raw_drift_ppm", "inliers", "residual_mad", "residual_p95")), float(np.ptp(x)), groups, float(w["peak"].median()), K.clock_jump(x, y, fit["intercept"], fit["scale"] - 1))], columns=[c.split()[0] for c in FIT.split(", ")])

    return combined.groupBy("rec", "prior").applyInPandas(run, FIT)


def graded(fit: DataFrame, windows: DataFrame, least_windows: int = 3, review_ppm: float = 2000.0, most_ppm: float = 10000.0, most_p95: float = 0.20, most_jump: float = 0.50) -> DataFrame:
    """The best fit of each recording (most good windows, then groups, peak, least residual) with status and reasons."""
    spread = windows.groupBy("rec", "prior").agg(F.max("windows").alias("windows"), (F.max("centre") - F.min("centre")).alias("span"))
    best = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("good_windows"), F.desc("groups"), F.desc("peak"), "residual_mad", "prior"))
    f = fit.join(spread, ["rec", "prior"]).withColumn("_k", best).where("_k = 1").drop("_k")
    f = f.withColumn("good_ratio", F.try_divide("good_windows", "windows")).withColumn("coverage_ratio", F.when(F.col("span") > 0, F.col("covered") / F.col("span")).otherwise(0.0))
    drift = F.abs("raw_drift_ppm")
    hard = F.array_compact(F.array(
        F.when((F.col("good_windows") < least_windows) | (F.col("inliers") < least_windows), "too few good windows"),
        F.when(drift > most_ppm, "drift exceeds the hard limit"),
        F.when(F.col("residual_p95") > most_p95, "residuals exceed the limit"),
        F.when(F.col("jump") > most_jump, "possible clock jump"),
    ))
    soft = F.array_compact(F.array(
        F.when(drift > review_ppm, "large drift"),
        F.when(F.col("groups") < 2, "supported by one signal group"),
        F.when(F.col("good_ratio") < 0.25, "few windows passed"),
        F.when(F.col("coverage_ratio") < 0.50, "good windows cover little of the overlap"),
    ))
    status = F.when(F.size(hard) > 0, "invalid").when(F.size(soft) > 0, "review").otherwise("good")
    return f.withColumn("status", status).withColumn("reasons", F.array_join(F.when(F.size(hard) > 0, hard).otherwise(soft), "; "))


def align(source: DataFrame, target: DataFrame, hz: float = 50.0, length: float = 60.0, step: float = 30.0, radius: float = 2.0, gap: float = 0.2, guesses: DataFrame | None = None, most_ppm: float | None = 2000.0) -> DataFrame:
    """Clock maps of all recordings: target time = source time + intercept + (scale - 1) * source time."""
    guesses = priors(coarse_offsets(source, target, hz)) if guesses is None else guesses
    # read twice, by the fits and by their grading: a row per window, group and prior, made by the dearest kernel
    windows = window_offsets(source, target, guesses, length, step, radius, gap, hz).persist(StorageLevel.MEMORY_AND_DISK)
    return graded(fits(combined_windows(windows), most_ppm, length), windows)


def repair_summary(chunks: DataFrame, size: int = 20) -> DataFrame:
    """Match ratio, ambiguous, duplicate and missing chunks per recording, and the grade."""
    # one pass over the chunks, as each use of them would look for them again
    there = F.col("start").isNotNull()
    seen = chunks.groupBy("rec", "start").agg(F.count("*").alias("_n"), F.count_if(F.col("candidates") > 1).alias("_many"))
    seen = seen.withColumn("_d", F.col("start") - F.lag("start").over(Window.partitionBy("rec").orderBy("start")))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    s = seen.groupBy("rec").agg(
        total(F.col("_n")).alias("chunks"), total(F.when(there, F.col("_n"))).alias("matched"), total(F.when(there, F.col("_many"))).alias("ambiguous"),
        total(F.when(there, F.col("_n") - 1)).alias("duplicates"), total(F.when(there, F.greatest(F.rint(F.col("_d") / size) - 1, F.lit(0.0)))).alias("missing"),
    )
    s = s.withColumn("ratio", F.col("matched") / F.col("chunks"))
    clean = (F.col("ratio") == 1) & (F.col("ambiguous") == 0) & (F.col("duplicates") == 0) & (F.col("missing") == 0)
    grade = F.when(clean, "A").when(F.col("ratio") >= 0.99, "B").when(F.col("ratio") >= 0.95, "C").otherwise("D")
    return s.select("rec", "chunks", "matched", "ambiguous", "duplicates", "missing", "ratio", grade.alias("grade"))


def decided(fits_: dict[str, DataFrame], audits: DataFrame, most_offset: float = 0.5, most_drift: float = 2000.0, prefer_good: bool = False, legacy: DataFrame | None = None) -> DataFrame:
    """One map per recording from graded fits of all groups ("all") and of two families (any two other names).

    If both families have usable fits that disagree on the offset at the recording's middle or on drift, there is no
    map (conflict_review), except, with prefer_good, where exactly one of them is good: it stands then. Else the fit of all
    groups stands, then the first family's, the second's, and a reliable legacy offset. Timestamps that don't increase
    void any map. audits: rec, middle, broken. legacy: rec, intercept, scale.
    """
    first, second = [n for n in fits_ if n != "all"]
    j = audits.select("rec", "middle", "broken")
    for name, fit in fits_.items():
        j = j.join(fit.select("rec", F.struct("status", "intercept", "scale", "raw_drift_ppm", "good_windows", "residual_p95", "reasons").alias(name)), "rec", "left")
    j = j.join((legacy if legacy is not None else audits.select("rec", F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("double").alias("scale")).where("false")).select("rec", F.struct("intercept", "scale").alias("legacy")), "rec", "left")
    usable = lambda n: F.coalesce(F.col(f"{n}.status").isin("good", "review"), F.lit(False))
    good = lambda n: F.coalesce(F.col(f"{n}.status") == "good", F.lit(False))
    at = lambda n: F.col(f"{n}.intercept") + (F.col(f"{n}.scale") - 1) * F.col("middle")
    apart = usable(first) & usable(second) & ((F.abs(at(first) - at(second)) > most_offset) | (F.abs(F.col(f"{first}.scale") - F.col(f"{second}.scale")) * 1e6 > most_drift))
    one_good = good(first) != good(second)
    conflict = F.coalesce(apart & ~one_good if prefer_good else apart, F.lit(False))
    j = j.withColumn("conflict", conflict)
    order = [("all", usable("all")), (first, usable(first)), (second, usable(second))]
    if prefer_good:
        order = [(first, apart & good(first) & one_good), (second, apart & good(second) & one_good), *order]
    source = F.when(F.col("conflict"), "none")
    for name, test in order:
        source = source.when(F.coalesce(test, F.lit(False)), name)
    j = j.withColumn("source", source.when(F.col("legacy").isNotNull(), "legacy").otherwise("none"))
    pick = lambda f: F.coalesce(*[F.when(F.col("source") == n, F.col(f"{n}.{f}")) for n in fits_])
    own = pick("status")
    status = F.when(F.col("broken"), "invalid_timestamps").when(F.col("conflict"), "conflict_review").when(F.col("source") == "legacy", "legacy_fallback").when(own == "good", "content_affine").when(own == "review", "content_review").otherwise("unavailable")
    j = j.withColumn("status", status).withColumn("usable", F.col("status").isin("content_affine", "content_review", "legacy_fallback"))
    best = (F.col("source") == "all") & good(first) & good(second)
    grade = F.when(F.col("status") == "content_affine", F.when(best, "A").otherwise("B")).when(F.col("usable"), "C").otherwise("D")
    value = lambda f: F.when(F.col("usable"), F.coalesce(F.when(F.col("source") == "legacy", F.col(f"legacy.{f}")), pick(f)))
    warnings = F.concat_ws(" | ", F.array_distinct(F.filter(F.array(*[F.col(f"{n}.reasons") for n in fits_]), lambda x: x.isNotNull() & (x != ""))))
    return j.select("rec", "status", "usable", grade.alias("grade"), "source", value("intercept").alias("intercept"), value("scale").alias("scale"), (F.col("status") != "content_affine").alias("review"), warnings.alias("warnings"))


def build_maps(source: DataFrame, target: DataFrame, families: dict[str, list[str]], hz: float = 50.0, prefer_good: bool = False, **options) -> DataFrame:
    """Clock maps with a cross-check between two families of signal groups; the priors of all groups serve each."""
    spans = source.groupBy("rec").agg(((F.min("t") + F.max("t")) / 2).alias("middle"))
    steps = source.withColumn("_d", F.col("t") - F.lag("t").over(Window.partitionBy("rec", "channel").orderBy("seq"))) if "seq" in source.columns else source.withColumn("_d", F.lit(1.0))
    audits = spans.join(steps.groupBy("rec").agg(F.coalesce(F.bool_or(F.col("_d") <= 0), F.lit(False)).alias("broken")), "rec")
    source, target = source.select("rec", "grp", "channel", "t", "value"), target.select("rec", "grp", "channel", "t", "value")
    guesses = priors(coarse_offsets(source, target, hz)).persist(StorageLevel.MEMORY_AND_DISK)
    windows = window_offsets(source, target, guesses, hz=hz, **options).persist(StorageLevel.MEMORY_AND_DISK)
    made = {}
    for name, groups in {"all": None, **families}.items():
        part = windows if groups is None else windows.where(F.col("grp").isin(groups))
        made[name] = graded(fits(combined_windows(part)), part)
    return decided(made, audits, prefer_good=prefer_good)
