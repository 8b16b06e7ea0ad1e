"""Clock maps between two recorders whose signals share only their activity.

Both signals are put on one grid of the target's clock (the source by a rough prior), and their activity envelopes are
compared: a wide lag search over the whole recording, then narrow ones in windows around what it found, and a robust
line through the windows. One grouped Arrow task holds one recording's two envelopes for one feature of the target; grid,
envelopes, the choice among features and the grading are relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import asof, robust
from . import kernels as K
from .alignment import checked

#: Fixed values of the grading: inliers, median correlation, residual and lag step (seconds) that a map without review
#: needs, and how far features may differ at the recording's middle (seconds) and in drift (ppm).
INLIERS, CORRELATION, P95, JUMP, APART, DRIFT_APART = 5, 0.60, 0.20, 0.50, 0.5, 1000.0


def common_envelopes(source: DataFrame, target: DataFrame, priors: DataFrame, base_hz: float = 50.0, hz: float = 10.0, margin: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Envelopes on a grid over both recordings' overlap, `margin` seconds inside its ends: rec, k, t, own, envelope of
    the source and rec, feature, k, envelope of the target.

    source: rec, t (its own clock), value. target: rec, feature, t, value. priors: rec, prior (target's clock less
    the source's). Null values and times are left out; base_hz must be a whole multiple of hz."""
    checked(base_hz=base_hz, hz=hz)
    stride = round(base_hz / hz)
    if stride < 1 or abs(base_hz / stride - hz) > 1e-9 * hz:
        raise ValueError(f"base_hz must be a whole multiple of hz: {base_hz}, {hz}")
    known = "t IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)"
    source = source.where(known).join(priors, "rec").select("rec", (F.col("t") + F.col("prior")).alias("t"), "value")
    target = target.where(known).select("rec", "feature", "t", "value")
    span = lambda d, a, b: d.groupBy("rec").agg(F.min("t").alias(a), F.max("t").alias(b))
    spans = span(source, "s0", "s1").join(span(target, "t0", "t1"), "rec")
    spans = spans.select("rec", (F.greatest("s0", "t0") + margin).alias("start"), (F.least("s1", "t1") - margin).alias("end")).where("end > start")
    n = F.ceil((F.col("end") - F.col("start")) * base_hz).cast("long")
    grid = spans.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).select("rec", "i", (F.col("start") + F.col("i") / base_hz).alias("t"))
    ours = asof.interpolated(grid, source, ["rec"], "t", "value")
    features = target.select("rec", "feature").distinct()
    theirs = asof.interpolated(grid.join(features, "rec").select("rec", "feature", "i", "t"), target, ["rec", "feature"], "t", "value")
    widths = (max(1, round(2.0 * base_hz)), max(1, round(0.5 * base_hz)), stride)
    place = (F.col("i") / stride).cast("long").alias("k")
    a = robust.activity_envelope(ours, ["rec"], ["i", "t"], "value", *widths).join(priors, "rec")
    b = robust.activity_envelope(theirs, ["rec", "feature"], ["i"], "value", *widths)
    return a.select("rec", place, "t", (F.col("t") - F.col("prior")).alias("own"), "envelope"), b.select("rec", "feature", place, "envelope")


FIT = "rec long, feature string, fit string, intercept double, scale double, drift_ppm double, good_windows long, inliers long, correlation double, residual_p95 double, jump double, support_start double, support_end double"
_NAMES = [c.split()[0] for c in FIT.split(", ")]


def feature_fits(ours: DataFrame, theirs: DataFrame, hz: float = 10.0, length: float = 300.0, step: float = 150.0, coarse: float = 30.0, local: float = 2.0, least_peak: float = 0.35, least_margin: float = 0.02) -> DataFrame:
    """The line from the source's own clock to the target's for each feature: affine, offset_only (under three windows,
    or under 600 s of them) or unavailable. A feature whose whole recordings have no lag at all gives no row."""
    checked(hz=hz, length=length, step=step, coarse=coarse, local=local)
    both = theirs.select("rec", "feature", "k", F.col("envelope").alias("y")).join(ours.select("rec", "k", "t", "own", F.col("envelope").alias("x")), ["rec", "k"])
    whole = lambda s: round(s * hz)

    def run(key, both):
        both = both.sort_values("k")
        x, y, t, own = (both[c].to_numpy(float) for c in ("x", "y", "t", "own"))
        rough = K.lag_search(x, y, 0, whole(coarse), whole(1.0))
        if rough is None:
            return pd.DataFrame([], columns=_NAMES)
        size, found = whole(length), []
        for begin in range(0, len(x) - size + 1, max(1, whole(step))):
            near = K.lag_search(x[begin : begin + size], y[begin : begin + size], round(rough[0]), whole(local), whole(1.0))
            if near and near[1] >= least_peak and near[2] >= least_margin:
                middle = begin + size // 2
                found.append((own[middle], t[middle], near[0] / hz, near[1]))
        if not found:
            return pd.DataFrame([(*key, "unavailable", None, None, None, 0, 0, None, None, None, None, None)], columns=_NAMES)
        at, there, lag, height = np.array(found).T
        line, kept = K.robust_line(at, there + lag - at, least_span=600.0, floor=0.10, rounds=6, most_ppm=None, with_kept=True)
        affine = len(at) >= 3 and np.ptp(at) >= 600.0
        jump = float(np.abs(np.diff(lag)).max()) if len(lag) > 1 else None
        row = (*key, "affine" if affine else "offset_only", line["intercept"], line["scale"], line["raw_drift_ppm"] if affine else None, len(at), line["inliers"], float(np.median(height)), line["residual_p95"], jump, float(at[kept].min() - length / 2), float(at[kept].max() + length / 2))
        return pd.DataFrame([row], columns=_NAMES)

    return both.groupBy("rec", "feature").applyInPandas(run, FIT)


def graded_maps(fits: DataFrame, spans: DataFrame, primary: str | None = None, review_ppm: float = 2000.0, most_ppm: float = 10000.0) -> DataFrame:
    """One map for each recording of spans (rec, middle: of the source's own clock; more columns stay): the feature with the best fit
    (affine first, then inliers, correlation and residual, a little more for the primary one; equal ones by name), and
    whether another feature's affine fit of five windows or more bears it out."""
    # one pass over the fits, as each use of them would fit again
    there, names = F.col("fit") != "unavailable", [c for c in _NAMES if c != "rec"]
    score = F.when(F.col("fit") == "affine", 2000.0).otherwise(1000.0) + 10 * F.col("inliers") + F.col("correlation") - F.coalesce("residual_p95", F.lit(1.0))
    score = score + F.when(F.col("feature").eqNullSafe(F.lit(primary)), 0.05).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("_there"), F.desc("score"), "feature"))
    ranked = fits.withColumn("_there", F.coalesce(there, F.lit(False))).withColumn("score", score).withColumn("_k", rank)
    sound = (F.col("fit") == "affine") & (F.col("inliers") >= INLIERS)
    one = ranked.groupBy("rec").agg(
        F.first(F.when(F.col("_there") & (F.col("_k") == 1), F.struct(*names)), ignorenulls=True).alias("_best"),
        F.collect_list(F.when(sound, F.struct("feature", "intercept", "scale", "drift_ppm"))).alias("_sound"),
    )
    m = spans.join(one, "rec", "left").select(*spans.columns, "_best.*", "_sound")
    others = F.filter("_sound", lambda o: o["feature"] != F.col("feature"))
    off = F.array_max(F.transform(others, lambda o: F.abs(o["intercept"] + o["scale"] * F.col("middle") - F.col("intercept") - F.col("scale") * F.col("middle"))))
    drifts = F.array_max(F.transform(others, lambda o: F.abs(o["drift_ppm"] - F.coalesce("drift_ppm", F.lit(0.0)))))
    m = m.withColumn("agreement", F.coalesce((off <= APART) & (drifts <= DRIFT_APART), F.lit(False)))
    drift, affine = F.abs("drift_ppm"), F.col("fit") == "affine"
    sound = affine & (F.col("inliers") >= INLIERS) & (F.col("correlation") >= CORRELATION) & (F.col("residual_p95") <= P95) & F.col("agreement") & (F.coalesce("jump", F.lit(0.0)) <= JUMP)
    status = F.when(F.col("fit").isNull(), "unavailable").when(affine & (drift > most_ppm), "invalid_affine").when(sound, "affine").when(affine, "affine_review").otherwise("offset_only")
    m = m.withColumn("status", status).withColumn("usable", F.col("status").isin("affine", "affine_review", "offset_only"))
    grade = F.when(F.col("status") == "affine", "A").when(F.col("status") == "affine_review", "B").when(F.col("status") == "offset_only", "C").otherwise("D")
    warnings = F.concat_ws("; ",
        F.when(F.col("fit") == "offset_only", "drift could not be estimated"),
        F.when(F.col("inliers") < INLIERS, "few windows on the line"),
        F.when(F.col("correlation") < CORRELATION, "low correlation"),
        F.when(F.col("residual_p95") > P95, "large residuals"),
        F.when(drift > review_ppm, "large drift"),
        F.when(F.col("fit").isNotNull() & ~F.col("agreement"), "features disagree or stand alone"),
        F.when(F.col("jump") > JUMP, "possible clock jump"),
    )
    return m.select("rec", "status", "usable", grade.alias("grade"), (F.col("status") != "affine").alias("review"), "feature", "intercept", "scale", "drift_ppm", "good_windows", "inliers", "correlation", "residual_p95", "agreement", "support_start", "support_end", warnings.alias("warnings"), *[c for c in spans.columns if c not in ("rec", "middle")])


def envelope_maps(source: DataFrame, target: DataFrame, priors: DataFrame, base_hz: float = 50.0, hz: float = 10.0, primary: str | None = None, **options) -> DataFrame:
    """Maps of all recordings of priors; those without overlap or without a trusted window are unavailable. Support is
    kept inside the source's recording."""
    ours, theirs = common_envelopes(source, target, priors, base_hz, hz)
    spans = source.groupBy("rec").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    spans = priors.select("rec").join(spans, "rec", "left").withColumn("middle", (F.col("first") + F.col("last")) / 2)
    m = graded_maps(feature_fits(ours, theirs, hz, **options), spans, primary).where("rec IS NOT NULL")
    return m.withColumn("support_start", F.greatest("support_start", "first")).withColumn("support_end", F.least("support_end", "last")).drop("first", "last")
