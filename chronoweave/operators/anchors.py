"""Clock maps from annotated anchors: the same event marked on two recorders.

Purely relational: the last annotation of each (source, event) is pivoted to one row per recording, and chained
conditions give coefficients, status and grade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ["project", "pid", "visit", "segment"]
SOURCES, EVENTS = ("driver", "scene"), ("off", "on")


def anchored_maps(annotations: DataFrame, warn_ppm: float = 2000.0, reject_ppm: float = 10_000.0, most_uncertain: float = 0.5, bound_ppm: float = 5000.0) -> DataFrame:
    """One row per key of annotations (keys, seq, source, event, status, confidence, time, uncertainty; time null if
    the marks were invalid): anchors, intercept, scale, drift_ppm, status, usable, grade, review."""
    keys = annotations.select(*KEYS).distinct()
    accepted = annotations.where("status = 'accepted'")
    cell = F.struct(F.col("time").alias("t"), F.col("uncertainty").alias("u"), F.col("confidence").alias("c"))
    cols = [F.max_by(F.when((F.col("source") == s) & (F.col("event") == e), cell), F.when((F.col("source") == s) & (F.col("event") == e), F.col("seq"))).alias(f"{s}_{e}") for s in SOURCES for e in EVENTS]
    a = keys.join(accepted.groupBy(*KEYS).agg(*cols), KEYS, "left")

    broken = F.lit(False)
    for s in SOURCES:
        for e in EVENTS:
            broken = broken | F.coalesce(F.col(f"{s}_{e}").isNotNull() & (F.col(f"{s}_{e}.t").isNull() | F.col(f"{s}_{e}.u").isNull()), F.lit(False))
    paired = {e: F.coalesce(F.col(f"driver_{e}.t").isNotNull() & F.col(f"scene_{e}.t").isNotNull() & F.col(f"driver_{e}.u").isNotNull() & F.col(f"scene_{e}.u").isNotNull(), F.lit(False)) for e in EVENTS}
    a = a.withColumn("broken", broken).withColumn("anchors", sum((paired[e].cast("int") for e in EVENTS), F.lit(0)))
    one = F.when(paired["off"], F.struct("driver_off", "scene_off")).otherwise(F.struct(F.col("driver_on").alias("driver_off"), F.col("scene_on").alias("scene_off")))
    a = a.withColumn("one", one)
    span_d, span_s = F.col("driver_on.t") - F.col("driver_off.t"), F.col("scene_on.t") - F.col("scene_off.t")
    a = a.withColumn("straight", (F.col("anchors") == 2) & (span_d > 0) & (span_s > 0))
    a = a.withColumn("scale", F.when(F.col("anchors") == 1, F.lit(1.0)).when(F.col("straight"), span_s / span_d))
    a = a.withColumn("intercept", F.when(F.col("anchors") == 1, F.col("one.scene_off.t") - F.col("one.driver_off.t")).when(F.col("straight"), F.col("scene_off.t") - F.col("scale") * F.col("driver_off.t")))
    a = a.withColumn("drift_ppm", F.when(F.col("straight"), S.drift_ppm(F.col("scale"))))
    pair = lambda e: F.col(f"scene_{e}.u") + F.abs("scale") * F.col(f"driver_{e}.u")
    single = F.col("one.scene_off.u") + (1 + bound_ppm / 1e6) * F.col("one.driver_off.u")
    a = a.withColumn("uncertainty", F.when(F.col("straight"), F.greatest(pair("off"), pair("on"))).when(F.col("anchors") == 1, single))
    touching = lambda s: F.col(f"{s}_off.t") + F.col(f"{s}_off.u") >= F.col(f"{s}_on.t") - F.col(f"{s}_on.u")
    crossed = (F.col("anchors") == 2) & ~F.col("straight")
    invalid = F.col("broken") | crossed | (F.col("straight") & (touching("driver") | touching("scene") | (F.abs("drift_ppm") > reject_ppm)))
    marks = F.array(*[F.col(f"{s}_{e}.c") for s in SOURCES for e in EVENTS])
    a = a.withColumn("invalid", F.coalesce(invalid, F.lit(False))).withColumn("low", F.coalesce(F.array_contains(marks, "low"), F.lit(False))).withColumn("high", F.coalesce(F.forall(marks, lambda c: c == "high"), F.lit(False)))
    doubts = (F.abs("drift_ppm") > warn_ppm) | (F.col("uncertainty") > most_uncertain) | F.col("low")
    status = (
        F.when(F.col("straight") & F.col("invalid"), "invalid_affine").when(F.col("straight") & doubts, "review_affine").when(F.col("straight"), "affine")
        .when((F.col("anchors") == 1) & F.col("invalid"), "invalid_offset_only").when(F.col("anchors") == 1, "offset_only").when(F.col("invalid"), "invalid").otherwise("unavailable")
    )
    best = F.col("high") & (F.abs("drift_ppm") <= 500) & (F.col("uncertainty") <= min(0.25, most_uncertain))
    a = a.withColumn("status", status)
    grade = F.when(F.col("status") == "affine", F.when(best, "A").otherwise("B")).when(F.col("status").isin("review_affine", "offset_only"), "C").otherwise("D")
    return a.select(*KEYS, F.col("anchors").cast("long").alias("anchors"), "intercept", "scale", "drift_ppm", "status", F.col("status").isin("affine", "review_affine", "offset_only").alias("usable"), grade.alias("grade"), (~F.col("status").isin("affine", "unavailable")).alias("review"))
