"""Sequential rules that windows can't express, as one ordered fold per key."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import with_run


def later(last: int, candidate: int | None, nominal: int | None) -> int:
    """The time after `last`: the candidate if it is later, else the nominal time or last plus one, whichever is later.
    A null candidate is never later, a null nominal time doesn't count."""
    return candidate if candidate is not None and candidate > last else max(last + 1, last + 1 if nominal is None else nominal)


def monotonic_times(rows: DataFrame, by: list[str], seq: str, candidate: str, nominal: str, name: str = "repaired") -> DataFrame:
    """rows with strictly increasing integer times: a candidate not after the time before becomes the nominal time or
    the time before plus one, whichever is later; a null candidate is never after, a null nominal time never later.
    One pass over each key's ordered rows, which come out as they went in: nothing is joined back, so repeated and null
    keys and places keep their rows. A null key is a key like any other; a null place comes first."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(seq, "ascending")], null_placement="at_start"))
        out, last = [], -1
        for c, n in zip(table.column(candidate).to_pylist(), table.column(nominal).to_pylist(), strict=True):
            last = later(last, c, n)
            out.append(last)
        return table.append_column(name, pa.array(out, pa.int64()))

    return rows.groupBy(*by).applyInArrow(run, schema)


def tracker_resets(rows: DataFrame, by: list[str], on: list[str], low: Column, streak: int = 2) -> DataFrame:
    """rows with reset: true on every streak-th low row in a row, where a tracker gives up its state and starts anew.
    Counting restarts at each reset, so the streak's place modulo its length decides."""
    r = with_run(rows.withColumn("_low", F.coalesce(low, F.lit(False))), by, on, "_low", name="_run")
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*on))
    return r.withColumn("reset", F.col("_low") & (place % streak == 0)).drop("_low", "_run")


# Soft shape limits, jumps and their penalties' caps, and the scores of confidence.
MIN_CIRCULARITY, MIN_AXIS_RATIO, MIN_SOLIDITY = 0.08, 0.15, 0.45
MAX_JUMP, MAX_AREA_JUMP, DISTANCE_CAP, AREA_CAP = 12, 2.50, 1.8, 1.5
HIGH_SCORE, MEDIUM_SCORE = 0.85, 0.35


def best_candidate(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The best-scored shape per key: candidate, area, circularity, axis_ratio, solidity, distance (from the last
    accepted centre, null if there is none), area_jump (relative change, null without a last area). Shapes below a
    soft limit don't count; of equal scores the first candidate stands. high, medium or low by the score."""
    strength = F.col("circularity") + F.col("axis_ratio") + F.col("solidity")
    away, jump = F.coalesce("distance", F.lit(0.0)), F.coalesce("area_jump", F.lit(0.0))
    score = strength - 0.25 * F.least(away / (2 * MAX_JUMP), F.lit(DISTANCE_CAP)) - 0.10 * F.least(jump / MAX_AREA_JUMP, F.lit(AREA_CAP))
    score = score + F.when(F.col("distance").isNull(), 0.15).otherwise(0.0) + F.when((away > 2 * MAX_JUMP) & (strength > 1.20), 0.15).otherwise(0.0)
    fit = candidates.where((F.col("circularity") >= MIN_CIRCULARITY) & (F.col("axis_ratio") >= MIN_AXIS_RATIO) & (F.col("solidity") >= MIN_SOLIDITY))
    top = fit.withColumn("score", score).groupBy(*by).agg(F.max_by(F.struct("candidate", "area", "score"), F.struct("score", F.negative("candidate"))).alias("b"))
    label = F.when(F.col("b.score") >= HIGH_SCORE, "high").when(F.col("b.score") >= MEDIUM_SCORE, "medium").otherwise("low")
    return top.select(*by, "b.candidate", "b.area", F.col("b.score").alias("score"), label.alias("confidence"))
