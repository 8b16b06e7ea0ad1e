"""Times of a device's clock on the recorder's: measured clock offsets, resets of the device's clock among them, a robust
line for each unbroken part, and sample times laid evenly inside unbroken stretches.

Tables are keyed by `by` (a file and a stream). Offsets have place (where they stand among the samples), time (by the
device's clock) and value (what is to be added to it); samples have place, seq and t."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A reset is where both a pause and a jump of the offset stand out, by robust deviations and by seconds.
PAUSE_SCALES, PAUSE_S, JUMP_SCALES, JUMP_S = 5, 5, 10, 1
#: A stretch of samples ends with a step of over a second, and of over 500 nominal steps.
BREAK_S, BREAK_STEPS = 1, 500
_EPS = 2.220446049250313e-16


def with_resets(offsets: DataFrame, by: list[str]) -> DataFrame:
    """offsets with part: how many resets of the device's clock come before. At a reset time goes back or pauses, and
    the offset jumps."""
    w = Window.partitionBy(*by).orderBy("place")
    d = offsets.withColumn("_step", F.col("time") - F.lag("time").over(w)).withColumn("_jump", F.abs(F.col("value") - F.lag("value").over(w)))
    all_of = Window.partitionBy(*by)

    def stands_out(x: str, scales: float, seconds: float):
        centre = F.percentile(x, 0.5).over(all_of)
        return centre, lambda mad: ((F.col(x) - F.col(f"{x}_m")) / (mad + _EPS) > scales) & (F.col(x) - F.col(f"{x}_m") > seconds)

    step, step_out = stands_out("_step", PAUSE_SCALES, PAUSE_S)
    jump, jump_out = stands_out("_jump", JUMP_SCALES, JUMP_S)
    d = d.withColumn("_step_m", step).withColumn("_jump_m", jump)
    d = d.withColumn("_step_d", F.percentile(F.abs(F.col("_step") - F.col("_step_m")), 0.5).over(all_of)).withColumn("_jump_d", F.percentile(F.abs(F.col("_jump") - F.col("_jump_m")), 0.5).over(all_of))
    reset = ((F.col("_step") < 0) | step_out(F.col("_step_d"))) & jump_out(F.col("_jump_d"))
    d = d.withColumn("part", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return d.select(*offsets.columns, "part")


def offset_lines(offsets: DataFrame, by: list[str], floor: float = 0.001) -> DataFrame:
    """by, part, intercept, slope, n, and the part's first and last offset (place and time), of each unbroken part: a
    line without the measurements that stand off it by more than `floor` seconds and three robust deviations. It begins
    at the median of slopes between neighbours, which single wrong measurements don't move, however far out they are. A
    part of one measurement, or of one time, is a constant."""
    parts = with_resets(offsets.where("time IS NOT NULL AND value IS NOT NULL"), by)
    key = [*by, "part"]
    w, whole = Window.partitionBy(*key).orderBy("place"), Window.partitionBy(*key)
    middle = lambda x: F.percentile(x, 0.5).over(whole)
    # times from the part's first on, so that squares of large times lose no digits
    d = parts.withColumn("_slope", F.try_divide(F.col("value") - F.lag("value").over(w), F.col("time") - F.lag("time").over(w)))
    d = d.withColumns({"_first": F.min_by(F.struct("place", "time"), "place").over(whole), "_last": F.max_by(F.struct("place", "time"), "place").over(whole), "_zero": F.min("time").over(whole), "_level": middle("value"), "_start": F.coalesce(middle("_slope"), F.lit(0.0))})
    d = d.withColumn("_x", F.col("time") - F.col("_zero"))

    def trimmed(rows: DataFrame, line) -> DataFrame:
        e = rows.withColumn("_e", F.col("value") - line)
        e = e.withColumn("_m", middle("_e")).withColumn("_d", middle(F.abs(F.col("_e") - F.col("_m"))))
        return e.where(F.abs(F.col("_e") - F.col("_m")) <= F.greatest(F.lit(floor), 3 * 1.4826 * F.col("_d")))

    near = trimmed(d, F.col("_start") * F.col("_x"))
    near = near.withColumn("_b", F.regr_slope("value", "_x").over(whole))
    kept = trimmed(near, F.coalesce("_b", F.lit(0.0)) * F.col("_x"))
    fit = kept.groupBy(*key).agg(F.regr_slope("value", "_x").alias("_b"), F.regr_intercept("value", "_x").alias("_a"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("_first", "_last", "_zero", "_level")])
    line = F.col("_b").isNotNull()
    return fit.select(
        *key, F.when(line, F.col("_a") - F.col("_b") * F.col("_zero")).otherwise(F.col("_level")).alias("intercept"), F.coalesce("_b", F.lit(0.0)).alias("slope"),
        "n", F.col("_first").alias("first"), F.col("_last").alias("last"),
    )


def synchronised(samples: DataFrame, offsets: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """samples with t on the recorder's clock, and part: the unbroken part of the device's clock it belongs to. Between
    the last measurement before a reset and the first after it, a sample belongs to the nearer by time. A stream without
    offsets keeps its times, as part 0; samples without a time stay so."""
    lines = offset_lines(offsets, by)
    w = Window.partitionBy(*by).orderBy("part")
    lines = lines.withColumn("_prev", F.lag("last").over(w)).withColumn("_next", F.lead("first").over(w))
    named = lines.select(*[F.col(c).alias(f"_o_{c}") for c in by], "part", "intercept", "slope", "first", "last", "_prev", "_next")
    x = F.col(t)

    def before(last: str, first: str):
        """Whether a sample stands before the reset between two measurements."""
        near = F.coalesce(F.abs(x - F.col(f"{last}.time")) <= F.abs(x - F.col(f"{first}.time")), F.lit(True))
        return (F.col("place") <= F.col(f"{last}.place")) | ((F.col("place") < F.col(f"{first}.place")) & near)

    after_prev = F.when(F.col("_prev").isNull(), True).otherwise(~before("_prev", "first"))
    before_next = F.when(F.col("_next").isNull(), True).otherwise(before("last", "_next"))
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by]
    j = samples.drop("part").join(named, [*same, after_prev, before_next], "left")
    moved = x + F.coalesce(F.col("intercept") + F.col("slope") * x, F.lit(0.0))
    return j.select(*[moved.alias(t) if c == t else F.col(c) for c in samples.columns if c != "part"], F.coalesce("part", F.lit(0)).cast("long").alias("part"))


def dejittered(samples: DataFrame, by: list[str], rate: str, t: str = "t") -> DataFrame:
    """samples (seq, part, and the stream's nominal rate) with t on a line by seq inside every stretch that neither a
    break nor a reset parts, and stretch: its number. Streams without a rate keep their times; so do samples without
    one, which part a stretch."""
    w = Window.partitionBy(*by).orderBy("seq")
    x, before = F.col(t), F.lag(t).over(w)
    far = x - before > F.greatest(F.lit(float(BREAK_S)), F.try_divide(F.lit(float(BREAK_STEPS)), F.col(rate)))
    cut = x.isNull() | before.isNull() | far | (F.col("part") != F.lag("part").over(w))
    d = samples.withColumn("stretch", F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    whole, known = Window.partitionBy(*by, "stretch"), x.isNotNull() & (F.col(rate) > 0)
    d = d.withColumn("_s0", F.min("seq").over(whole)).withColumn("_t0", F.min_by(t, "seq").over(whole))
    d = d.withColumn("_x", F.when(known, (F.col("seq") - F.col("_s0")).cast("double"))).withColumn("_y", x - F.col("_t0"))
    d = d.withColumn("_b", F.regr_slope("_y", "_x").over(whole)).withColumn("_a", F.regr_intercept("_y", "_x").over(whole))
    even = F.col("_t0") + F.col("_a") + F.col("_b") * F.col("_x")
    return d.select(*[F.coalesce(even, x).alias(t) if c == t else F.col(c) for c in samples.columns], "stretch")
