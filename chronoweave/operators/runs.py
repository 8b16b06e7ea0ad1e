"""Runs, fills and events of one sequence per key: gaps and islands over one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], on: list[str]):
    return Window.partitionBy(*by).orderBy(*on)


def _back(by: list[str], on: list[str]):
    """The same order backwards, from the last row to the current one: a frame that only grows, as _w's does."""
    return Window.partitionBy(*by).orderBy(*[F.desc(c) for c in on]).rowsBetween(Window.unboundedPreceding, 0)


def with_run(rows: DataFrame, by: list[str], on: list[str], *values: str, name: str = "run") -> DataFrame:
    """rows numbered by run: a run ends where one of the values changes (nulls are equal)."""
    w = _w(by, on)
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    first = F.row_number().over(w) == 1
    out = rows.withColumn("_new", F.when(first | changed, 1).otherwise(0))
    return out.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def forward_filled(x: str, by: list[str], on: list[str]) -> Column:
    return F.last(x, ignorenulls=True).over(_w(by, on).rowsBetween(Window.unboundedPreceding, 0))


def backward_filled(x: str, by: list[str], on: list[str]) -> Column:
    return F.last(x, ignorenulls=True).over(_back(by, on))


def rolling_median(x: str, by: list[str], on: list[str], n: int, least: int) -> Column:
    """Median of the last n rows where at least `least` have a value."""
    w = _w(by, on).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.percentile(F.col(x), 0.5).over(w))


def moving_mean(x: str, by: list[str], on: list[str], width: int) -> Column:
    """Centred mean with nothing beyond the ends: sums are divided by the full width everywhere."""
    h = (width - 1) // 2
    return F.sum(x).over(_w(by, on).rowsBetween(-(width - 1 - h), h)) / width


def widened(flag: str, by: list[str], on: list[str], k: int) -> Column:
    """True within k rows of a true row."""
    return F.max(F.col(flag)).over(_w(by, on).rowsBetween(-k, k))


def short_gaps_filled(rows: DataFrame, by: list[str], on: list[str], value: str, longest: int) -> DataFrame:
    """rows with value filled and filled true in runs of at most `longest` nulls: on the line by row number between
    the neighbours, or the nearest value at an end."""
    w = _w(by, on)
    r = rows.withColumn("_n", F.row_number().over(w)).withColumn("_null", F.col(value).isNull())
    r = with_run(r, by, on, "_null", name="_run")
    r = r.withColumn("_len", F.count("*").over(Window.partitionBy(*by, "_run")))
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    r = r.withColumn("_a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(point, ignorenulls=True).over(_back(by, on)))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide((F.col("_n") - F.col("_a.n")).cast("double"), (F.col("_b.n") - F.col("_a.n")).cast("double"))
    guess = F.coalesce(line, F.col("_a.v"), F.col("_b.v"))
    fill = F.col("_null") & (F.col("_len") <= longest) & guess.isNotNull()
    return r.select(*[c for c in rows.columns if c != value], F.when(fill, guess).otherwise(F.col(value)).alias(value), fill.alias("filled"))


def hysteresis(rows: DataFrame, by: list[str], on: list[str], closed: str, opened: str, name: str = "event") -> DataFrame:
    """rows with the number of the event they belong to (null outside): an event starts at a closed row, ends with the
    first opened row after it, inclusive, or with the last row. A row that is both toggles the state.

    The state after a row is the last value that was set, turned over by the toggles since."""
    w = _w(by, on).rowsBetween(Window.unboundedPreceding, 0)
    c, o = F.coalesce(F.col(closed), F.lit(False)), F.coalesce(F.col(opened), F.lit(False))
    r = rows.withColumn("_toggles", F.sum(F.when(c & o, 1).otherwise(0)).over(w))
    mark = F.when(c & ~o, F.struct(F.lit(1).alias("v"), F.col("_toggles").alias("k"))).when(o & ~c, F.struct(F.lit(0).alias("v"), F.col("_toggles").alias("k")))
    r = r.withColumn("_set", F.last(mark, ignorenulls=True).over(w))
    state = (F.coalesce(F.col("_set.v"), F.lit(0)) + F.col("_toggles") - F.coalesce(F.col("_set.k"), F.lit(0))) % 2
    r = r.withColumn("_after", state).withColumn("_before", F.coalesce(F.lag("_after").over(_w(by, on)), F.lit(0)))
    inside = (F.col("_after") == 1) | (F.col("_before") == 1)
    start = inside & (F.col("_before") == 0)
    r = r.withColumn(name, F.when(inside, F.sum(F.when(start, 1).otherwise(0)).over(w)))
    return r.drop("_toggles", "_set", "_after", "_before")


def merged_intervals(events: DataFrame, by: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Intervals of a key merged where the next begins less than `gap` after all before have ended."""
    w = _w(by, [start, end])
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("_new", F.when(last.isNull() | (F.col(start) - last >= gap), 1).otherwise(0))
    e = e.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def events_of(rows: DataFrame, by: list[str], on: str, event: str, inside: Column) -> DataFrame:
    """start, end, n of each event over its rows that pass `inside`."""
    return rows.where(F.col(event).isNotNull() & inside).groupBy(*by, event).agg(F.min(on).alias("start"), F.max(on).alias("end"), F.count("*").alias("n"))


def closures(rows: DataFrame, by: list[str], on: list[str], t: str, closed: Column, opened: Column, least: float, most: float, keep: list[str] = ()) -> DataFrame:
    """start, end, duration of each closure between two open rows, and what `keep` is at its start. A closure lasts at
    least from its first to its last closed row, and at most from the open row before to the one after: duration is the
    middle of both, and must lie within least .. most. Closures that touch an end of the sequence are left out."""
    r = rows.withColumn("_closed", F.coalesce(closed, F.lit(False))).withColumn("_opened", F.coalesce(opened, F.lit(False)))
    r = hysteresis(r, by, on, "_closed", "_opened", name="_event")
    at = F.when(F.col("_opened"), F.col(t))
    r = r.withColumn("_before", F.last(at, ignorenulls=True).over(_w(by, on).rowsBetween(Window.unboundedPreceding, -1)))
    later = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in on]).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_after", F.last(at, ignorenulls=True).over(later))
    order = F.struct(*on)
    e = r.where(F.col("_closed") & F.col("_event").isNotNull()).groupBy(*by, "_event").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.min_by("_before", order).alias("_before"), F.max_by("_after", order).alias("_after"),
        *[F.min_by(c, order).alias(c) for c in keep],
    )
    duration = ((F.col("end") - F.col("start")) + (F.col("_after") - F.col("_before"))) / 2
    return e.withColumn("duration", duration).where(F.col("duration").between(least, most)).select(*by, *keep, "start", "end", "duration")


def label_runs(rows: DataFrame, by: list[str], on: list[str], label: str, scope: str, time: str) -> DataFrame:
    """Runs of a label: start, end, n, scopes (distinct, null included) and complete: the run touches neither end of
    the sequence and its neighbours are in its scope."""
    w = _w(by, on)
    r = with_run(rows, by, on, label)
    r = r.withColumn("_prev", F.lag(scope).over(w)).withColumn("_next", F.lead(scope).over(w)).withColumn("_n", F.row_number().over(w)).withColumn("_size", F.count("*").over(Window.partitionBy(*by)))
    first, last = F.min_by(F.struct("_prev", "_n"), "_n"), F.max_by(F.struct("_next", "_n"), "_n")
    g = r.groupBy(*by, "run").agg(
        F.first(label).alias(label), F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"),
        (F.countDistinct(scope) + F.max(F.col(scope).isNull().cast("int"))).alias("scopes"), F.min(scope).alias("_scope"),
        first.alias("_f"), last.alias("_l"), F.first("_size").alias("_size"),
    )
    whole = (F.col("scopes") == 1) & (F.col("_f._n") > 1) & (F.col("_l._n") < F.col("_size")) & F.col("_f._prev").eqNullSafe(F.col("_scope")) & F.col("_l._next").eqNullSafe(F.col("_scope"))
    return g.select(*by, "run", label, "start", "end", "n", "scopes", whole.alias("complete"))


def segments(rows: DataFrame, by: list[str], on: str, value: str, longest_step: float, then: list[str] = ()) -> DataFrame:
    """Contiguous stretches: a step longer than allowed, or a null, parts them. start, end, n. Rows of one place follow
    each other as `then` says."""
    w = _w(by, [on, *then])
    known = rows.withColumn("_null", F.col(value).isNull()).withColumn("_step", F.col(on) - F.lag(on).over(w)).withColumn("_was", F.lag(F.col(value).isNull()).over(w))
    cut = F.col("_null") | F.coalesce(F.col("_was"), F.lit(True)) | (F.col("_step") > longest_step)
    s = known.withColumn("segment", F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("NOT _null").groupBy(*by, "segment").agg(F.min(on).alias("start"), F.max(on).alias("end"), F.count("*").alias("n"))
