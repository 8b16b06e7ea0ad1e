"""Joins along time: backward, nearest and interpolating.

Both sides are united and sorted per key; the neighbour comes from the last value met along the order, once forwards and,
where a later neighbour is asked for, once backwards. One shuffle on the key, a sort for each direction, one pass over
each (frames only ever grow, so that no row looks at its frame anew), no range join. Columns of the right side must
differ from the left's. A null key is a key like any other. A key's rows are one task's, unless `cell` deals them by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _united(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    own = F.struct(*[F.col(c) for c in left.columns]).alias("_row")
    at = F.struct(F.col(on).alias("t"), *[F.col(v) for v in values]).alias("_right")
    a = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), own)
    b = right.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), at)
    return a.unionByName(b, allowMissingColumns=True)


def _neighbours(u: DataFrame, by: list[str], cell: float) -> DataFrame:
    """u with before and after, a key's rows being dealt to cells of time, so that one long recording is many tasks. What
    a cell hasn't, its neighbours carry: a row for each cell holds its first and last right row, and only these go
    through one task for each key. Rows without a time have no neighbours."""
    u = u.withColumn("_key", F.struct(*by)).withColumn("_cell", F.struct("_key", F.floor(F.col("_t") / cell).alias("c")))
    at = F.when(F.col("_side") == 0, F.col("_t"))
    ends = u.where("_t IS NOT NULL").groupBy("_cell").agg(F.max_by("_right", at).alias("_last"), F.min_by("_right", at).alias("_first"))
    row = (Window.unboundedPreceding, -1)
    w, back = Window.partitionBy("_cell._key").orderBy("_cell.c"), Window.partitionBy("_cell._key").orderBy(F.desc("_cell.c"))
    ends = ends.select("_cell", F.last("_last", ignorenulls=True).over(w.rowsBetween(*row)).alias("_earlier"), F.last("_first", ignorenulls=True).over(back.rowsBetween(*row)).alias("_later"))
    here = (Window.unboundedPreceding, 0)
    up = Window.partitionBy("_cell").orderBy("_t", "_side").rowsBetween(*here)
    down = Window.partitionBy("_cell").orderBy(F.desc("_t"), "_side").rowsBetween(*here)
    u = u.join(ends, "_cell", "left")
    u = u.withColumn("before", F.coalesce(F.last("_right", ignorenulls=True).over(up), F.col("_earlier")))
    return u.withColumn("after", F.coalesce(F.last("_right", ignorenulls=True).over(down), F.col("_later")))


def backward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], bounded: bool = True, tie: str | None = None, cell: float | None = None) -> DataFrame:
    """left with values of the last right row at or before its time; bounded: null after the last right time. Of right
    rows at one time the one with the largest `tie` counts. cell: seconds of a cell of time, for recordings too long for
    a task."""
    if tie:
        right = right.groupBy(*by, on).agg(*[F.max_by(v, tie).alias(v) for v in values])
    if cell is not None:
        u = _neighbours(_united(left, right, by, on, values), by, cell)
        hit = F.when(F.col("after").isNotNull(), F.col("before")) if bounded else F.col("before")
        return u.where("_side = 1").withColumn("_hit", hit).select("_row.*", *[F.col(f"_hit.{v}").alias(v) for v in values])
    over = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = _united(left, right, by, on, values).withColumn("_hit", F.last("_right", ignorenulls=True).over(over))
    if bounded:
        end = F.max(F.when(F.col("_side") == 0, F.col("_t"))).over(Window.partitionBy(*by))
        u = u.withColumn("_hit", F.when(F.col("_t") <= end, F.col("_hit")))
    return u.where("_side = 1").select("_row.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def around(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], cell: float | None = None, tasks: int | None = None) -> DataFrame:
    """left with structs before (right rows at or before) and after (at or after), each of t and values. tasks: how many
    the keys are dealt to, which bounds what one sorts; otherwise as many as the session's shuffles have."""
    if cell is not None:
        return _neighbours(_united(left, right, by, on, values), by, cell).where("_side = 1").select("_row.*", "before", "after")
    up = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = _united(left, right, by, on, values)
    if tasks is not None:
        u = u.repartition(tasks, *by)
    u = u.withColumn("before", F.last("_right", ignorenulls=True).over(up)).withColumn("after", F.last("_right", ignorenulls=True).over(down))
    return u.where("_side = 1").select("_row.*", "before", "after")


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], cell: float | None = None, tasks: int | None = None) -> DataFrame:
    """left with values of the right row nearest in time, the earlier at equal distance."""
    near = around(left, right, by, on, values, cell, tasks)
    late = F.col("before").isNull() | (F.col("after.t") - F.col(on) < F.col(on) - F.col("before.t"))
    return near.select(*left.columns, *[F.when(late & F.col("after").isNotNull(), F.col(f"after.{v}")).otherwise(F.col(f"before.{v}")).alias(v) for v in values])


def interpolated(grid: DataFrame, samples: DataFrame, by: list[str], on: str, value: str, max_gap: float | None = None, open_start: bool = True, cell: float | None = None) -> DataFrame:
    """grid with the value on the line between the samples around its time. With max_gap a point is null where they
    lie further apart; open_start: also at the first sample itself, which has no earlier neighbour."""
    near = around(grid, samples, by, on, [value], cell)
    t, a, b = F.col(on), F.col("before"), F.col("after")
    span = b["t"] - a["t"]
    line = F.when(span == 0, a[value]).otherwise(a[value] + (b[value] - a[value]) * F.try_divide(t - a["t"], span))
    if max_gap is not None:
        known = samples.where(F.col(value).isNotNull())
        steps = known.select(*by, on, value, F.lag(on).over(Window.partitionBy(*by).orderBy(on)).alias("_prev"))
        # at a sample the gap that counts is the one before it
        near = around(grid, steps, by, on, [value, "_prev"], cell)
        gap = F.when(span == 0, t - b["_prev"]).otherwise(span)
        ok = gap <= max_gap
        line = F.when(F.coalesce(ok, F.lit(not open_start)), line)
    return near.select(*grid.columns, line.alias(value))


def membership(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, members: list, name: str = "member") -> DataFrame:
    """Whether the value in force at each time is a member; null where the time is null or outside the right side's span."""
    start = right.groupBy(*by).agg(F.min(on).alias("_start"))
    hit = backward(left, right, by, on, [value]).join(start, by, "left")
    inside = F.col(on).isNotNull() & (F.col(on) >= F.col("_start")) & F.col(value).isNotNull()
    return hit.select(*left.columns, F.when(inside, F.col(value).isin(*members)).alias(name))


def neighbours_where(rows: DataFrame, by: list[str], on: list[str], test: Column, value: str) -> DataFrame:
    """rows with the value of the nearest earlier (previous) and later (following) row that passes the test."""
    up, down = Window.partitionBy(*by).orderBy(*on), Window.partitionBy(*by).orderBy(*[F.desc(c) for c in on])
    last = F.last(F.when(test, F.col(value)), ignorenulls=True)
    before = (Window.unboundedPreceding, -1)
    return rows.withColumn("previous", last.over(up.rowsBetween(*before))).withColumn("following", last.over(down.rowsBetween(*before)))
