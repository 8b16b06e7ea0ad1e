"""Pieces of one sequence found in another by what they hold: windows and pieces meet by hashes, and an ordered pass
decides between the places where a piece stands."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _value(x: Column) -> Column:
    """A hash of a value: missing values are alike, and so are both zeros."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(F.xxhash64(x.cast("double") + F.lit(0.0), F.lit(1)))


def _hashes(values: list[Column], length: Column) -> list[Column]:
    """Two hashes of a piece of so many values: 128 bits, which stand for what it holds."""
    return [F.xxhash64(F.lit(salt), length, *values).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]


def _numbered(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("rec").orderBy("seq")
    return rows.select(F.struct("rec").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.count("*").over(Window.partitionBy("rec")).alias("n"), _value(F.col("value")).alias("h"))


def _windows(rows: DataFrame, size: int, length: Column) -> DataFrame:
    """key, pos, h1, h2 of the piece of `length` (at most size) values that begins at each place and ends in time."""
    w = Window.partitionBy("key").orderBy("pos")
    ahead = rows.select("key", "pos", "n", length.alias("length"), *[F.coalesce(F.lead("h", j).over(w), F.lit(0)).alias(f"_{j}") for j in range(size)])
    values = [F.when(F.col("length") > j, F.col(f"_{j}")).otherwise(F.lit(0)) for j in range(size)]
    return ahead.where((F.col("length") > 0) & (F.col("pos") + F.col("length") <= F.col("n"))).select("key", "pos", *_hashes(values, F.col("length")))


def _pass(size: int, radius: int):
    """One recording in order: its pieces, and those places of the other sequence that hold any of them."""

    def run(key, places: pa.Table, pieces: pa.Table) -> pa.Table:
        h1, h2, at = (places.column(c).to_numpy() for c in ("h1", "h2", "pos"))
        order = np.lexsort((at, h2, h1))
        h1, h2, pos = h1[order], h2[order], at[order].tolist()
        cuts = (np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1).tolist()
        begins = [0, *cuts] if pos else []
        of = {k: ends for k, *ends in zip(zip(h1[begins].tolist(), h2[begins].tolist(), strict=True), begins, [*cuts, len(pos)], strict=False)}
        last, starts, many = None, [], []
        pieces = pieces.sort_by("chunk")
        for a, b, first in zip(*(pieces.column(c).to_pylist() for c in ("h1", "h2", "expected")), strict=True):
            low, high = of.get((a, b), (0, 0))
            expected = (None if first != first else first) if last is None else last + size
            if last is not None and low < high:
                i = bisect_left(pos, expected, low, high)
                if i < high and pos[i] == expected:
                    low, high = i, i + 1
                else:
                    near = bisect_left(pos, expected - radius, low, high), bisect_right(pos, expected + radius, low, high)
                    low, high = near if near[0] < near[1] else (low, high)
            if low < high:
                i = low if expected is None else bisect_left(pos, expected, low, high)
                if i == high or (i > low and expected - pos[i - 1] <= pos[i] - expected):
                    i -= 1
                last = pos[i]
            starts.append(last if low < high else None)
            many.append(high - low)
        rec = key[0].as_py()["rec"]
        return pa.table({"rec": pa.array([rec] * len(starts), pa.int64()), "chunk": pieces.column("chunk"), "start": pa.array(starts, pa.int64()), "candidates": pa.array(many, pa.int64())})

    return run


def matched_chunks(raw: DataFrame, copy: DataFrame, size: int = 20, radius: int = 7500, expected: DataFrame | None = None) -> DataFrame:
    """rec, chunk, start, candidates: where each piece of `size` values of a copied sequence (rec, seq, value; the last
    may be shorter) stands in the raw one, by row number, null if nowhere. Missing values are equal to each other.

    A piece is looked for where the one found before ends, then within `radius` of there, then anywhere; of several
    places the nearest to there counts, the earlier of two as near. Before the first find the place is that of
    `expected` (rec, expected), or the first. Only places that hold a piece of the copy reach the ordered pass, which a
    recording makes in one task: in ordinary signals as many as there are pieces."""
    a, b = _numbered(raw), _numbered(copy)
    tails = b.groupBy("key").agg((F.max("n") % size).cast("int").alias("_tail"))
    pieces = _windows(b, size, F.least(F.col("n") - F.floor(F.col("pos") / size) * size, F.lit(size)).cast("int")).where(F.col("pos") % size == 0)
    pieces = pieces.select("key", F.floor(F.col("pos") / size).alias("chunk"), "h1", "h2")
    whole = _windows(a, size, F.lit(size))
    short = _windows(a.join(tails.where("_tail > 0"), "key"), size, F.col("_tail"))
    places = whole.unionByName(short).join(pieces.select("key", "h1", "h2").distinct(), ["key", "h1", "h2"], "left_semi")
    if expected is not None:
        pieces = pieces.join(expected.select(F.struct("rec").alias("key"), F.col("expected").cast("double").alias("expected")), "key", "left")
    else:
        pieces = pieces.withColumn("expected", F.lit(None).cast("double"))
    return places.groupBy("key").cogroup(pieces.groupBy("key")).applyInArrow(_pass(size, radius), "rec long, chunk long, start long, candidates long")
