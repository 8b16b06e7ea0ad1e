"""Epochs around markers, and their spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


def within_segments(markers: DataFrame, segments: DataFrame, by: list[str], t: str, low: float, high: float, cell: float = 60.0) -> DataFrame:
    """Markers with the segment that holds t + low .. t + high whole. Segments are dealt to cells of time, so that the
    join is an equality on (key, cell) and a marker meets only the segments around it."""
    s = segments.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    m = markers.withColumn("_cell", F.floor((F.col(t) + low) / cell))
    return m.join(s, [*by, "_cell"]).where((F.col(t) + low >= F.col("start")) & (F.col(t) + high <= F.col("end"))).drop("_cell")


def epochs(samples: DataFrame, markers: DataFrame, low: float, high: float, hz: float, band: tuple[float, float] | None = None, notch: float | None = None, pad: float = 3.0) -> DataFrame:
    """rec, channel, marker, at, values: each marker's stretch of a channel (rec, channel, t, value) on a regular
    grid, filtered without phase. Parameters must make sense (hz above 0, low below high). A marker whose padded stretch the samples don't hold without a gap is left out."""
    if hz <= 0 or high <= low or pad < 0:
        raise ValueError(f"epochs need hz above 0, low below high and no negative pad: {hz}, {low}, {high}, {pad}")
    # a recording's markers meet each of its channels' samples as a group of their own, not beside every sample
    asked = markers.select("rec", "marker", "at").join(samples.select("rec", "channel").distinct(), "rec")
    asked = asked.select(*[F.col(c).alias(c) for c in ("rec", "channel", "marker", "at")])  # columns of its own

    def run(key, g, asks):
        g = g.dropna(subset=["t", "value"]).sort_values("t")
        t, v = K.distinct_times(g["t"].to_numpy(float), g["value"].to_numpy(float))
        sections = []
        if band:
            sections += [K.biquad("high", hz, band[0], 2**-0.5), K.biquad("low", hz, band[1], 2**-0.5)]
        if notch:
            sections.append(K.biquad("notch", hz, notch, 30.0))
        rows = []
        n, extra = int(round((high - low) * hz)) + 1, int(round(pad * hz))
        for name, at in zip(asks["marker"], asks["at"], strict=True):
            grid = at + low + (np.arange(n + 2 * extra) - extra) / hz
            if not len(t) or grid[0] < t[0] or grid[-1] > t[-1]:
                continue
            a, b = np.searchsorted(t, [grid[0], grid[-1]])
            if b > a and np.diff(t[max(0, a - 1) : b + 1]).max() > 1.5 / hz:
                continue
            x = np.interp(grid, t, v)
            x = K.zero_phase(x, sections) if sections else x
            rows.append((*key, name, at, x[extra : extra + n].tolist()))
        return pd.DataFrame(rows, columns=["rec", "channel", "marker", "at", "values"])

    return samples.select("rec", "channel", "t", "value").groupBy("rec", "channel").cogroup(asked.groupBy("rec", "channel")).applyInPandas(run, "rec long, channel string, marker string, at double, values array<double>")


def accepted(epochs_: DataFrame, most: float, least: float) -> DataFrame:
    """Epochs whose peak-to-peak range is neither too large nor flat."""
    span = F.array_max("values") - F.array_min("values")
    return epochs_.where((span <= most) & (span >= least))


def mean_power(epochs_: DataFrame, hz: float, window_s: float = 0.75, step_s: float = 0.025, low: float = 2.0, high: float = 40.0) -> DataFrame:
    """rec, marker, freq, t, power, n: spectra averaged over a recording's epochs of a marker."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                f, t, p = K.spectrogram(np.asarray(r.values, dtype=float), hz, window_s, step_s, low, high)
                rows += [(r.rec, r.marker, float(a), float(b), float(p[i, j])) for i, a in enumerate(f) for j, b in enumerate(t)]
            yield pd.DataFrame(rows, columns=["rec", "marker", "freq", "t", "power"])

    long = epochs_.select("rec", "marker", "values").mapInPandas(run, "rec long, marker string, freq double, t double, power double")
    return long.groupBy("rec", "marker", "freq", "t").agg(F.avg("power").alias("power"), F.count("*").alias("n"))
