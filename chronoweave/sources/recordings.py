"""Recordings out of containers: which streams stand for what, and in which unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clock_sync, quality
from . import xdf_scan

STREAM = ["path", "stream_id"]


def load(files: DataFrame, requested: dict[str, list[str] | None], synchronise: bool = True, dejitter: bool = True, split_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Samples (xdf_scan.SAMPLES) of the requested streams and channels of containers (path), and the status of every
    request. With synchronise, times are on the recorder's clock, by the file's own clock offsets; with dejitter, evenly
    spaced inside unbroken stretches of streams that have a rate. With neither, they are as they were written."""
    indexed = xdf_scan.index(files, list(requested), split_bytes)
    samples = xdf_scan.scan(indexed, requested)
    if synchronise:
        samples = clock_sync.synchronised(samples, xdf_scan.clock_offsets(files, list(requested)), STREAM)
    if dejitter:
        parted = samples if synchronise else samples.withColumn("part", F.lit(0).cast("long"))
        samples = clock_sync.dejittered(parted, STREAM, "rate")
    return samples.select(*[c.split()[0] for c in xdf_scan.SAMPLES.split(", ")]), xdf_scan.stream_status(indexed, requested)


def checked(samples: DataFrame) -> DataFrame:
    """path, stream, n, status of numeric streams that an alignment may use: at least two samples, as many numbers as
    labels everywhere, times that are finite and increase; else what is wrong, the first that is."""
    audit = quality.timestamp_audit(samples, ["path", "stream"], "seq", "t")
    shape = samples.groupBy("path", "stream").agg(F.count_if(F.coalesce(F.size("numbers") != F.size("labels"), F.lit(True))).alias("odd"))
    status = F.when(F.col("n") < 2, "too few samples").when(F.col("odd") > 0, "labels do not match").when(F.col("missing") > 0, "times missing").when(F.col("backward") + F.col("repeated") > 0, "times do not increase").otherwise("ready")
    return audit.join(shape, ["path", "stream"]).select("path", "stream", "n", status.alias("status"))


def side_by_side(samples: DataFrame, streams: list[str], limit: float | None = 1e9) -> DataFrame:
    """path, t and a column <stream>.<channel> for every channel of numeric streams, of any number of streams: rows with
    equal times of a file are one, its first value by seq standing for a channel. Of several streams of a name the
    longest counts. Values above the limit, and NaN, are null."""
    wanted = longest(samples.where(F.col("stream").isin(*streams) & F.col("numbers").isNotNull()))
    long = wanted.select("path", "stream", "seq", "t", F.explode(F.arrays_zip("labels", "numbers")).alias("c"))
    value = F.when(~F.isnan("c.numbers") & ((F.col("c.numbers") <= limit) if limit is not None else F.lit(True)), F.col("c.numbers"))
    long = long.select("path", "t", "seq", F.concat_ws(".", "stream", "c.labels").alias("channel"), value.alias("value"))
    names = [r[0] for r in wanted.select("stream", F.explode("labels").alias("label")).distinct().select(F.concat_ws(".", "stream", "label").alias("c")).orderBy("c").collect()]
    return long.where("t IS NOT NULL").groupBy("path", "t").pivot("channel", names).agg(F.min_by("value", "seq"))



def longest(streams: DataFrame) -> DataFrame:
    """Samples (path, stream, stream_id, seq, t, ...) of one stream per name: of several the longest, then the first."""
    n = streams.groupBy("path", "stream", "stream_id").agg(F.count("*").alias("_n"))
    best = n.groupBy("path", "stream").agg(F.max_by("stream_id", F.struct("_n", F.negative("stream_id"))).alias("stream_id"))
    return streams.join(best, ["path", "stream", "stream_id"], "left_semi")


def preferred(streams: DataFrame, names: list[str]) -> DataFrame:
    """Samples of the first of names that each recording has."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("stream"))
    first = streams.where(rank > 0).groupBy("path").agg(F.min_by("stream", rank).alias("stream"))
    return streams.join(first, ["path", "stream"], "left_semi")


def channels(samples: DataFrame, scale: float = 1.0, drop: tuple[str, ...] = ()) -> DataFrame:
    """path, stream, seq, t, channel, value of numeric streams, times `scale` (1e-6 for microvolts), but for bad channels."""
    long = samples.where("numbers IS NOT NULL").select("path", "stream", "seq", "t", F.explode(F.arrays_zip("labels", "numbers")).alias("c"))
    return long.where(~F.col("c.labels").isin(*drop) if drop else F.lit(True)).select("path", "stream", "seq", "t", F.col("c.labels").alias("channel"), (F.col("c.numbers") * scale).alias("value"))


def markers(samples: DataFrame, pattern: str) -> DataFrame:
    """path, t, marker of text streams whose first channel matches."""
    m = samples.where("texts IS NOT NULL").select("path", "t", F.get("texts", F.lit(0)).alias("marker"))
    return m.where(F.col("marker").rlike(pattern))


def scenarios(samples: DataFrame, channel: str = "ScenarioID") -> DataFrame:
    """path, t, scenario: the simulator's scenario as a whole number, in no order: a window or a writer sorts by what it needs."""
    c = channels(samples).where((F.col("channel") == channel) & F.col("value").isNotNull() & ~F.isnan("value"))
    return c.select("path", "t", F.floor("value").cast("long").alias("scenario"))


def bipolar(samples: DataFrame, a: str, b: str) -> DataFrame:
    """path, seq, t and the difference of two channels."""
    p = samples.where(F.col("channel").isin(a, b)).groupBy("path", "seq", "t").pivot("channel", [a, b]).agg(F.first("value"))
    return p.select("path", "seq", "t", (F.col(a) - F.col(b)).alias("value"))


def first_times(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("t").isNotNull()).groupBy("path", "stream").agg(F.min_by("t", "seq").alias("t"))


def to_frame(x: Column, y: Column, roi: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Landmark shares of a region (left, top, width, height, as shares of the frame) as shares of the frame."""
    left, top, width, height = roi
    return left + x * width, top + y * height


def available_jobs(summary: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs of a summary table with what stands in the way: unusable, missing, ambiguous, or ready."""
    n = listing.groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    j = summary.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(~F.col("usable"), "unusable").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("ready")
    return j.withColumn("status", status)
