"""Frames of videos as tables: an exact index out of what a probe tells of packets and frames, exact times for rows that
were made frame by frame, and plans of which frames to decode for given times.

Ticks stay whole numbers and time bases whole fractions up to the last step, a division of doubles. What is wrong with a
video is a status in an audit and never a wrong time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import asof, runs

STREAMS = "video string, codec_name string, time_base string, width int, height int, field_order string, has_b_frames int, nb_frames string, attached_pic int"
PACKETS = "video string, place long, pts string, dts string, flags string"
FRAMES = "video string, place long, best_effort_timestamp string, key_frame int"

#: A decoded frame's time may be off by a tenth of the shorter step beside it, or by a millisecond.
TOLERANCE_S, TOLERANCE_STEPS = 0.001, 0.1
#: Steps of Euclid's algorithm that bring any two 64-bit numbers to their common divisor.
_EUCLID = 92


#: How many times the session's tasks frames are dealt to: a task sorts its videos' frames several times at once.
_FINER = 8


def fine_tasks(spark: SparkSession) -> int:
    return _FINER * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def _tick(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^[+-]?[0-9]+$"), F.trim(x).try_cast("long"))


def time_base(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator, without a common divisor, of "num/den"; null unless both are positive."""
    parts = F.split(F.trim(text), "/")
    num, den = _tick(F.get(parts, F.lit(0))), _tick(F.coalesce(F.get(parts, F.lit(1)), F.lit("1")))
    good = (num > 0) & (den > 0) & (F.size(parts) <= 2)
    pair = F.struct(num.alias("a"), den.alias("b"))
    gcd = F.aggregate(F.array_repeat(F.lit(0), _EUCLID), pair, lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % F.nullif(x["b"], F.lit(0))).alias("b"))), lambda x: x["a"])
    return F.when(good, F.expr("1L") * (num / gcd).cast("long")), F.when(good, (den / gcd).cast("long"))


def by_packets(streams: DataFrame, packets: DataFrame) -> DataFrame:
    """video of those whose packets stand for their frames one to one: one progressive H.264 stream without reordered
    frames, as many packets as it says, each with one time for decoding and showing, none to be dropped or broken, the
    first a key frame, times increasing."""
    tick, flags = _tick(F.col("pts")), F.coalesce("flags", F.lit(""))
    w = Window.partitionBy("video").orderBy("place")
    p = packets.withColumn("_tick", tick).withColumn("_same", tick == _tick(F.col("dts"))).withColumn("_up", F.coalesce(tick > F.lag(tick).over(w), F.row_number().over(w) == 1))
    facts = p.groupBy("video").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce("_same", F.lit(False)) | ~F.coalesce("_up", F.lit(False)) | flags.contains("D") | flags.contains("C")).alias("bad"),
        F.min_by(flags.contains("K"), "place").alias("key"),
    )
    one = _stream(streams).where((F.col("n_streams") == 1) & (F.lower("codec_name") == "h264") & (F.lower("field_order") == "progressive") & (F.col("has_b_frames") == 0) & (F.col("attached_pic") == 0))
    said = F.col("nb_frames").isNull() | F.col("nb_frames").isin("", "N/A") | (_tick(F.col("nb_frames")) == F.col("n"))
    return one.join(facts, "video").where(said & (F.col("bad") == 0) & F.col("key")).select("video")


def _stream(streams: DataFrame) -> DataFrame:
    first = [c for c in streams.columns if c != "video"]
    return streams.groupBy("video").agg(F.count("*").alias("n_streams"), *[F.first(c).alias(c) for c in first])


def frame_index(streams: DataFrame, packets: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (video, frame from 0, tick, time, key, keyframe: the last key frame up to here, num, den, origin) of
    every sound video, and an audit (video, frames, source, status) of all. Frames come from the packets where they may
    stand for frames, else from the frames; they keep the probe's order, and their ticks must increase. A video without
    a key frame has its first as one."""
    fast = by_packets(streams, packets)
    p = packets.join(fast, "video", "left_semi").select("video", "place", _tick(F.col("pts")).alias("tick"), F.col("flags").contains("K").alias("key"), F.lit("packets").alias("source"))
    f = frames.join(fast, "video", "left_anti").select("video", "place", _tick(F.col("best_effort_timestamp")).alias("tick"), F.coalesce(F.col("key_frame") == 1, F.lit(False)).alias("key"), F.lit("frames").alias("source"))
    w, whole = Window.partitionBy("video").orderBy("place"), Window.partitionBy("video")
    rows = p.unionByName(f).repartition(fine_tasks(packets.sparkSession), "video").withColumn("frame", F.row_number().over(w).cast("long") - 1)
    rows = rows.withColumn("_step", F.col("tick") - F.lag("tick").over(w)).withColumn("_keys", F.count_if("key").over(whole))
    rows = rows.withColumn("key", F.col("key") | ((F.col("_keys") == 0) & (F.col("frame") == 0)))
    facts = rows.groupBy("video").agg(F.count("*").alias("frames"), F.first("source").alias("source"), F.count_if(F.col("tick").isNull()).alias("_lost"), F.count_if(F.col("_step") == 0).alias("_same"), F.count_if(F.col("_step") < 0).alias("_back"), F.min_by("tick", "frame").alias("origin"))
    num, den = time_base(F.col("time_base"))
    s = _stream(streams).select("video", "n_streams", num.alias("num"), den.alias("den"), "width", "height")
    a = s.join(facts, "video", "full")
    status = (
        F.when(F.col("n_streams").isNull(), "no stream").when(F.col("n_streams") > 1, "several streams").when(F.col("num").isNull(), "invalid time base")
        .when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "invalid dimensions").when(F.col("frames").isNull(), "no frames")
        .when(F.col("_lost") > 0, "missing timestamps").when(F.col("_back") > 0, "backward timestamps").when(F.col("_same") > 0, "duplicate timestamps").otherwise("ready")
    )
    a = a.select("video", F.coalesce("frames", F.lit(0)).alias("frames"), "source", status.alias("status"), "num", "den", "origin")
    sound = a.where("status = 'ready'").select("video", "num", "den", "origin")
    keyframe = F.last(F.when(F.col("key"), F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    time = (F.col("tick") - F.col("origin")).cast("double") * F.col("num") / F.col("den")
    out = rows.withColumn("keyframe", keyframe).join(sound, "video").select("video", "frame", "tick", time.alias("time"), "key", F.coalesce("keyframe", F.lit(0)).alias("keyframe"), "num", "den", "origin")
    return out, a.select("video", "frames", "source", "status")


def exact_times(rows: DataFrame, index: DataFrame, video: str = "video", frame: str = "frame_index", order: str = "place") -> tuple[DataFrame, DataFrame]:
    """rows (made frame by frame, in `order`) with exact_time, of every video whose rows are its frames one to one, and
    an audit (video, rows, frames, status) of all videos that have rows."""
    w = Window.partitionBy(video).orderBy(order)
    placed = rows.withColumn("_at", F.row_number().over(w).cast("long") - 1)
    facts = placed.groupBy(video).agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col(frame) == F.col("_at"), F.lit(False))).alias("_off"))
    n = index.groupBy(F.col("video").alias(video)).agg(F.count("*").alias("frames"))
    status = F.when(F.col("frames").isNull(), "no index").when(F.col("_off") > 0, "frame numbers out of place").when(F.col("rows") > F.col("frames"), "more rows than frames").when(F.col("rows") < F.col("frames"), "fewer rows than frames").otherwise("written")
    audit = facts.join(n, video, "left").select(video, "rows", "frames", status.alias("status"))
    good = placed.join(audit.where("status = 'written'").select(video), video, "left_semi")
    times = index.select(F.col("video").alias(video), F.col("frame").alias("_at"), F.col("time").alias("exact_time"))
    return good.join(times, [video, "_at"]).select(*rows.columns, "exact_time"), audit


def lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (video, time, ...) with frame (the nearest, the earlier of two as near; the first or last for times
    outside), keyframe (where decoding must begin) and found: ready, before, after, no time or no index."""
    hit = asof.nearest(wanted, index.select("video", "time", "frame", "keyframe"), ["video"], "time", ["frame", "keyframe"], tasks=fine_tasks(wanted.sparkSession))
    span = index.groupBy("video").agg(F.max("time").alias("_end"))
    j = hit.join(span, "video", "left")
    usable = F.col("time").isNotNull() & ~F.isnan("time") & (F.abs("time") < float("inf"))
    found = F.when(F.col("_end").isNull(), "no index").when(~usable, "no time").when(F.col("time") < 0, "before").when(F.col("time") > F.col("_end"), "after").otherwise("ready")
    return j.select(*wanted.columns, *[F.when(usable, F.col(c)).alias(c) for c in ("frame", "keyframe")], found.alias("found"))


def decode_ranges(found: DataFrame) -> DataFrame:
    """video, first, last, parts: the fewest runs of frames, each from a key frame on, that give all looked-up frames;
    runs that overlap or touch are one."""
    e = found.where("frame IS NOT NULL").select("video", F.col("keyframe").alias("first"), F.col("frame").alias("last"))
    return runs.merged_intervals(e, ["video"], "first", "last", 2)


def verified(decoded: DataFrame, index: DataFrame) -> DataFrame:
    """decoded (video, frame: the wanted one, decoded_frame, decoded_time, ...) with status: what a decoder returned
    against the index, the time within a tenth of the shorter step beside the frame, or a millisecond."""
    w = Window.partitionBy("video").orderBy("frame")
    step = F.least(F.col("time") - F.lag("time").over(w), F.lead("time").over(w) - F.col("time"))
    i = index.withColumn("_near", F.greatest(F.lit(TOLERANCE_S), F.coalesce(step, F.lit(0.0)) * TOLERANCE_STEPS)).select("video", "frame", "_near", F.col("time").alias("_time"))
    j = decoded.join(i, ["video", "frame"], "left")
    near = F.abs(F.col("decoded_time") - F.col("_time")) <= F.col("_near")
    status = F.when(F.col("_time").isNull(), "no such frame").when(~F.col("decoded_frame").eqNullSafe(F.col("frame")), "another frame").when(~F.coalesce(near, F.lit(False)), "another time").otherwise("verified")
    return j.select(*decoded.columns, status.alias("status"))
