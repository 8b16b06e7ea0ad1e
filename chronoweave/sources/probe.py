"""What a video probe wrote, a JSON file a video with streams, packets or frames, as tables of operators.frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = (
    "streams array<struct<codec_name: string, time_base: string, width: int, height: int, field_order: string, has_b_frames: int, nb_frames: string, disposition: struct<attached_pic: int>>>, "
    "packets array<struct<pts: string, dts: string, flags: string>>, frames array<struct<best_effort_timestamp: string, key_frame: int>>"
)


def read_probe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """streams, packets and frames; video is the file's name without its folder and .json. A file that isn't JSON has no
    row in any of them."""
    files = spark.read.schema(_FILE).option("multiLine", True).json(path)
    video = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    files = files.withColumn("video", video)
    streams = files.select("video", F.explode("streams").alias("s")).select("video", "s.codec_name", "s.time_base", "s.width", "s.height", "s.field_order", "s.has_b_frames", "s.nb_frames", F.col("s.disposition.attached_pic").alias("attached_pic"))
    packets = files.select("video", F.posexplode("packets").alias("place", "p")).select("video", F.col("place").cast("long").alias("place"), "p.pts", "p.dts", "p.flags")
    frames = files.select("video", F.posexplode("frames").alias("place", "f")).select("video", F.col("place").cast("long").alias("place"), "f.best_effort_timestamp", "f.key_frame")
    return streams, packets, frames
