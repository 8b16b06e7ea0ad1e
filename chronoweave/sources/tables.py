"""Text sources with fixed schemas, listings, and sinks with fixed column order."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import quality

_EYE = "struct<gazeorigin: array<double>, gazedirection: array<double>, pupildiameter: double>"
GAZE = f"timestamp double, data struct<gaze2d: array<double>, gaze3d: array<double>, eyeleft: {_EYE}, eyeright: {_EYE}>"
IMU = "timestamp double, data struct<magnetometer: array<double>, accelerometer: array<double>, gyroscope: array<double>>"


@dataclass(frozen=True)
class Config:
    """A JSON file of sections of paths: ~ and environment variables are expanded, relative paths start at the file."""

    file: Path
    sections: dict

    @classmethod
    def load(cls, path: str) -> Config:
        file = Path(os.path.expanduser(os.path.expandvars(path))).resolve()
        return cls(file, json.loads(file.read_text(encoding="utf-8")))

    def path(self, section: str, key: str) -> Path:
        at = Path(os.path.expanduser(os.path.expandvars(self.sections[section][key])))
        return at if at.is_absolute() else (self.file.parent / at).resolve()


def read_gaze(spark: SparkSession, path: str) -> DataFrame:
    """Gaze packets (JSON lines, gz too) as one flat row each; what a packet lacks is null. A broken
    archive gives the rows before the break, or none, and no error."""
    raw = spark.read.schema(GAZE).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).json(path)
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    axes = lambda c, name: [at(c, k).alias(f"{name}_{a}") for k, a in enumerate("xyz")]
    return raw.where("timestamp IS NOT NULL").select(
        F.col("timestamp").alias("t"), at("data.gaze2d", 0).alias("gaze2d_x"), at("data.gaze2d", 1).alias("gaze2d_y"), *axes("data.gaze3d", "gaze3d"),
        *axes("data.eyeleft.gazedirection", "left_direction"), *axes("data.eyeright.gazedirection", "right_direction"),
        F.col("data.eyeleft.pupildiameter").alias("left_pupil"), F.col("data.eyeright.pupildiameter").alias("right_pupil"),
    )


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(IMU).option("ignoreCorruptFiles", True).json(path)
    return raw.where("timestamp IS NOT NULL").select(F.col("timestamp").alias("t"), *[F.get(F.col(f"data.{s}"), F.lit(k)).alias(f"{n}_{a}") for s, n in (("magnetometer", "magnetometer"), ("accelerometer", "accelerometer"), ("gyroscope", "gyro")) for k, a in enumerate("xyz")])


def read_text_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with every column as text; empty cells are empty texts."""
    df = spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks columns {lost}")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_samples(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV with a fixed schema, pruned to columns (name: type); cells that aren't numbers are null."""
    names = spark.read.option("header", True).csv(path).columns
    if lost := [c for c in columns if c not in names]:
        raise ValueError(f"{path} lacks columns {lost}")
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return raw.select(*[S.finite(F.col(c).try_cast(t)).alias(c) if t == "double" else F.col(c).try_cast(t).alias(c) for c, t in columns.items()])


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, length, modified, and the identity that a name starts with: pid and visit, its first two tokens."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    tokens = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), F.get(tokens, F.lit(0)).alias("pid"), F.get(tokens, F.lit(1)).alias("visit"))


def first_per_participant(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of the first file (by path) of each participant."""
    rows = spark.read.option("header", True).schema(schema).csv(glob).withColumn("path", F.col("_metadata.file_path"))
    rows = rows.withColumn("pid", F.get(F.split(F.element_at(F.split("path", "/"), -1), "_"), F.lit(0)))
    first = rows.groupBy("pid").agg(F.min("path").alias("path"))
    return rows.join(first, ["pid", "path"], "left_semi")


def write_contract(df: DataFrame, path: str, columns: list[str], decimals: dict[str, int] | None = None, overwrite: bool = False, partition: str | None = None, digits: tuple[str, ...] = ()) -> bool:
    """CSV in the contract's exact order; times as fixed decimals, or with 15 significant digits; flags are true and
    false. An output that is there stands unless overwritten; it is replaced when the new one is whole."""
    decimals = decimals or {}
    jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return False
    out = quality.exact_columns(df.select(*columns), columns).select(*[F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if c in decimals else S.fifteen_digits(F.col(c)).alias(c) if c in digits else F.col(c) for c in columns])
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    writer = out.write.option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(new)
    replaced(df.sparkSession, new, path)
    return True


def replaced(spark: SparkSession, new: str, path: str) -> None:
    """Puts a folder that is written in the place of another: the old one is set aside by its name, and is put back if
    the new one can't take its place, so that at every moment one of them is there whole."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(at(new), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"{new} can't take the place of {path}")
    if there:
        fs.delete(at(old), True)


def cached(spark: SparkSession, path: str, fingerprint: str, build) -> DataFrame:
    """A result table kept under path while its inputs' fingerprint stays the same."""
    at = f"{path}/{fingerprint}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
