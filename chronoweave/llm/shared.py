"""Shared folder, materialised intermediates and small numeric helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word: a run of characters other than ASCII white space.
BLANKS = " \t\n\x0b\f\r"

#: Spark's setting that removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback: dict[str, str] = {}
_roots: list[str] = []  # folders of this process's scratch tables, oldest first


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
    return _fallback[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; each can be dropped when no later step reads it."""

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.count = 0
        _roots.append(self.root)

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """df, written and read again. The shuffles of the query that wrote it are removed with it: nothing reads them."""
        path = self.path(tag)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table._scratch_path)


def mark() -> int:
    return len(_roots)


def sweep(spark: SparkSession, since: int) -> None:
    """Removes the scratch tables begun since a mark; for when what was made from them has been written."""
    while len(_roots) > since:
        remove(spark, _roots.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words(text):
    """Column: the words of a text, in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_words(text):
    """Column: how many words a text has, without building the array: word starts are counted."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    squeezed = F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " ")
    return F.when(bare == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def unit(column):
    """Column: a number in (0, 1) that depends on the value alone (52 bits of its MD5)."""
    return (F.conv(F.substring(F.md5(column.cast("string")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
