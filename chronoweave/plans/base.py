"""What the queries share: the tables read as recordings, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: events as samples: a recording per user, a time in seconds, a value that is missing in every seventh row, a label;
#: and the same as a common table expression of the oracle.
SAMPLES = """samples AS (
    SELECT user_id AS rec, event_id AS seq, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
           event_type AS label, event_id % 5 AS module FROM events)"""
MODULES = list(range(10))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select(
        F.col("user_id").alias("rec"), F.col("event_id").alias("seq"), t.alias("t"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.col("event_type").alias("label"), (F.col("event_id") % 5).alias("module"),
    )


def r(x, digits: int = 6):
    return F.round(x, digits)
