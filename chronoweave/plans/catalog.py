"""All queries of the engine with the SQL that defines their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_containers, queries_core, queries_pipelines, queries_rules, queries_time  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_time.module_dispersion(spark, sf_dir)
