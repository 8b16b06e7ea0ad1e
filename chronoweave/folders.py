"""Where an operator that writes files puts them when its caller names no place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own for each call, under spark.checkpoint.dir, which driver and executors share. Where that is
    unset, on one machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
