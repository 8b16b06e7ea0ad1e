"""What the jobs share: their command line, configuration and log."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

log = logging.getLogger("chronoweave.jobs")


def config(spark: SparkSession, path: str) -> dict:
    """A small JSON file, read by Spark, as its path may be remote."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def command_line(what: str, **paths: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=what)
    for name, told in paths.items():
        parser.add_argument(f"--{name.replace('_', '-')}", required=True, help=told)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    return parser.parse_args()

