"""Streams whose rows come late, in any trigger: with a delay the result is the batch operator's."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import runs, trackers
from chronoweave.streaming import streams

SCHEMA = "rec long, ts timestamp, seq long, t double, closed boolean, opened boolean, candidate long, nominal long"
START = datetime.datetime(2024, 5, 1)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def rows_of(rng, recs=3, n=60):
    out = []
    for rec in range(recs):
        for k in range(n):
            flag = rng.random()
            out.append((rec, START + datetime.timedelta(seconds=10 * k), k, float(10 * k), flag < 0.2, flag > 0.8, None if rng.random() < 0.2 else 10 * k + rng.randrange(-30, 30), None if rng.random() < 0.2 else 10 * k))
    return out


def streamed(spark, tmp_path, batches, f, name):
    source = tmp_path / f"in-{name}"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        for file in source.glob("part-*"):  # the stream takes files in the order of their times
            file.rename(source / f"b-{k:03d}.parquet")
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = f(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"mark-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def dealt(rng, rows, jitter_s):
    """Rows in batches, up to so many seconds late, and a last row that lets the watermark pass all of them."""
    came = sorted(rows, key=lambda r: r[1].timestamp() + rng.random() * jitter_s)
    size = len(came) // 6
    end = (99, START + datetime.timedelta(days=1), 0, 0.0, False, False, 0, 0)
    return [came[k : k + size] for k in range(0, len(came), size)] + [[end]]


def test_late_rows_are_folded_in_order(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    rows = rows_of(rng)
    batch = spark.createDataFrame(rows, SCHEMA)
    batches = dealt(rng, rows, 100)
    assert any(b[-1][1] > c[0][1] for b, c in zip(batches, batches[1:], strict=False))
    got = streamed(spark, tmp_path, batches, lambda r: streams.repaired_times(r, "200 seconds"), "repair")
    want = trackers.monotonic_times(batch, ["rec"], "seq", "candidate", "nominal").collect()
    assert sorted((r["rec"], r["seq"], r["repaired"]) for r in got if r["rec"] < 9) == sorted((r["rec"], r["seq"], r["repaired"]) for r in want)
    got = streamed(spark, tmp_path, batches, lambda r: streams.hysteresis_events(r, "200 seconds", 3600), "events")
    events = runs.hysteresis(batch, ["rec"], ["seq"], "closed", "opened").where("event IS NOT NULL").groupBy("rec", "event").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max_by("opened", "seq").alias("complete")).collect()
    assert sorted((r["rec"], r["start"], r["end"], r["complete"]) for r in got) == sorted((r["rec"], r["start"], r["end"], r["complete"]) for r in events)
    got = streamed(spark, tmp_path, batches, lambda r: streams.order_checked(r, "200 seconds"), "checks")
    assert sum(r["n"] for r in got if r["rec"] < 9) == len(rows) and sum(r["wrong"] for r in got) == 0


def test_open_events_end_when_a_key_is_quiet(rocks, tmp_path):
    spark = rocks
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 0, 0.0, True, False, 0, 0), (1, at(5), 1, 5.0, False, False, 0, 0), (2, at(0), 0, 0.0, True, False, 0, 0), (2, at(40), 1, 40.0, False, True, 0, 0), (3, at(40), 0, 40.0, True, False, 0, 0)]
    later = [(4, at(200), 0, 0.0, False, False, 0, 0)]
    last = [(4, at(260), 1, 0.0, False, False, 0, 0)]
    got = streamed(spark, tmp_path, [rows, later, last], lambda r: streams.hysteresis_events(r, "10 seconds", 100), "quiet")
    assert sorted((r["rec"], r["start"], r["end"], r["complete"]) for r in got) == [(1, 0.0, 5.0, False), (2, 0.0, 40.0, True), (3, 40.0, 40.0, False)]


def test_nulls_without_a_delay(rocks, tmp_path):
    rows = [(1, None, None, None, None, None, None, None), (1, None, 0, 1.0, None, True, None, None), (1, None, 1, None, True, None, 5, None), (1, None, 2, 0.5, False, True, None, 3)]
    got = streamed(rocks, tmp_path, [rows], streams.repaired_times, "nulls")
    assert [(r["seq"], r["repaired"]) for r in sorted(got, key=lambda r: r["repaired"])] == [(None, 0), (0, 1), (1, 5), (2, 6)]
    assert [(r["start"], r["end"]) for r in streamed(rocks, tmp_path, [rows], streams.hysteresis_events, "nulls2")] == [(None, 0.5)]
