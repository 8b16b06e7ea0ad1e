"""Job: the quality of every recording, day by day, and its unbroken stretches.

    python -m jobs.recording_quality --config jobs/recording_quality.json --input EVENTS --output OUT

EVENTS is Parquet with event_id, ts, user_id, value: a row a sample, a recording a user. OUT/days has a row for each day
and recording: counts of samples and of faults, robust centre and spread, what share of the day's span its stretches
cover, a status and its reasons. OUT/stretches has the stretches: a missing value or too long a step parts them. Both
are Parquet, partitioned by day. A run replaces the days from from_day to to_day that have samples, all if neither is
given, and leaves others alone, so a day whose samples came late is simply done again.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chronoweave.folders import new_folder  # noqa: E402
from chronoweave.functions import scalars as S  # noqa: E402
from chronoweave.operators import quality, robust, runs  # noqa: E402
from jobs.common import command_line, config, log  # noqa: E402

KEYS = ["day", "rec"]
DAYS = "rec long, n long, missing long, invalid long, backward long, repeated long, longest_step double, median double, scale double, outliers long, stretches long, covered double, status string, reasons string, day date"
STRETCHES = "rec long, segment long, start double, end double, n long, day date"


def samples(events: DataFrame, options: dict) -> DataFrame:
    """day, rec, seq, t (seconds), value: null where it is missing or invalid. Rows without a time have no day and are
    left out; a null recording is one like any other."""
    low, high = options["valid"]
    rows, kind = events.where("ts IS NOT NULL"), dict(events.dtypes)["ts"]
    if first := options.get("from_day"):
        rows = rows.where(F.col("ts") >= F.lit(first).cast("date").cast(kind))
    if last := options.get("to_day"):
        rows = rows.where(F.col("ts") < F.date_add(F.lit(last).cast("date"), 1).cast(kind))
    value = S.finite(F.col("value"))
    return rows.select(
        F.to_date("ts").alias("day"), F.col("user_id").cast("long").alias("rec"), F.col("event_id").cast("long").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.when(value.between(low, high), value).alias("value"), (value.isNotNull() & ~value.between(low, high)).alias("invalid"),
    )


def stretches(rows: DataFrame, options: dict) -> DataFrame:
    return runs.segments(rows, KEYS, "t", "value", options["longest_step_s"], then=["seq"])


def days(rows: DataFrame, options: dict) -> DataFrame:
    """DAYS of samples. Groups are a recording's day; all facts of one are joined by it, null recordings too."""
    named = rows.withColumn("rec", F.struct("rec"))  # a struct is never null, so joins by it keep null recordings
    audit = quality.timestamp_audit(named, KEYS, "seq", "t").drop("missing")
    scale = robust.robust_scale(named, KEYS, "value").drop("mad")
    known = named.join(scale, KEYS)
    off = F.abs(F.col("value") - F.col("median")) > options["outlier_scales"] * F.col("scale")
    facts = known.groupBy(*KEYS).agg(F.count_if(F.col("value").isNull() & ~F.col("invalid")).alias("missing"), F.count_if("invalid").alias("invalid"), F.count("value").alias("_valid"), F.count_if(off & (F.col("scale") > 0)).alias("outliers"), (F.max("t") - F.min("t")).alias("_span"), F.first("median").alias("median"), F.first("scale").alias("scale"))
    whole = stretches(named, options).groupBy(*KEYS).agg(F.count("*").alias("stretches"), F.sum(F.col("end") - F.col("start")).alias("_covered"))
    d = audit.join(facts, KEYS).join(whole, KEYS, "left").withColumn("stretches", F.coalesce("stretches", F.lit(0)))
    few = F.col("_valid") < options["unusable_valid_rows"]
    gaps = (F.col("missing") + F.col("invalid")) > options["review_missing_share"] * F.col("n")
    order = (F.col("backward") > 0) | (F.col("repeated") > 0)
    status = S.cascade((few, "unusable"), (gaps | order, "review"), otherwise="usable")
    why = S.reasons(F.when(few, "too few valid samples"), F.when(gaps, "many samples missing or invalid"), F.when(F.col("backward") > 0, "times go back"), F.when(F.col("repeated") > 0, "times repeat"))
    covered = F.when(F.col("_span") > 0, F.coalesce("_covered", F.lit(0.0)) / F.col("_span")).otherwise(F.lit(0.0))
    return d.select(
        F.col("rec.rec").alias("rec"), "n", "missing", "invalid", "backward", "repeated", F.round("longest_step", 6).alias("longest_step"), F.round("median", 6).alias("median"),
        F.round("scale", 6).alias("scale"), "outliers", "stretches", F.round(covered, 6).alias("covered"), status.alias("status"), why.alias("reasons"), "day",
    )


def run(spark: SparkSession, source: str, output: str, options: dict) -> dict:
    """Writes both tables, only their days being replaced, and tells what was read and written."""
    rows = samples(spark.read.parquet(source), options)
    save = lambda df, name: df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/{name}")
    told, part = days(rows, options), lambda r: stretches(r, options).select("rec", "segment", "start", "end", "n", "day")
    if rows.isEmpty():  # plans of empty tables observe nothing
        done = {"read": 0, "rows": 0, "usable": 0}
        save(told, "days")
        save(part(rows), "stretches")
    else:
        seen, made = Observation("read"), Observation("written")
        save(told.observe(made, F.count("*").alias("rows"), F.count_if(F.col("status") == "usable").alias("usable")), "days")
        save(part(rows.observe(seen, F.count("*").alias("rows"))), "stretches")
        done = {"read": seen.get["rows"], "rows": made.get["rows"], "usable": made.get["usable"]}
    log.info("read %d samples of %s; wrote %d days of recordings to %s, %d of them usable", done["read"], source, done["rows"], output, done["usable"])
    return done


def read(spark: SparkSession, output: str, name: str = "days") -> DataFrame:
    return spark.read.schema({"days": DAYS, "stretches": STRETCHES}[name]).parquet(f"{output}/{name}")


def job2_recording_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days, as text, after two runs into one folder: the second replaces every day by the same."""
    folder = new_folder(spark, "recording-quality")
    options = config(spark, CONFIG)
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", folder, options)
    return read(spark, folder).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


CONFIG = str(Path(__file__).with_suffix(".json"))


def oracle() -> str:
    import json

    o = json.loads(Path(CONFIG).read_text(encoding="utf-8"))
    low, high = o["valid"]
    return f"""WITH s AS MATERIALIZED (
      SELECT CAST(ts AS DATE) AS day, user_id AS rec, event_id AS seq, epoch_us(ts) / 1e6 AS t, CASE WHEN value BETWEEN {low} AND {high} THEN value END AS value,
             coalesce(isfinite(value) AND NOT value BETWEEN {low} AND {high}, false) AS invalid FROM events WHERE ts IS NOT NULL),
    steps AS (SELECT *, t - last_value(t IGNORE NULLS) OVER (PARTITION BY day, rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM s),
    audit AS (SELECT day, rec, count(*) AS n, count(*) FILTER (d < 0) AS backward, count(*) FILTER (d = 0) AS repeated, max(d) AS longest_step, max(t) - min(t) AS span,
                     count(*) FILTER (value IS NULL AND NOT invalid) AS missing, count(*) FILTER (invalid) AS invalid, count(value) AS valid FROM steps GROUP BY day, rec),
    centre AS (SELECT day, rec, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS sd FROM s GROUP BY day, rec),
    away AS (SELECT s.day, s.rec, quantile_cont(abs(value - median), 0.5) AS mad FROM s JOIN centre c ON s.day = c.day AND s.rec IS NOT DISTINCT FROM c.rec GROUP BY s.day, s.rec),
    scales AS MATERIALIZED (SELECT c.day, c.rec, median, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END AS scale FROM centre c JOIN away a ON a.day = c.day AND a.rec IS NOT DISTINCT FROM c.rec),
    outs AS (SELECT s.day, s.rec, count(*) FILTER (scale > 0 AND abs(value - median) > {o["outlier_scales"]} * scale) AS outliers FROM s JOIN scales c ON s.day = c.day AND s.rec IS NOT DISTINCT FROM c.rec GROUP BY s.day, s.rec),
    cuts AS (SELECT *, value IS NULL OR coalesce(lag(value IS NULL) OVER w, true) OR coalesce(t - lag(t) OVER w > {o["longest_step_s"]}, false) AS cut FROM s WINDOW w AS (PARTITION BY day, rec ORDER BY t, seq)),
    parts AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY day, rec ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS segment FROM cuts),
    stretch AS (SELECT day, rec, segment, max(t) - min(t) AS long FROM parts WHERE value IS NOT NULL GROUP BY day, rec, segment),
    whole AS (SELECT day, rec, count(*) AS stretches, sum(long) AS covered FROM stretch GROUP BY day, rec)
    SELECT a.rec, n, missing, invalid, backward, repeated, round(longest_step, 6) AS longest_step, round(median, 6) AS median, round(scale, 6) AS scale, outliers,
           coalesce(stretches, 0) AS stretches, round(CASE WHEN span > 0 THEN coalesce(covered, 0) / span ELSE 0 END, 6) AS covered,
           CASE WHEN valid < {o["unusable_valid_rows"]} THEN 'unusable' WHEN missing + invalid > {o["review_missing_share"]} * n OR backward > 0 OR repeated > 0 THEN 'review' ELSE 'usable' END AS status,
           array_to_string(list_filter([CASE WHEN valid < {o["unusable_valid_rows"]} THEN 'too few valid samples' END, CASE WHEN missing + invalid > {o["review_missing_share"]} * n THEN 'many samples missing or invalid' END,
             CASE WHEN backward > 0 THEN 'times go back' END, CASE WHEN repeated > 0 THEN 'times repeat' END], lambda x: x IS NOT NULL), '; ') AS reasons, strftime(a.day, '%Y-%m-%d') AS day
    FROM audit a JOIN scales c ON a.day = c.day AND a.rec IS NOT DISTINCT FROM c.rec JOIN outs u ON u.day = a.day AND u.rec IS NOT DISTINCT FROM a.rec
    LEFT JOIN whole w ON w.day = a.day AND w.rec IS NOT DISTINCT FROM a.rec"""


def main() -> None:
    args = command_line(__doc__.split("\n")[0], config="JSON file of options", input="events", output="where the tables are")
    spark = SparkSession.builder.appName("recording-quality").getOrCreate()
    try:
        run(spark, args.input, args.output, config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
