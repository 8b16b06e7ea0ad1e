"""Job: new texts, ready for release. Identifiers of persons are replaced by pseudonyms, the same in every text and run,
and texts that hold credentials are kept apart from those that may be published.

    python -m jobs.release_texts --config jobs/release_texts.json --input DOCUMENTS --output OUT --checkpoint MARK

DOCUMENTS is a folder of Parquet files, or a pattern of files or folders, with doc_id, text, lang, source. Each run takes the files that no earlier run
with the same checkpoint took, and adds their rows to OUT as Parquet, partitioned by release (public or controlled) and
lang. A run that broke off is finished by the next; with nothing new, a run changes nothing. Files are taken for new by
their path: a file must not change once it is there.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chronoweave.folders import new_folder  # noqa: E402
from chronoweave.operators import anonymize  # noqa: E402
from jobs.common import command_line, config, log  # noqa: E402

INPUT = "doc_id long, text string, lang string, source string"
OUTPUT = "doc_id long, source string, text string, n_replaced long, kinds string, release string, lang string"
#: The language of texts that name none.
UNKNOWN = "und"


def released(docs: DataFrame, options: dict) -> DataFrame:
    """OUTPUT of every row of docs, also a stream. A null text is public and stays null; null and empty languages are
    UNKNOWN."""
    kinds = {name: (k["pattern"], k["loose"]) for name, k in options["kinds"].items()}
    text, found = anonymize.pseudonymised(F.col("text"), kinds, options["secret"])
    controlled = F.coalesce(F.col("text").rlike(options["controlled"]), F.lit(False))
    told = docs.select("doc_id", "source", text.alias("text"), found.alias("found"), F.when(controlled, "controlled").otherwise("public").alias("release"), F.coalesce(F.nullif("lang", F.lit("")), F.lit(UNKNOWN)).alias("lang"))
    names = F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",")
    return told.select("doc_id", "source", "text", F.size("found").cast("long").alias("n_replaced"), names.alias("kinds"), "release", "lang")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, options: dict) -> dict:
    """Takes what is new at source, waits until it is written, and tells what was read and written."""
    new = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", options.get("files_per_batch", 1000)).option("maxFileAge", "36500d").parquet(source)
    rows = released(new, options).observe("release", F.count("*").alias("rows"), F.count_if(F.col("release") == "controlled").alias("controlled"), F.coalesce(F.sum("n_replaced"), F.lit(0)).alias("replaced"))
    query = rows.writeStream.format("parquet").partitionBy("release", "lang").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = {"read": 0, "rows": 0, "controlled": 0, "replaced": 0}
    for p in query.recentProgress:
        seen = p.observedMetrics.get("release")
        done["read"] += p.numInputRows
        if seen and p.numInputRows:
            for k in ("rows", "controlled", "replaced"):
                done[k] += seen[k]
    log.info("read %d new rows of %s; wrote %d rows to %s, %d of them controlled, with %d identifiers replaced", done["read"], source, done["rows"], output, done["controlled"], done["replaced"])
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    """All that is released: the sink's own log says which files belong to it."""
    return spark.read.schema(OUTPUT).parquet(output)


def job1_release_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release of all documents after two runs into one folder: the second finds nothing new."""
    folder = new_folder(spark, "release-texts")
    options = config(spark, CONFIG)
    for _ in range(2):
        run(spark, f"{sf_dir}/document[s].parquet", f"{folder}/texts", f"{folder}/checkpoint", options)
    return read(spark, f"{folder}/texts")


CONFIG = str(Path(__file__).with_suffix(".json"))


def oracle() -> str:
    import json

    options = json.loads(Path(CONFIG).read_text(encoding="utf-8"))
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = {name: (k["pattern"], k["loose"]) for name, k in options["kinds"].items()}
    pattern = quote("|".join(f"(?:{p})" for p, _ in kinds.values()))
    kind = "CASE " + " ".join(f"WHEN regexp_full_match(m, {quote(p)}) THEN '{name}'" for name, (p, _) in kinds.items()) + " END"
    bare = "CASE " + " ".join(f"WHEN regexp_full_match(m, {quote(p)}) THEN translate(lower(m), {quote(loose)}, '')" for p, loose in kinds.values()) + " END"
    name = f"'<' || {kind} || ':' || substr(sha256({quote(options['secret'] + '|')} || {kind} || '|' || {bare}), 1, 16) || '>'"
    return f"""WITH found AS (
      SELECT *, regexp_extract_all(text, {pattern}) AS matches, string_split_regex(text, {pattern}) AS pieces FROM documents)
    SELECT doc_id, source,
           CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(list_zip(pieces, list_transform(matches, lambda m: {name})), lambda z: z[1] || coalesce(z[2], '')), '') END AS text,
           coalesce(len(matches), 0) AS n_replaced,
           coalesce(array_to_string(list_sort(list_distinct(list_transform(matches, lambda m: {kind}))), ','), '') AS kinds,
           CASE WHEN coalesce(regexp_matches(text, {quote(options['controlled'])}), false) THEN 'controlled' ELSE 'public' END AS release,
           coalesce(nullif(lang, ''), '{UNKNOWN}') AS lang
    FROM found"""


def main() -> None:
    args = command_line(__doc__.split("\n")[0], config="JSON file of options", input="documents", output="where the release is", checkpoint="the release's own checkpoint")
    spark = SparkSession.builder.appName("release-texts").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
