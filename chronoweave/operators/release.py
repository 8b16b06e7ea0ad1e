"""Releases of whole folders of recordings: plans of what becomes of every file, and their execution on the executors.

A plan is a table with a row for each file. It is carried out file by file: a file is written under another name, read
again, compared by its digest, and only then gets its own name. So a lost task leaves no half file, and a second run, or
one after a break, does what is left. Nothing passes through the driver."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources import rewriting, stores

# How a path names a participant's visit, which files are text, which videos, and labels of in-ear files.
IDENTITY = r"(?i)(T[0-9]{3})_(V[0-9]+)"
TEXTS = ("asc", "cfg", "csv", "num", "tsv", "txt")
VIDEOS = ("avi", "mkv", "mp4", "webm")
IN_EAR = ("eeg", "imu", "quality")
#: Fixed value: the second into which a record's earliest clock is moved.
ORIGIN = 946_684_800

RESULT = "source string, target string, action string, bytes long, digest string, status string"


def files_under(listing: DataFrame, root: str) -> DataFrame:
    """source, relative (path beneath root), size of a listing (path, length)."""
    bare = lambda x: F.regexp_replace(x, "^file:/+", "/")
    start = bare(F.lit(root.rstrip("/") + "/"))
    return listing.where(bare(F.col("path")).startswith(start)).select(F.col("path").alias("source"), F.substring(bare(F.col("path")), F.length(start) + 1, F.length("path")).alias("relative"), F.col("length").alias("size"))


def _shown(name: str) -> bool:
    """Whether Spark's readers see a file or folder of that name."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def _entries(fs, folder: str) -> list:
    from pyarrow.fs import FileSelector

    return [i for i in fs.get_file_info(FileSelector(folder)) if _shown(i.base_name)]


_ENTRIES = pa.schema([("relative", pa.string()), ("size", pa.int64())])


def found_under(spark: SparkSession, root: str) -> DataFrame:
    """source, relative, size of every file beneath a folder that Spark's readers would see, as `files_under` gives them
    of a listing. One task names what the folder holds itself, many list what is beneath each of that. So neither a
    task for each folder is needed nor a list of all files on the driver."""
    ship(spark)
    root = root.rstrip("/")

    def batch(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ENTRIES)], schema=_ENTRIES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if one.num_rows:
                fs, base = stores.at(root)
                rows = [(i.path[len(base) + 1 :], i.size if i.is_file else None) for i in _entries(fs, base)]
                yield from (batch(rows[k : k + 10_000]) for k in range(0, len(rows), 10_000))

    def beneath(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = stores.at(root)
        rows: list[tuple[str, int | None]] = []
        for at, size in (pair for b in batches for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if size is not None:
                rows.append((at, size))
                continue
            folders = [f"{base}/{at}"]
            while folders:
                for i in _entries(fs, folders.pop()):
                    if i.is_file:
                        rows.append((i.path[len(base) + 1 :], i.size))
                    else:
                        folders.append(i.path)
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    top = spark.range(0, 1, 1, 1).mapInArrow(first, "relative string, size long").repartition(n, "relative")
    return top.mapInArrow(beneath, "relative string, size long").select(F.concat(F.lit(f"{root}/"), "relative").alias("source"), "relative", "size")


def _suffix(name: Column) -> Column:
    """What follows a name's last point, in small letters; names that begin with their only point have none."""
    return F.lower(F.regexp_extract(name, r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1))


def _renamed(x: Column, pid: Column, visit: Column, new: Column) -> Column:
    """rewriting.renamed as a column; identities are letters, digits and underscores."""
    any_case = lambda p: F.concat(F.lit("(?i)"), p)
    out = F.regexp_replace(x, any_case(F.concat_ws("_", pid, visit)), F.concat(new, F.lit(f"_{rewriting.ANY_VISIT}")))
    out = F.regexp_replace(out, any_case(pid), new)
    return F.regexp_replace(out, F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), visit, F.lit("(?![A-Za-z0-9])")), F.lit(rewriting.ANY_VISIT))


def _label(modality: Column, name: Column, folder: Column) -> Column:
    low, ext = F.lower(modality), _suffix(name)
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    in_ear = F.coalesce(*[F.when(stem.rlike(f"(?<![a-z0-9]){k}(?![a-z0-9])"), F.lit(k)) for k in IN_EAR], F.when(ext == "pdf", "report").otherwise("idun"))
    et = F.when(folder, "et_raw").when(ext.isin(*VIDEOS), "eyeball_video").otherwise("et")
    return F.when(low == "driver video", "driver_video").when(low == "et", et).when(low == "idun", in_ear).otherwise(F.replace(low, F.lit(" "), F.lit("_")))


def anonymise_plan(files: DataFrame, ids: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """source, relative, target, action, pid, visit, new, status of files (files_under) whose path names a visit.

    ids: key (PID_VISIT in capitals) and random_id. The third part of a path gets a name made of the id, a label of its
    modality and, where a visit has several of a label (electrodes of the in-ear device: always), a number in order of
    the path whatever its case; further parts are renamed. status: ready; no id; excluded (key in `excluded`); or
    collision, where two files of the plan would get one name, whatever the case, or a file has a folder's name."""
    # the first participant's visit in the path counts
    key = F.upper(F.regexp_extract("relative", IDENTITY, 0))
    f = files.where(F.col("relative").rlike(IDENTITY)).withColumns({"pid": F.upper(F.regexp_extract("relative", IDENTITY, 1)), "visit": F.upper(F.regexp_extract("relative", IDENTITY, 2)), "key": key})
    f = f.join(ids.select("key", F.col("random_id").alias("new")), "key", "left")
    if excluded is not None:
        f = f.join(excluded.select("key", F.lit(True).alias("_out")).distinct(), "key", "left")
    else:
        f = f.withColumn("_out", F.lit(None).cast("boolean"))
    parts = F.split("relative", "/")
    f = f.withColumns({"_parts": parts, "_deep": F.size(parts) >= 3, "_folder": F.size(parts) > 3, "_root": F.array_join(F.slice(parts, 1, 3), "/")})
    name = F.get("_parts", F.lit(2))
    roots = f.where("_deep").groupBy("key", "_root").agg(F.first(F.get("_parts", F.lit(1))).alias("_modality"), F.max("_folder").alias("_folder"), F.first(name).alias("_name"))
    roots = roots.withColumn("_label", _label(F.col("_modality"), F.col("_name"), F.col("_folder")))
    place = F.row_number().over(Window.partitionBy("key", "_modality", "_label", "_folder").orderBy(F.lower("_root"), "_root"))
    always = (F.lower("_modality") == "idun") & (F.col("_label") == "eeg")
    number = F.when(always, place).otherwise(place - 1)
    ext = F.when(F.col("_folder"), "").otherwise(F.regexp_extract("_name", r"(?<=.)(\.[^.]*)$", 1))
    roots = roots.select("_root", F.concat(F.lit(f"_{rewriting.ANY_VISIT}_"), "_label", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), ext).alias("_end"))
    f = f.join(roots, "_root", "left")
    ren = lambda x: _renamed(x, F.col("pid"), F.col("visit"), F.col("new"))
    rest = F.transform(F.slice("_parts", 4, F.greatest(F.size("_parts") - 3, F.lit(0))), ren)
    deep = F.array_join(F.concat(F.array("new", F.get("_parts", F.lit(1)), F.concat("new", "_end")), rest), "/")
    flat = F.array_join(F.concat(F.array("new"), F.transform(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), ren)), "/")
    last = F.element_at("_parts", -1)
    ext = _suffix(last)
    title = (F.lower(F.get("_parts", F.lit(1))) == "et") & (F.lower(last) == "recording.g3")
    action = F.when(F.lower(last) == "participant", "participant").when(title, "title").when(ext.isin("g3", "json"), "json").when(ext.isin(*TEXTS), "text").otherwise("copy")
    f = f.select("source", "relative", F.when(F.col("new").isNotNull(), F.when(F.col("_deep"), deep).otherwise(flat)).alias("target"), action.alias("action"), "pid", "visit", "new", "_out")
    same = F.count("*").over(Window.partitionBy(F.lower("target")))
    folders = f.where("target IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/")) - 1), lambda k: F.lower(F.array_join(F.slice(F.split("target", "/"), 1, k), "/")))).alias("_low")).distinct().withColumn("_is_folder", F.lit(True))
    f = f.withColumn("_same", same).withColumn("_low", F.lower("target")).join(folders, "_low", "left")
    status = F.when(F.col("_out"), "excluded").when(F.col("new").isNull(), "no id").when((F.col("_same") > 1) | F.col("_is_folder"), "collision").otherwise("ready")
    return f.select("source", "relative", "target", "action", "pid", "visit", "new", status.alias("status"))


def _peeked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clocks, errors = [], []
        for source, kind in zip(batch.column("source").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            clock = error = None
            try:
                with stores.opened(source) as file:
                    if kind == "idun":
                        clock = rewriting.first_clock(io.BufferedReader(file))
                    elif kind == "lsl":
                        date = rewriting.header_date(file)
                        clock = None if date is None else rewriting.epoch(date)
                    elif kind == "silab":
                        clock = 1 if rewriting.column(next(rewriting.lines(io.BufferedReader(file)), (b"", b""))[0], rewriting.WALL_CLOCK) else None
            except (ArithmeticError, ValueError, IndexError, OSError, pa.ArrowException) as e:
                error = f"unreadable: {type(e).__name__}"
            clocks.append(None if clock is None else str(clock))
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(clocks, pa.string()), pa.array(errors, pa.string())], ["source", "clock", "error"])


def time_shift_plan(files: DataFrame) -> DataFrame:
    """source, relative, target, action, delta, status of files (files_under, below a folder for each record). A record's
    clocks are the first timestamps of its in-ear tables and the header dates of its containers; delta is the whole
    seconds that bring the earliest into ORIGIN's second. Actions: shift_table, copy (also of tables without a row),
    shift_container (simulator streams lose wall-clock channels), shift_json (creation date of eye-tracker recordings),
    drop_columns (wall clock of simulator logs). status: ready, or what can't be read; nothing of such a file's record
    is ready, as its clocks aren't known."""
    ship(files.sparkSession)
    parts = F.split("relative", "/")
    modality, last = F.lower(F.get(parts, F.lit(1))), F.element_at(parts, -1)
    kind = F.when((modality == "idun") & (_suffix(last) == "csv"), "idun").when((modality == "lsl") & (_suffix(last) == "xdf"), "lsl").when((modality == "silab") & (_suffix(last) == "asc"), "silab").when((modality == "et") & (F.lower(last) == "recording.g3"), "et")
    f = files.select("source", "relative", F.get(parts, F.lit(0)).alias("record"), kind.alias("kind"))
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    peeks = f.where("kind IN ('idun', 'lsl', 'silab')").select("source", "kind").repartition(n, "source").mapInArrow(_peeked, "source string, clock string, error string")
    f = f.join(peeks, "source", "left")
    clock = F.when(F.col("kind").isin("idun", "lsl"), F.col("clock").cast("decimal(28,9)"))
    w = Window.partitionBy("record")
    f = f.withColumn("delta", (F.lit(ORIGIN) - F.floor(F.min(clock).over(w))).cast("long")).withColumn("_broken", F.max("error").over(w))
    there = F.col("clock").isNotNull()
    action = F.when((F.col("kind") == "idun") & there, "shift_table").when((F.col("kind") == "lsl") & there, "shift_container").when((F.col("kind") == "et") & F.col("delta").isNotNull(), "shift_json").when((F.col("kind") == "silab") & there, "drop_columns").otherwise("copy")
    status = F.coalesce("error", F.when(F.col("_broken").isNotNull(), F.lit("another file of the record is unreadable")), F.lit("ready"))
    return f.select("source", "relative", F.col("relative").alias("target"), action.alias("action"), "delta", status.alias("status"))


def _rewritten(row: dict, source, write) -> None:
    who = row["pid"], row["visit"], row["new"]
    match row["action"]:
        case "participant":
            write(json.dumps({"name": row["new"]}, separators=(",", ":")).encode())
        case "title" | "json":
            rewriting.rename_json(source, write, *who, title=row["action"] == "title")
        case "text":
            rewriting.rename_text(source, write, *who)
        case "shift_table":
            rewriting.shift_table(source, write, row["delta"])
        case "shift_container":
            rewriting.shift_container(source, write, row["delta"])
        case "shift_json":
            rewriting.shift_json(source, write, row["delta"])
        case "drop_columns":
            rewriting.drop_columns(source, write)
        case "copy":
            rewriting.copy(source, write)
        case other:
            raise ValueError(f"no such action: {other}")


def carry_out(row: dict, root: str) -> tuple[int | None, str | None, str]:
    """One file of a plan: its size, digest and status (written, exists, or what went wrong, nothing being left)."""
    from pyarrow.fs import FileType

    fs, base = stores.at(root.rstrip("/"))
    at = f"{base}/{row['target']}"
    if fs.get_file_info(at).type == FileType.File:
        return None, None, "exists"
    folder, _, name = at.rpartition("/")
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    told, size = hashlib.md5(), 0
    try:
        fs.create_dir(folder, recursive=True)
        with stores.opened(row["source"]) as source, fs.open_output_stream(part) as out:

            def write(raw: bytes) -> None:
                nonlocal size
                size += len(raw)
                told.update(raw)
                out.write(raw)

            _rewritten(row, io.BufferedReader(source, 1 << 20), write)
        again = hashlib.md5()
        with fs.open_input_stream(part) as file:
            while block := file.read(1 << 20):
                again.update(block)
        if again.digest() != told.digest():
            raise OSError("what was read again differs")
        fs.move(part, at)
    except (ArithmeticError, ValueError, IndexError, KeyError, OSError, pa.ArrowException) as e:
        if fs.get_file_info(part).type == FileType.File:
            fs.delete_file(part)
        return None, None, f"failed: {type(e).__name__}: {e}"[:200]
    return size, told.hexdigest(), "written"


_ARROW_RESULT = pa.schema([("source", pa.string()), ("target", pa.string()), ("action", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("status", pa.string())])


def carried_out(plan: DataFrame, root: str) -> DataFrame:
    """Does what a plan's ready rows say, below root, and tells (RESULT) of every row of the plan: written; exists, a file
    of an earlier run, which is left alone; failed, with its reason; or the plan's own status. The work is done where the
    result is first used: write it to a table rather than use it twice."""
    spark = plan.sparkSession
    ship(spark)
    for name, kind in (("pid", "string"), ("visit", "string"), ("new", "string"), ("delta", "long")):
        if name not in plan.columns:
            plan = plan.withColumn(name, F.lit(None).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            done = [carry_out(r, root) if r["status"] == "ready" else (None, None, r["status"]) for r in rows]
            columns = [[r["source"] for r in rows], [r["target"] for r in rows], [r["action"] for r in rows], *zip(*done, strict=True)] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW_RESULT, strict=True)], schema=_ARROW_RESULT)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    spread = plan.select("source", "target", "action", "pid", "visit", "new", "delta", "status").repartition(n, "source")
    return spread.mapInArrow(run, RESULT)
