"""Containers as tables that many tasks read: an index of chunk heads, splits of it, and scans pruned to the streams and
channels that are asked for.

The index is one pass over the heads of a file's chunks, one task a file; contents are passed over. It cuts the file into
splits of about `split_bytes` wanted bytes, and knows for each split where every stream stands: its header, how many
samples come before, and the time they end with, so that a split is decoded by itself. A scan reads the splits of all
files in parallel, only the chunks of wanted streams, and holds one chunk at a time. Files that can't be read to their
end are rows with a status.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import stores, xdf
from .stores import opened

INDEX = "path string, split int, start long, end long, streams array<struct<id: int, header: binary, base: long, last: double>>, status string"
SAMPLES = "path string, stream string, stream_id int, seq long, place long, t double, rate double, labels array<string>, numbers array<double>, texts array<string>"
OFFSETS = "path string, stream string, stream_id int, seq long, place long, time double, value double"

#: Bytes read at a chunk: its length, tag, stream, and what comes first in it, up to a whole clock offset.
_HEAD = 48
_ROWS, _FILES = 8192, 256
#: Bytes up to which a file is read at once.
_SMALL = 1 << 16


class Places:
    """Reads of a file by place and length, and how many bytes they were. A small file is read at once: its chunk heads
    one by one would be as many reads."""

    def __init__(self, file):
        self.file, self.size, self.taken = file, file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2), 0
        self.whole = None
        if self.size <= _SMALL:
            self.whole = self.read(0, self.size)

    def read(self, at: int, n: int) -> bytes:
        if self.whole is not None:
            return self.whole[at : at + n]
        self.file.seek(at)
        raw = self.file.read(n)
        self.taken += len(raw)
        return raw


def heads(places: Places, start: int = 4, end: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """place, tag, where the content begins and ends, and its first bytes, of every chunk from `start` on. A file that
    ends inside a chunk raises EOFError after its last whole one."""
    at, end = start, places.size if end is None else end
    while at < end:
        raw = places.read(at, _HEAD)
        width = raw[0]
        if width not in (1, 4, 8) or len(raw) < width + 3:
            raise EOFError("broken length")
        n = int.from_bytes(raw[1 : 1 + width], "little")
        content, after = at + width + 3, at + width + 1 + n
        if n < 2 or after > places.size:
            raise EOFError("the file ends inside a chunk")
        yield at, struct.unpack_from("<H", raw, 1 + width)[0], content, after, raw[width + 3 :][: n - 2]
        at = after


def _count(first: bytes) -> tuple[int, bool, int]:
    """Of a sample chunk's first bytes: how many samples, whether the first has a time, and where samples begin."""
    width = first[4]
    n = int.from_bytes(first[5 : 5 + width], "little")
    return n, n > 0 and first[5 + width] == 8, 5 + width


def decoded(content: bytes, header: dict, last: float | None, keep: list[int] | None = None) -> tuple[np.ndarray, np.ndarray | list]:
    """Times (NaN where unknown) and values of a sample chunk without its stream id, pruned to the channels `keep`. A
    sample without a time follows the one before by the nominal rate."""
    n, _, at = _count(b"\0\0\0\0" + content[:10])
    at -= 4
    step, text, channels = 1 / header["rate"] if header["rate"] else 0.0, header["format"] == "string", header["channels"]
    if not text:
        kind = np.dtype(xdf.DTYPES[header["format"]])
        for flag, more in ((8, [("t", "<f8")]), (0, [])):  # all samples alike: one view of the bytes
            rows = np.dtype([("flag", "u1"), *more, ("v", kind, (channels,))])
            if len(content) - at == n * rows.itemsize:
                view = np.frombuffer(content, rows, n, at)
                if (view["flag"] == flag).all():
                    values = view["v"].astype(np.float64)
                    t = view["t"].copy() if more else (np.nan if last is None else last) + step * np.arange(1, n + 1)
                    return t, values if keep is None else values[:, keep]
    times, values, now = np.empty(n), [], np.nan if last is None else last
    for k in range(n):
        flag, at = content[at], at + 1
        if flag == 8:
            now, at = struct.unpack_from("<d", content, at)[0], at + 8
        else:
            now += step
        times[k] = now
        if text:
            row = []
            for _ in range(channels):
                width = content[at]
                size = int.from_bytes(content[at + 1 : at + 1 + width], "little")
                at += 1 + width
                row.append(content[at : at + size].decode("utf-8", "replace"))
                at += size
        else:
            row = np.frombuffer(content, kind, channels, at).astype(np.float64)
            at += channels * kind.itemsize
        values.append(row)
    if text:
        return times, values if keep is None else [[r[c] for c in keep] for r in values]
    whole = np.array(values).reshape(n, channels)
    return times, whole if keep is None else whole[:, keep]


class _Stream:
    """Where a stream stands in a pass over a file: `open` are its chunks since the last whose first sample has a time."""

    def __init__(self, header: bytes):
        self.raw, self.header = header, xdf.parse_header(header)
        self.seen, self.open = 0, []

    def end(self, places: Places) -> float | None:
        last = None
        for at, after in self.open:
            t, _ = decoded(places.read(at, after - at), self.header, last)
            last = float(t[-1]) if len(t) and t[-1] == t[-1] else last
        return last


def file_index(places: Places, wanted: set[str] | None, split_bytes: int) -> tuple[list[dict], str]:
    """The splits of a file, and what stands in the way of reading it to its end."""
    if places.read(0, 4) != xdf.MAGIC:
        return [], "no container"
    streams: dict[int, _Stream] = {}
    splits: list[dict] = []
    size, status, here = 0, "ready", set()
    try:
        for at, tag, content, after, first in heads(places):
            if tag == xdf.STREAM_HEADER:
                stream = _Stream(places.read(content + 4, after - content - 4))
                if wanted is None or stream.header["name"] in wanted:
                    sid = struct.unpack_from("<I", first)[0]
                    streams[sid] = stream
                    if splits:
                        here.add(sid)
                        splits[-1]["streams"].append({"id": sid, "header": stream.raw, "base": 0, "last": None})
            elif tag == xdf.SAMPLES and (sid := struct.unpack_from("<I", first)[0]) in streams:
                if not splits or size >= split_bytes:
                    splits.append({"split": len(splits), "start": at, "streams": [{"id": k, "header": s.raw, "base": s.seen, "last": None} for k, s in streams.items()]})
                    size, here = 0, set()
                stream, (n, timed, _) = streams[sid], _count(first)
                if sid not in here and not timed and stream.seen:
                    next(s for s in splits[-1]["streams"] if s["id"] == sid)["last"] = stream.end(places)
                here.add(sid)
                if timed:
                    stream.open = []
                stream.open.append((content + 4, after))
                stream.seen += n
                size += after - at
                splits[-1]["end"] = after
    except EOFError as e:
        status = str(e)
    return splits, status


def _index_of(wanted, split_bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            try:
                with opened(path) as file:
                    splits, status = file_index(Places(file), wanted, split_bytes)
            except (OSError, pa.ArrowException) as e:
                splits, status = [], f"unreadable: {type(e).__name__}"
            rows += [{"path": path, **s, "status": status} for s in splits] or [{"path": path, "split": None, "start": None, "end": None, "streams": [], "status": status}]
            if len(rows) >= _FILES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_INDEX)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_INDEX)

    return run


_ARROW_INDEX = pa.schema([
    ("path", pa.string()), ("split", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
    ("streams", pa.list_(pa.struct([("id", pa.int32()), ("header", pa.binary()), ("base", pa.int64()), ("last", pa.float64())]))), ("status", pa.string()),
])


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that each stand for much work, dealt to as many tasks as the session has room for; left to itself, Spark
    would see a few bytes and put them into one."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *by)


def index(files: DataFrame, streams: list[str] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """INDEX of files (path): a row for each split, or one without a split for a file that has no wanted sample."""
    ship(files.sparkSession)
    spread = _dealt(files.select("path").where("path IS NOT NULL").distinct(), "path")
    return spread.mapInArrow(_index_of(None if streams is None else set(streams), split_bytes), INDEX)


def _scanned(requested: dict[str, list[str] | None] | None):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for split in batch.to_pylist():
                with opened(split["path"]) as file:
                    yield from _pieces(Places(file), split, requested)

    return lambda batches: _batches(pieces(batches))


_ARROW_SAMPLES = pa.schema([
    ("path", pa.string()), ("stream", pa.string()), ("stream_id", pa.int32()), ("seq", pa.int64()), ("place", pa.int64()), ("t", pa.float64()),
    ("rate", pa.float64()), ("labels", pa.list_(pa.string())), ("numbers", pa.list_(pa.float64())), ("texts", pa.list_(pa.string())),
])


def _pieces(places: Places, split: dict, requested: dict[str, list[str] | None] | None) -> Iterator[tuple]:
    """What a batch is made of, of the chunks between a split's ends: path, stream, stream_id, rate, labels, whether it is
    text, seq of the first sample, place, times and values of at most _ROWS samples of a chunk."""
    at: dict[int, list] = {}
    for s in split["streams"]:
        header = xdf.parse_header(s["header"])
        labels = header["labels"] or [str(k) for k in range(header["channels"])]
        asked = None if requested is None else requested[header["name"]]
        keep = None if asked is None else [labels.index(c) for c in asked if c in labels]
        at[s["id"]] = [header, labels if keep is None else [labels[k] for k in keep], keep, s["base"], s["last"]]
    for place, tag, content, after, first in heads(places, split["start"], split["end"]):
        sid = struct.unpack_from("<I", first)[0] if tag == xdf.SAMPLES else None
        if sid not in at:
            continue
        header, labels, keep, base, last = at[sid]
        t, values = decoded(places.read(content + 4, after - content - 4), header, last, keep)
        at[sid][3:] = base + len(t), float(t[-1]) if len(t) and t[-1] == t[-1] else last
        for k in range(0, len(t), _ROWS):
            yield split["path"], header["name"], sid, header["rate"], labels, header["format"] == "string", base + k, place, t[k : k + _ROWS], values[k : k + _ROWS]


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    """A batch of pieces that are all text or all numbers."""
    paths, names, ids, rates, labels, texts, bases, at, times, values = zip(*pieces, strict=True)
    n = [len(t) for t in times]
    each = lambda x, kind: pa.array([v for v, k in zip(x, n, strict=True) for _ in range(k)], kind)
    t = np.concatenate(times)
    sizes = np.concatenate([[0], np.cumsum(np.repeat([len(x) for x in labels], n))]).astype(np.int32)
    named = pa.ListArray.from_arrays(pa.array(sizes), pa.array([c for x, k in zip(labels, n, strict=True) for c in x * k], pa.string()))
    none = pa.nulls(len(t))
    if texts[0]:
        numbers, told = none.cast(pa.list_(pa.float64())), pa.array([row for part in values for row in part], pa.list_(pa.string()))
    else:
        numbers, told = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([part.reshape(-1) for part in values]), pa.float64())), none.cast(pa.list_(pa.string()))
    seq = np.concatenate([np.arange(b, b + k, dtype=np.int64) for b, k in zip(bases, n, strict=True)])
    return pa.RecordBatch.from_arrays([each(paths, pa.string()), each(names, pa.string()), each(ids, pa.int32()), pa.array(seq), each(at, pa.int64()), pa.array(t, pa.float64(), mask=np.isnan(t)), each(rates, pa.float64()), named, numbers, told], schema=_ARROW_SAMPLES)


def _batches(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Small pieces put together, as recorders write a chunk every few samples: a batch costs Spark as much for one row as
    for hundreds. At most twice _ROWS rows are held."""
    held, rows = [], 0
    for piece in pieces:
        if held and (rows >= _ROWS or held[0][5] != piece[5]):
            yield _batch(held)
            held, rows = [], 0
        held.append(piece)
        rows += len(piece[8])
    if held:
        yield _batch(held)


def read_split(places: Places, split: dict, requested: dict[str, list[str] | None] | None) -> Iterator[pa.RecordBatch]:
    """Batches of the samples between a split's ends."""
    return _batches(_pieces(places, split, requested))


def scan(indexed: DataFrame, requested: dict[str, list[str] | None] | None = None) -> DataFrame:
    """SAMPLES of an index's splits, a task's work being whole splits. requested: for each stream its channels, None
    for all; channels that a stream lacks are left out (`stream_status` tells which)."""
    splits = _dealt(indexed.where("split IS NOT NULL").select("path", "start", "end", "streams"), "path", "start")
    return splits.mapInArrow(_scanned(requested), SAMPLES)


def stream_status(indexed: DataFrame, requested: dict[str, list[str] | None]) -> DataFrame:
    """path, stream, ids, missing (channels), status of every requested stream of every file: ready, what the index says
    of a broken file, missing stream, several streams or missing channels."""
    spark = indexed.sparkSession
    wanted = spark.createDataFrame([(k, list(v or [])) for k, v in requested.items()], "stream string, channels array<string>")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, h["name"], i, h["labels"] or [str(k) for k in range(h["channels"])]) for p, i, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "id", "header")), strict=True) for h in [xdf.parse_header(raw)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], ["path", "stream", "id", "labels"])

    there = indexed.select("path", F.explode("streams").alias("s")).select("path", "s.id", "s.header").distinct().mapInArrow(named, "path string, stream string, id int, labels array<string>")
    ids = there.groupBy("path", "stream").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.flatten(F.collect_list("labels")).alias("labels"))
    files = indexed.groupBy("path").agg(F.max("status").alias("_file")).join(wanted)
    j = files.join(ids, ["path", "stream"], "left")
    missing = F.array_except("channels", F.coalesce("labels", F.array().cast("array<string>")))
    status = F.when(F.col("_file") != "ready", F.col("_file")).when(F.col("ids").isNull(), "missing stream").when(F.size("ids") > 1, "several streams").when(F.size(missing) > 0, "missing channels").otherwise("ready")
    return j.select("path", "stream", "ids", missing.alias("missing"), status.alias("status"))


def _offsets_of(path: str, wanted: set[str] | None) -> list[tuple]:
    rows, names, seen = [], {}, {}
    try:
        with opened(path) as file:
            places = Places(file)
            if places.read(0, 4) != xdf.MAGIC:
                return []
            for at, tag, content, after, first in heads(places):
                if tag == xdf.STREAM_HEADER:
                    header = xdf.parse_header(places.read(content + 4, after - content - 4))
                    if wanted is None or header["name"] in wanted:
                        names[struct.unpack_from("<I", first)[0]] = header["name"]
                elif tag == xdf.CLOCK and (sid := struct.unpack_from("<I", first)[0]) in names:
                    seen[sid] = seen.get(sid, -1) + 1
                    rows.append((path, names[sid], sid, seen[sid], at, *struct.unpack_from("<dd", first, 4)))
    except (EOFError, OSError, pa.ArrowException):
        pass  # the index tells of broken files; offsets before the break count
    return rows


def _clock(wanted):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW_OFFSETS, strict=True)], schema=_ARROW_OFFSETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            rows += _offsets_of(path, wanted)
            if len(rows) >= _ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return run


_ARROW_OFFSETS = pa.schema([("path", pa.string()), ("stream", pa.string()), ("stream_id", pa.int32()), ("seq", pa.int64()), ("place", pa.int64()), ("time", pa.float64()), ("value", pa.float64())])


def clock_offsets(files: DataFrame, streams: list[str] | None = None) -> DataFrame:
    """OFFSETS of files (path): each measurement of a stream's clock, the time it was made (by that clock) and what is
    to be added. Only chunk heads are read."""
    ship(files.sparkSession)
    spread = _dealt(files.select("path").where("path IS NOT NULL").distinct(), "path")
    return spread.mapInArrow(_clock(None if streams is None else set(streams)), OFFSETS)


def _dated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .rewriting import header_date

    for batch in batches:
        dates = []
        for path in batch.column("path").to_pylist():
            try:
                with opened(path) as file:
                    dates.append(header_date(file))
            except (ValueError, OSError, pa.ArrowException):
                dates.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(dates, pa.string())], ["path", "created"])


def header_dates(files: DataFrame) -> DataFrame:
    """path, created: the date in each container's file header, null where there is none or no container."""
    ship(files.sparkSession)
    return _dealt(files.select("path").where("path IS NOT NULL").distinct(), "path").mapInArrow(_dated, "path string, created string")


def _samples_of(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Times and values of each chunk of a column of (t, values) arrays, as views of its numbers."""
    each, flat = column.offsets.to_numpy(), column.values
    times, rows = flat.field("t").cast(pa.float64()), flat.field("values")
    if times.null_count:
        raise ValueError("a sample has no time")
    times, ends, values = times.to_numpy(), rows.offsets.to_numpy(), rows.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for a, b in zip(each[:-1].tolist(), each[1:].tolist(), strict=True):
        yield times[a:b], [values[ends[k] : ends[k + 1]] for k in range(a, b)]


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = stores.at(folder)
        now = out = None
        ids: dict[str, int] = {}
        held = bytearray()  # a write for each of many small chunks would be as many calls of the store

        def put(raw: bytes, most: int = 1 << 20):
            held.extend(raw)
            if len(held) > most:
                out[0].write(bytes(held))
                held.clear()

        def done():
            put(b"", 0)
            out[0].close()
            fs.move(out[1], f"{root}/{now}.xdf")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{now}.xdf"]), pa.array([len(ids)])], ["path", "streams"])

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("file", "created", "stream", "labels", "rate", "offset")]
            for file, created, stream, labels, rate, offset, (times, values) in zip(*plain, _samples_of(batch.column("samples")), strict=True):
                if file != now:
                    if out:
                        yield done()
                    now, ids = file, {}
                    beneath, _, name = f"{root}/{now}".rpartition("/")
                    fs.create_dir(beneath, recursive=True)
                    part = f"{beneath}/.{name}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part), part
                    put(xdf.MAGIC + xdf.chunk(xdf.FILE_HEADER, f'<?xml version="1.0"?><info><version>1.0</version>{"<datetime>" + created + "</datetime>" if created else ""}</info>'.encode()))
                if stream not in ids:
                    ids[stream] = len(ids) + 1
                    put(xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", ids[stream]) + xdf.stream_header(stream, labels, rate=rate)))
                sid = struct.pack("<I", ids[stream])
                if offset is not None:
                    put(xdf.chunk(xdf.CLOCK, sid + struct.pack("<dd", offset["time"], offset["value"])))
                else:
                    put(xdf.chunk(xdf.SAMPLES, sid + xdf.encode_samples(times, values)))
        if out:
            yield done()

    return run


def write_containers(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunks (file, place, stream, labels, rate, samples: array of (t, values), offset: (time, value) or null, and
    created, the date in the file's header, if there is one) as one container for each file, in order of place. Gives path and number of streams of all, from a table beside them. A
    task streams its files' chunks; a file gets its name when it is whole, so a lost task leaves none half written."""
    ship(chunks.sparkSession)
    if "created" not in chunks.columns:
        chunks = chunks.withColumn("created", F.lit(None).cast("string"))
    spread = chunks.select("file", "created", "place", "stream", "labels", "rate", "samples", "offset").repartition("file").sortWithinPartitions("file", "place")
    table = f"{folder.rstrip('/')}-files"
    spread.mapInArrow(_written(folder), "path string, streams long").write.mode("overwrite").parquet(table)
    return chunks.sparkSession.read.parquet(table)
