"""XDF, the multi-stream recording container: a chunk reader and writer, a Spark data source, and a merge of containers.

A file is the magic "XDF:" and chunks: a length (one byte that says how wide, then the value), a two-byte tag and the
content. Tags: file header 1, stream header 2, samples 3, clock offset 4, boundary 5, stream footer 6.
"""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC, FILE_HEADER, STREAM_HEADER, SAMPLES, CLOCK, BOUNDARY, FOOTER = b"XDF:", 1, 2, 3, 4, 5, 6
DTYPES = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8"}


def encode_length(n: int) -> bytes:
    for width, code in ((1, "<B"), (4, "<I"), (8, "<Q")):
        if n < 1 << (8 * width):
            return bytes([width]) + struct.pack(code, n)
    raise ValueError(n)


def _length(file) -> int | None:
    width = file.read(1)
    if not width:
        return None
    raw = file.read(width[0])
    if width[0] not in (1, 4, 8) or len(raw) != width[0]:
        raise ValueError("broken length")
    return int.from_bytes(raw, "little")


def chunk(tag: int, content: bytes) -> bytes:
    return encode_length(len(content) + 2) + struct.pack("<H", tag) + content


def chunks(file, metadata_only: bool = False) -> Iterator[tuple[int, int | None, bytes]]:
    """tag, stream id (where the chunk has one) and content; sample chunks are skipped over for metadata alone."""
    if file.read(4) != MAGIC:
        raise ValueError("no XDF file")
    while (n := _length(file)) is not None:
        head = file.read(2)
        if len(head) != 2 or n < 2:
            raise ValueError("the file ends inside a chunk")
        tag = struct.unpack("<H", head)[0]
        if metadata_only and tag in (SAMPLES, CLOCK, BOUNDARY):
            file.seek(n - 2, io.SEEK_CUR)
            continue
        content = file.read(n - 2)
        if len(content) != n - 2:
            raise ValueError("the file ends inside a chunk")
        yield (tag, struct.unpack_from("<I", content)[0], content[4:]) if tag in (STREAM_HEADER, SAMPLES, CLOCK, FOOTER) else (tag, None, content)


def parse_header(xml: bytes) -> dict:
    root = ET.fromstring(xml)
    text = lambda name, default="": root.findtext(name) or default
    labels = [c.findtext("label") or "" for c in root.iterfind("./desc/channels/channel")]
    return {"name": text("name"), "type": text("type"), "channels": int(text("channel_count", "0")), "format": text("channel_format"), "rate": float(text("nominal_srate", "0")), "labels": labels, "created": text("created_at")}


def stream_header(name: str, labels: list[str], text: bool = False, rate: float = 0.0, kind: str = "") -> bytes:
    rows = "".join(f"<channel><label>{escape(c)}</label></channel>" for c in labels)
    return f'<?xml version="1.0"?><info><name>{escape(name)}</name><type>{escape(kind)}</type><channel_count>{len(labels)}</channel_count><nominal_srate>{rate:g}</nominal_srate><channel_format>{"string" if text else "double64"}</channel_format><desc><channels>{rows}</channels></desc></info>'.encode()


def encode_samples(times, values, text: bool = False) -> bytes:
    """Every sample with its own timestamp."""
    parts = [encode_length(len(times))]
    for t, row in zip(times, values, strict=True):
        parts.append(b"\x08" + struct.pack("<d", t))
        if text:
            for v in row:
                raw = v.encode()
                parts += [encode_length(len(raw)), raw]
        else:
            parts.append(np.asarray(row, dtype="<f8").tobytes())
    return b"".join(parts)


def decode_samples(content: bytes, header: dict, last: float | None) -> tuple[list[float], list]:
    """Times and rows of a chunk; a sample without a time follows the one before by the nominal rate."""
    file = io.BytesIO(content)
    times, rows = [], []
    for _ in range(_length(file) or 0):
        if file.read(1) == b"\x08":
            last = struct.unpack("<d", file.read(8))[0]
        else:
            if last is None:
                raise ValueError("the first sample has no time")
            last += 1 / header["rate"] if header["rate"] else 0.0
        times.append(last)
        if header["format"] == "string":
            rows.append([file.read(_length(file) or 0).decode("utf-8", "replace") for _ in range(header["channels"])])
        else:
            dtype = np.dtype(DTYPES[header["format"]])
            rows.append(np.frombuffer(file.read(dtype.itemsize * header["channels"]), dtype).astype(float).tolist())
    return times, rows


def read_streams(file, names: list[str] | None = None) -> dict[int, dict]:
    """Streams by id with header, clock offsets, times and rows; only those named are decoded."""
    out: dict[int, dict] = {}
    for tag, sid, content in chunks(file):
        if tag == STREAM_HEADER:
            header = parse_header(content)
            if names is None or header["name"] in names:
                out[sid] = {"header": header, "clock": [], "times": [], "rows": []}
        elif sid in out:
            s = out[sid]
            if tag == SAMPLES:
                t, r = decode_samples(content, s["header"], s["times"][-1] if s["times"] else None)
                s["times"] += t
                s["rows"] += r
            elif tag == CLOCK:
                s["clock"].append(struct.unpack_from("<dd", content))
    return out


def pick(streams: dict[int, dict], name: str) -> dict | None:
    """Of streams of a name the longest."""
    found = [s for s in streams.values() if s["header"]["name"] == name]
    return max(found, key=lambda s: len(s["times"]), default=None)


def merge(source, sink, drop: set[str], tables: list[tuple[str, list[str], bool, Iterator[tuple[list, list]]]]) -> None:
    """Copies a container without the dropped streams and with tables (name, labels, text, batches of times and rows)
    as new streams; footers come last. Times of a table must not go back, also across batches."""
    sink.write(MAGIC)
    gone, footers, highest = set(), [], 0
    for tag, sid, content in chunks(source):
        if sid is not None:
            highest = max(highest, sid)
        if tag == STREAM_HEADER and parse_header(content)["name"] in drop:
            gone.add(sid)
        if sid in gone:
            continue
        raw = chunk(tag, content if sid is None else struct.pack("<I", sid) + content)
        footers.append(raw) if tag == FOOTER else sink.write(raw)
    for name, labels, text, batches in tables:
        highest += 1
        sid = struct.pack("<I", highest)
        sink.write(chunk(STREAM_HEADER, sid + stream_header(name, labels, text)))
        first = last = None
        n = 0
        for times, rows in batches:
            for t in times:
                if last is not None and t < last:
                    raise ValueError(f"{name}: times go back at {t}")
                first, last = t if first is None else first, t
            n += len(times)
            sink.write(chunk(SAMPLES, sid + encode_samples(times, rows, text)))
        footers.append(chunk(FOOTER, sid + f'<?xml version="1.0"?><info><first_timestamp>{first or 0}</first_timestamp><last_timestamp>{last or 0}</last_timestamp><sample_count>{n}</sample_count></info>'.encode()))
    for raw in footers:
        sink.write(raw)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.names = [n for n in options.get("streams", "").split(",") if n] or None

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        from . import stores, xdf_scan

        with stores.opened(partition.path) as file:
            places = xdf_scan.Places(file)
            splits, status = xdf_scan.file_index(places, None if self.names is None else set(self.names), 1 << 62)
            if status != "ready":
                raise ValueError(f"{partition.path}: {status}")
            for split in splits:
                for batch in xdf_scan.read_split(places, {"path": partition.path, **split}, None):
                    yield batch.drop_columns(["place", "rate"])


class XdfSource(DataSource):
    """spark.dataSource.register(XdfSource); spark.read.format("xdf").option("streams", "a,b").load("f.xdf"): a row per
    sample. Chunks of streams that aren't asked for are passed over; a file is a partition, of which a chunk is held at
    a time. xdf_scan reads a file in many tasks, and channels by name."""

    @classmethod
    def name(cls):
        return "xdf"

    def schema(self):
        return "path string, stream string, stream_id int, seq long, t double, labels array<string>, numbers array<double>, texts array<string>"

    def reader(self, schema):
        return _Reader(self.options)
