"""WARC records in ZIP archives: a writer, and a reader that range-reads records without extraction.

An archive has two stored members: data/records.warc.gz, each record a gzip member of its own, and
indexes/records.idx, one line per record with its offset, length and identity. The reader finds the end record (ZIP64 where sizes or offsets ask for it), the central directory,
the members' local headers and the index, then reads each record's bytes at its place in the archive file.

Files are read and written through pyarrow's file systems at URIs in the shared folder. A task writes under a name of
its own, and only archives that a finished task has reported count; a repeated task leaves a file that none reads.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Payloads from this size on are stored once; records of the same payload refer to the response.
REVISIT_BYTES = 1000
DATA, INDEX = "data/records.warc.gz", "indexes/records.idx"
#: Index lines that one reading task takes, about.
READ_LINES = 2000

# Fixed values of the ZIP format: signatures and layouts of its records.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class ZipWriter:
    """Members stored one after another into a stream; sizes are known when a member ends, and stand in the central
    directory and in a data descriptor. force64 writes ZIP64 fields whatever the sizes."""

    def __init__(self, stream, force64: bool = False):
        self.stream, self.at, self.members, self.force64 = stream, 0, [], force64

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc = name.encode(), self.at, 0
        # flag 8: sizes follow the data; the ZIP64 field makes them 8 bytes wide there
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, _FULL32, _FULL32, len(self.name), len(extra)) + self.name + extra)
        self.start = self.at

    def data(self, raw: bytes) -> int:
        """Where the bytes begin inside the member."""
        place = self.at - self.start
        self.crc = zlib.crc32(raw, self.crc)
        self.write(raw)
        return place

    def end(self) -> None:
        size = self.at - self.start
        self.write(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, size, size))
        self.members.append((self.name, self.header, size, self.crc))

    def close(self) -> None:
        start = self.at
        for name, header, size, crc in self.members:
            wide = self.force64 or size >= _FULL32 or header >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header) if wide else b""
            short = _FULL32 if wide else size
            self.write(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, short, short, len(name), len(extra), 0, 0, 0, 0, _FULL32 if wide else header) + name + extra)
        size, n = self.at - start, len(self.members)
        if self.force64 or start >= _FULL32 or size >= _FULL32 or n >= _FULL16:
            where = self.at
            self.write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start) + _LOCATOR + struct.pack("<IQI", 0, where, 1))
            n, size, start = _FULL16, _FULL32, _FULL32
        self.write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def _at(file, place: int, size: int) -> bytes:
    file.seek(place)
    raw = file.read(size)
    if len(raw) != size:
        raise ValueError("the archive ends early")
    return raw


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name to (first byte of the data, bytes) of an archive's stored members."""
    tail = _at(file, max(0, size - 65557), min(size, 65557))
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory")
    n, directory, start = struct.unpack_from("<HII", tail, at + 10)
    place = size - len(tail) + at
    if n == _FULL16 or directory == _FULL32 or start == _FULL32:
        locator = _at(file, place - 20, 20)
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        n, directory, start = struct.unpack_from("<QQQ", end64, 32)
    raw, at, found = _at(file, start, directory), 0, {}
    for _ in range(n):
        if raw[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, name_len, extra_len, note_len, header = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20), *struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + name_len].decode()
        extra, k = raw[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                header = next(wide) if header == _FULL32 else header
            k += 4 + length
        if method == 0:
            local = _at(file, header, 30)
            if local[:4] != _LOCAL:
                raise ValueError("broken local header")
            found[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + name_len + extra_len + note_len
    return found


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, refers_url: str | None) -> bytes:
    """A WARC response, or a revisit, of which the HTTP headers alone are kept and tell the payload's size."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_EPOCH.isoformat().replace('+00:00', 'Z')}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Refers-To-Target-URI: {_line(refers_url)}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def packed(raw: bytes) -> bytes:
    """A gzip member."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), the HTTP headers' content length and the payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"headers": headers, "size": sizes[0], "payload": None if headers["warc-type"] == "revisit" else payload}


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        path = f"{root}/{uuid.uuid4().hex}.zip"
        fs, at = opened(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        lines: list[str] = []
        with fs.open_output_stream(at) as stream:
            out = ZipWriter(stream)
            out.begin(DATA)
            batch = first
            while batch is not None:
                for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    raw = packed(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers, None))
                    lines.append(f"{out.data(raw)} {len(raw)} {'' if page is None else page}\n")
                batch = next(batches, None)
            out.end()
            out.begin(INDEX)
            for k in range(0, len(lines), 10_000):
                out.data("".join(lines[k : k + 10_000]).encode())
            out.end()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)])], ["archive", "records"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, last in zip(*(batch.column(c).to_pylist() for c in ("archive", "first", "last")), strict=True):
            fs, at = opened(path)
            with fs.open_input_file(at) as file:
                places = members(file, file.size())
                (data, _), (index, size) = places[DATA], places[INDEX]
                lines = _at(file, index, size).decode().splitlines()[first:last]
                for k in range(0, len(lines), 200):
                    yield _rows([parse_record(zlib.decompress(_at(file, data + int(x[0]), int(x[1])), 31)) for x in (line.split(" ") for line in lines[k : k + 200])])


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def _rows(records: list[dict]) -> pa.RecordBatch:
    rows = []
    for r in records:
        h, payload = r["headers"], r["payload"]
        if payload is not None and (len(payload) != r["size"] or "sha1:" + hashlib.sha1(payload).hexdigest() != h["warc-payload-digest"]):
            raise ValueError(f"{h['warc-record-id']}: the payload is not what its digest says")
        rows.append((_page(h["warc-record-id"]), h["warc-target-uri"], payload, r["size"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page(h.get("warc-refers-to"))))
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def write_archives(pages: DataFrame, root: str, scratch: Scratch | None = None) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under root; returns archive, records.

    Of rows with equal payloads of REVISIT_BYTES or more, the one with the largest page_id is the response and the
    others refer to it (rows that repeat that page_id are responses too; payloads none of whose rows have a page_id
    are all responses). A null html is an empty payload; an empty table writes nothing.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    large = narrow.select("page_id", F.unhex(F.sha1(html)).alias("digest"), F.length(html).alias("size")).where(F.col("size") >= REVISIT_BYTES).where("page_id IS NOT NULL")
    large = scratch.table(large.select("page_id", "digest"), "digests")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    again = large.join(shared, "digest").where("page_id <> response").select("page_id", "digest", "response").distinct()
    keyed = narrow.withColumn("digest", F.when(F.length(html) >= REVISIT_BYTES, F.unhex(F.sha1(html))))
    full = keyed.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", F.col("response").alias("refers_to"))
    return scratch.table(full.mapInArrow(_write(root), "archive string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record, range-read. Large
    archives are read by several tasks, each a range of the index."""
    n = F.greatest(F.ceil(F.col("records") / READ_LINES).cast("int"), F.lit(1))
    parts = archives.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).select("archive", (F.col("part") * READ_LINES).cast("long").alias("first"), ((F.col("part") + 1) * READ_LINES).cast("long").alias("last"))
    dealt = parts.repartition(max(8, archives.sparkSession.sparkContext.defaultParallelism * 2))
    return dealt.mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
