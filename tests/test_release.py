"""Releases of folders: names, clocks, bytes that must stay, collisions, broken files and second runs."""

import io
import json
import os
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import delimited
from chronoweave.operators import anonymize, release
from chronoweave.sources import rewriting, tables, xdf


def rewritten(f, raw: bytes, *args, **more) -> bytes:
    out = io.BytesIO()
    f(io.BytesIO(raw), out.write, *args, **more)
    return out.getvalue()


def brute_cells(line: str) -> list[str]:
    """Letter by letter: a quote toggles, two inside a quoted stretch are one."""
    out, cell, quoted, k = [], "", False, 0
    while k < len(line):
        c = line[k]
        if c == '"' and quoted and line[k + 1 : k + 2] == '"':
            cell, k = cell + '""', k + 2
            continue
        if c == '"':
            quoted = not quoted
        if c == "," and not quoted:
            out.append(cell)
            cell = ""
        else:
            cell += c
        k += 1
    return [*out, cell]


def test_cells_of_lines(spark):
    rng = random.Random(23)
    lines = ["", ",", '"', '""', 'a"b,c"d,e', '"a""b",c', '"open, to the end', *("".join(rng.choices('ab,,""é\r', k=rng.randrange(14))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    c = F.col("line")
    got = {r["k"]: r for r in df.select("k", *[delimited.cell(c, n).alias(f"c{n}") for n in range(3)], delimited.with_cell(c, 1, F.lit("NEW")).alias("put"), delimited.without_cells(c, [0, 2]).alias("less")).collect()}
    for k, line in enumerate(lines):
        cells = brute_cells(line)
        assert [line.encode()[a:b].decode() for a, b in rewriting.cells(line.encode())] == cells
        assert [got[k][f"c{n}"] for n in range(3)] == [cells[n] if n < len(cells) else None for n in range(3)], line
        assert got[k]["put"] == (",".join([cells[0], "NEW", *cells[2:]]) if len(cells) > 1 else line)
        assert got[k]["less"] == ",".join(x for n, x in enumerate(cells) if n not in (0, 2))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_tables_keep_their_bytes(end):
    rows = ['﻿id,"Timestamp ",note', '1,1700000000.1250,"a, ""b"""', "", "2,\"1700000001\",x'y", '3,-0.5,"open', "4,1700000002.00"]
    raw = end.join(rows).encode()  # no end after the last line
    want = ['﻿id,"Timestamp ",note', '1,1699999990.1250,"a, ""b"""', "", "2,\"1699999991\",x'y", '3,-10.5,"open', "4,1699999992.00"]
    assert rewritten(rewriting.shift_table, raw, -10) == end.join(want).encode()
    assert rewriting.first_clock(io.BytesIO(raw)) == Decimal("1700000000.1250") and rewriting.first_clock(io.BytesIO(rows[0].encode())) is None
    assert rewritten(rewriting.drop_columns, f'Date,v,"SystemTimeHHMM"{end}1,"2,3",4{end}5{end}\xff'.encode("latin-1")) == f'v{end}"2,3"{end}{end}'.encode()
    assert rewritten(rewriting.shift_table, b"a,b\n1,2\n", 5) == b"a,b\n1,2\n" and rewritten(rewriting.shift_table, b"", 5) == b""
    with pytest.raises(ArithmeticError):
        rewritten(rewriting.shift_table, b"timestamp\nnever\n", 5)


@pytest.mark.parametrize("text,seconds,want", [("2024-02-28T23:59:59.5Z", 1, "2024-02-29T00:00:00.5Z"), ("2024-01-01T00:00:00+0230", -1, "2023-12-31T23:59:59+0230"), ("2024-01-01T00:00:00.000001-05:00", 60, "2024-01-01T00:01:00.000001-05:00")])
def test_dates(text, seconds, want):
    assert rewriting.moved_date(text, seconds) == want and rewriting.epoch(want) - rewriting.epoch(text) == seconds
    with pytest.raises(ValueError):
        rewriting.epoch(text[:19])


def container(created="2024-03-01T10:00:00.75Z", kind="double64"):
    out = [xdf.MAGIC, b"\x04" + struct.pack("<IH", 2 + 60, 1) + f"<info><datetime>{created}</datetime></info>".ljust(60).encode()]  # a longer length than needed
    for sid, name, labels in ((1, "SiLab", ["Date", "speed", "systemUnixTimeSeconds", "gear"]), (2, "eye", ["Date", "x"])):
        out.append(xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", sid) + xdf.stream_header(name, labels).replace(b"double64", kind.encode())))
    code = {"double64": "<4d", "int16": "<4h"}[kind]
    rows = b"".join((b"\x08" + struct.pack("<d", k) if k % 2 == 0 else b"\0") + struct.pack(code, 1, k, 2, -k) for k in range(5))
    out.append(xdf.chunk(xdf.SAMPLES, struct.pack("<I", 1) + xdf.encode_length(5) + rows))
    out.append(b"\x08" + struct.pack("<QH", 2 + 20, xdf.CLOCK) + struct.pack("<Idd", 1, 1.0, 2.0))
    out.append(xdf.chunk(xdf.FOOTER, struct.pack("<I", 1) + b"<info/>"))
    return b"".join(out)


@pytest.mark.parametrize("kind", ["double64", "int16"])
def test_containers(kind):
    raw = container(kind=kind)
    got = rewritten(rewriting.shift_container, raw, 3600)
    assert b"<datetime>2024-03-01T11:00:00.75Z</datetime>" in got and rewriting.header_date(io.BytesIO(got)) == "2024-03-01T11:00:00.75Z"
    streams = xdf.read_streams(io.BytesIO(got))
    assert streams[1]["header"]["labels"] == ["speed", "gear"] and streams[1]["rows"] == [[float(k), float(-k)] for k in range(5)] and streams[1]["clock"] == [(1.0, 2.0)]
    assert streams[2]["header"]["labels"] == ["Date", "x"]
    assert got.endswith(raw[raw.index(b"\x08" + struct.pack("<QH", 22, xdf.CLOCK)) :])  # later chunks byte by byte
    for broken in (raw[:-3], b"other"):
        with pytest.raises(ValueError):
            rewritten(rewriting.shift_container, broken, 1)


def put(root, files):
    for name, raw in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(raw if isinstance(raw, bytes) else raw.encode())


def run(spark, tmp_path, plan, to):
    out = f"file://{tmp_path}/{to}-{random.random()}-done"
    release.carried_out(plan, f"file://{tmp_path}/{to}").write.parquet(out)
    return {r["source"].split("/src/")[-1].split("/named/")[-1]: r["status"] for r in spark.read.parquet(out).collect()}


def test_anonymised_folders(spark, tmp_path):
    src = tmp_path / "src"
    put(src, {
        "t001_v1/ET/t001_V1_rec/recording.g3": '{"name": "T001_V1", "created": "x", "by": ["t001", {"T001_V1_k": "V1 V12"}]}',
        "t001_v1/ET/t001_V1_rec/meta/participant": "someone",
        "t001_v1/ET/t001_V1_rec/V1/T001.json": "[1]",
        "T001_V1/ET/b_T001_V1.mp4": b"\x00T001_V1\xff", "T001_V1/ET/T001_V1.tsv": b"T001\xff,v1,V10\r\nT0012,xV1\n",
        "T001_V1/IDUN/T001_V1_eeg_B.csv": "b", "T001_V1/IDUN/T001_V1_EEG_a.csv": "a", "T001_V1/IDUN/T001_V1_quality.csv": "q", "T001_V1/IDUN/T001_V1.pdf": "p",
        "T001_V1/Driver Video/T001_V1.mkv": "v", "T001_V1/notes_V1.txt": "T001 v1", "T002_V1/ET/T002_V1.tsv": "T002", "T003_V2/ET/T003_V2.tsv": "T003", "other/ET/x.tsv": "x",
        "T001_V1/notes_v1.txt": "twice",
    })
    files = release.files_under(tables.listing(spark, f"file://{src}"), f"file://{src}")
    assert files.count() == 15 and files.where("relative LIKE '/%'").count() == 0
    ids = spark.createDataFrame([("T001_V1", "QX7"), ("T003_V2", "ZZ9")], "key string, random_id string")
    plan = release.anonymise_plan(files, ids, spark.createDataFrame([("T003_V2",)], "key string"))
    got = {r["relative"]: (r["target"], r["action"], r["status"]) for r in plan.collect()}
    ready = {k: v[:2] for k, v in got.items() if v[2] == "ready"}
    assert ready == {
        "t001_v1/ET/t001_V1_rec/recording.g3": ("QX7/ET/QX7_VX_et_raw/recording.g3", "title"), "t001_v1/ET/t001_V1_rec/meta/participant": ("QX7/ET/QX7_VX_et_raw/meta/participant", "participant"),
        "t001_v1/ET/t001_V1_rec/V1/T001.json": ("QX7/ET/QX7_VX_et_raw/VX/QX7.json", "json"), "T001_V1/ET/b_T001_V1.mp4": ("QX7/ET/QX7_VX_eyeball_video.mp4", "copy"), "T001_V1/ET/T001_V1.tsv": ("QX7/ET/QX7_VX_et.tsv", "text"),
        "T001_V1/IDUN/T001_V1_eeg_B.csv": ("QX7/IDUN/QX7_VX_eeg_2.csv", "text"), "T001_V1/IDUN/T001_V1_EEG_a.csv": ("QX7/IDUN/QX7_VX_eeg_1.csv", "text"), "T001_V1/IDUN/T001_V1_quality.csv": ("QX7/IDUN/QX7_VX_quality.csv", "text"),
        "T001_V1/IDUN/T001_V1.pdf": ("QX7/IDUN/QX7_VX_report.pdf", "copy"), "T001_V1/Driver Video/T001_V1.mkv": ("QX7/Driver Video/QX7_VX_driver_video.mkv", "copy"),
    }
    assert {k: v[2] for k, v in got.items() if v[2] != "ready"} == {"T001_V1/notes_V1.txt": "collision", "T001_V1/notes_v1.txt": "collision", "T002_V1/ET/T002_V1.tsv": "no id", "T003_V2/ET/T003_V2.tsv": "excluded"}
    done = run(spark, tmp_path, plan, "named")
    assert {k for k, s in done.items() if s == "written"} == set(ready) and done["T002_V1/ET/T002_V1.tsv"] == "no id"
    named = tmp_path / "named"
    assert sorted(str(p.relative_to(named)) for p in named.rglob("*") if p.is_file()) == sorted(t for t, _ in ready.values())
    base = named / "QX7/ET"
    assert json.loads((base / "QX7_VX_et_raw/recording.g3").read_text()) == {"name": "QX7_VX", "created": "x", "by": ["QX7", {"QX7_VX_k": "VX V12"}]}
    assert (base / "QX7_VX_et_raw/meta/participant").read_text() == '{"name":"QX7"}' and (base / "QX7_VX_eyeball_video.mp4").read_bytes() == b"\x00T001_V1\xff"
    assert (base / "QX7_VX_et.tsv").read_bytes() == b"QX7\xff,VX,V10\r\nQX72,xV1\n"
    # a second run does what is left: one file is gone, another was left half written
    os.unlink(base / "QX7_VX_et.tsv")
    again = run(spark, tmp_path, plan, "named")
    assert again["T001_V1/ET/T001_V1.tsv"] == "written" and sorted(s for s in again.values() if s != "exists") == ["collision", "collision", "excluded", "no id", "written"]


def test_shifted_folders(spark, tmp_path):
    src = tmp_path / "src"
    put(src, {
        "A/IDUN/A_eeg.csv": "timestamp,ch1\n1709287200.500,1\n1709287201.25,2\n", "A/IDUN/A_imu.csv": "timestamp,x\n", "A/LSL/A.xdf": container("2024-03-01T10:00:00.75Z"), "A/ET/raw/recording.g3": '{"created": "2024-03-01T10:00:05Z", "n": 1}',
        "A/SILAB/a.asc": "Date,speed\nx,1\n", "A/SILAB/b.asc": "speed\n1\n", "A/ET/other.json": "{}", "B/ET/raw/recording.g3": '{"created": "never"}', "C/LSL/C.xdf": b"XDF:broken", "C/ET/x.tsv": "x",
        "D/LSL/D.xdf": xdf.MAGIC + xdf.chunk(xdf.FILE_HEADER, b"<info/>"), "E/IDUN/E.csv": "timestamp\nword\n",
    })
    files = release.files_under(tables.listing(spark, f"file://{src}"), f"file://{src}")
    plan = release.time_shift_plan(files)
    got = {r["relative"]: (r["action"], r["delta"], r["status"]) for r in plan.collect()}
    delta = release.ORIGIN - 1709287200
    assert got == {
        "A/IDUN/A_eeg.csv": ("shift_table", delta, "ready"), "A/IDUN/A_imu.csv": ("copy", delta, "ready"), "A/LSL/A.xdf": ("shift_container", delta, "ready"), "A/ET/raw/recording.g3": ("shift_json", delta, "ready"),
        "A/SILAB/a.asc": ("drop_columns", delta, "ready"), "A/SILAB/b.asc": ("copy", delta, "ready"), "A/ET/other.json": ("copy", delta, "ready"), "B/ET/raw/recording.g3": ("copy", None, "ready"),
        "C/LSL/C.xdf": ("copy", None, "unreadable: ValueError"), "C/ET/x.tsv": ("copy", None, "another file of the record is unreadable"), "D/LSL/D.xdf": ("copy", None, "ready"), "E/IDUN/E.csv": ("copy", None, "unreadable: InvalidOperation"),
    }
    done = run(spark, tmp_path, plan, "shifted")
    assert sum(s == "written" for s in done.values()) == 9 and not (tmp_path / "shifted/C").exists()
    to = tmp_path / "shifted"
    assert (to / "A/IDUN/A_eeg.csv").read_bytes() == b"timestamp,ch1\n946684800.500,1\n946684801.25,2\n" and (to / "A/SILAB/a.asc").read_bytes() == b"speed\n1\n"
    assert json.loads((to / "A/ET/raw/recording.g3").read_text()) == {"created": "2000-01-01T00:00:05Z", "n": 1}
    assert rewriting.header_date(open(to / "A/LSL/A.xdf", "rb")) == "2000-01-01T00:00:00.75Z"
    # what fails leaves no file, and is told
    bad = plan.where("relative = 'A/SILAB/b.asc'").withColumn("action", F.lit("shift_container"))
    assert run(spark, tmp_path, bad, "bad")["A/SILAB/b.asc"].startswith("failed: ValueError") and [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] == []
    assert release.time_shift_plan(files.where("false")).count() == 0


def test_nested_json(spark):
    rows = [(1, '{"T1_V2": ["t1", "V2x", {"a": null}]}', "T1", "V2", "N"), (2, "no json", "T1", "V2", "N"), (3, None, "T1", "V2", "N"), (4, '"T1"', None, "V2", "N"), (5, "", "T1", "V2", "N")]
    df = spark.createDataFrame(rows, "k int, j string, p string, v string, n string")
    got = {r["k"]: r["o"] for r in df.select("k", anonymize.json_renamed(F.col("j"), F.col("p"), F.col("v"), F.col("n")).alias("o")).collect()}
    assert got == {1: '{"N": ["N", "V2x", {"a": null}]}', 2: None, 3: None, 4: None, 5: None}
