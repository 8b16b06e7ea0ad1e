"""Containers read in splits, pruned to streams and channels, and put on the recorder's clock."""

import io
import math
import random
import struct

import numpy as np
import pytest

from chronoweave.operators import clock_sync
from chronoweave.sources import recordings, xdf, xdf_scan


def header(name, labels, kind="double64", rate=0.0):
    return xdf.stream_header(name, labels, text=kind == "string", rate=rate).replace(b"double64", kind.encode())


def numeric_chunk(sid, rows, kind):
    """rows: (time or None, values)."""
    parts = [struct.pack("<I", sid), xdf.encode_length(len(rows))]
    for t, v in rows:
        parts.append((b"\0" if t is None else b"\x08" + struct.pack("<d", t)) + np.asarray(v, dtype=xdf.DTYPES[kind]).tobytes())
    return xdf.chunk(xdf.SAMPLES, b"".join(parts))


def container(rng, chunks=60):
    """Three numeric streams of different types with and without times, one of texts, one that starts late, one that has
    nothing, clock offsets and boundaries between them."""
    out = [xdf.MAGIC, xdf.chunk(xdf.FILE_HEADER, b"<info/>")]
    kinds = {1: ("eeg", ["a", "b", "c"], "float32", 100.0), 2: ("eye", ["x", "y"], "double64", 0.0), 3: ("big", [f"c{k}" for k in range(64)], "int64", 50.0), 4: ("marks", ["m"], "string", 0.0), 5: ("late", ["z"], "int16", 10.0), 6: ("none", ["n"], "double64", 1.0)}
    for sid in (1, 2, 3, 4, 6):
        name, labels, kind, rate = kinds[sid]
        out.append(xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", sid) + header(name, labels, kind, rate)))
    for k in range(chunks):
        if k == chunks // 2:
            out.append(xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", 5) + header("late", ["z"], "int16", 10.0)))
        for sid in (1, 2, 3, 5):
            if sid == 5 and k < chunks // 2:
                continue
            labels, kind = kinds[sid][1], kinds[sid][2]
            timed = [k == 0 or (sid == 5 and k == chunks // 2) or rng.random() < (0.1, 1.0, 0.5)[rng.randrange(3)] for _ in range(rng.choice([0, 1, 7]) or (k == 0 or sid == 5 and k == chunks // 2))]
            out.append(numeric_chunk(sid, [(k + j / 10 + sid if there or sid == 2 else None, [rng.randrange(100) for _ in labels]) for j, there in enumerate(timed)], kind))
        out.append(xdf.chunk(xdf.SAMPLES, struct.pack("<I", 4) + xdf.encode_samples([k + 0.5], [[f"märk {k}" * rng.randrange(4)]], text=True)))
        out.append(xdf.chunk(xdf.CLOCK, struct.pack("<Idd", 1 + k % 2, k, 0.25)))
        out.append(xdf.chunk(xdf.BOUNDARY, b"B" * 16))
    return b"".join(out)


def same(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("split_bytes", [1, 700, 1 << 40])
def test_splits_read_as_the_whole(spark, tmp_path, split_bytes):
    raw = container(random.Random(split_bytes))
    (tmp_path / "r.xdf").write_bytes(raw)
    path = f"file://{tmp_path}/r.xdf"
    files = spark.createDataFrame([(path,), (path,), (None,)], "path string")
    want = {}
    for sid, s in xdf.read_streams(io.BytesIO(raw)).items():
        for k, (t, row) in enumerate(zip(s["times"], s["rows"], strict=True)):
            want[sid, k] = (s["header"]["name"], round(t, 9), row)
    indexed = xdf_scan.index(files, None, split_bytes)
    assert indexed.count() == {1: indexed.count(), 700: indexed.count(), 1 << 40: 1}[split_bytes] and (split_bytes > 700 or indexed.count() > 20)
    got = {(r["stream_id"], r["seq"]): (r["stream"], round(r["t"], 9), r["texts"] if r["numbers"] is None else r["numbers"]) for r in xdf_scan.scan(indexed).collect()}
    assert got == want
    few = xdf_scan.scan(xdf_scan.index(files, ["eeg", "late"], split_bytes), {"eeg": ["c", "nothing", "a"], "late": None}).collect()
    assert {(r["stream_id"], r["seq"]): (r["stream"], round(r["t"], 9), r["numbers"]) for r in few} == {k: (n, t, [v[2], v[0]] if n == "eeg" else v) for k, (n, t, v) in want.items() if n in ("eeg", "late")}
    assert {tuple(r["labels"]) for r in few} == {("c", "a"), ("z",)}
    told = {r["stream"]: (r["status"], r["missing"]) for r in xdf_scan.stream_status(indexed, {"eeg": ["a", "q"], "late": None, "gone": None, "eye": ["x"]}).collect()}
    assert told == {"eeg": ("missing channels", ["q"]), "late": ("ready", []), "gone": ("missing stream", []), "eye": ("ready", [])}
    offsets = xdf_scan.clock_offsets(files, ["eye"]).orderBy("seq").collect()
    assert [(r["stream_id"], r["seq"], r["time"], r["value"]) for r in offsets] == [(2, k, float(2 * k + 1), 0.25) for k in range(30)]


def test_unread_streams_stay_on_disk():
    out = [xdf.MAGIC]
    for sid, name in ((1, "big"), (2, "small")):
        out.append(xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", sid) + header(name, ["a"])))
    big = [[float(k)] for k in range(20_000)]
    for k in range(30):
        out.append(xdf.chunk(xdf.SAMPLES, struct.pack("<I", 1) + xdf.encode_samples(range(20_000), big)))
        out.append(xdf.chunk(xdf.SAMPLES, struct.pack("<I", 2) + xdf.encode_samples([k], [[1.0]])))
    raw = b"".join(out)
    places = xdf_scan.Places(io.BytesIO(raw))
    splits, status = xdf_scan.file_index(places, {"small"}, 100)
    assert status == "ready" and places.taken < 10_000 < len(raw) / 1000 and len(splits) > 5
    rows = [b for s in splits for b in xdf_scan.read_split(places, {"path": "p", **s}, {"small": None})]
    assert sum(b.num_rows for b in rows) == 30 and places.taken < 20_000


def test_broken_files_are_rows(spark, tmp_path):
    raw = container(random.Random(3))
    for name, bytes_ in (("cut", raw[:-5]), ("other", b"nothing of it"), ("empty", b""), ("head", raw[:4]), ("whole", raw)):
        (tmp_path / name).write_bytes(bytes_)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("cut", "other", "empty", "head", "whole", "gone")], "path string")
    status = {r["path"].rsplit("/")[-1]: (r["status"], r["split"]) for r in xdf_scan.index(files).collect()}
    assert status == {"cut": ("the file ends inside a chunk", 0), "other": ("no container", None), "empty": ("no container", None), "head": ("ready", None), "whole": ("ready", 0), "gone": ("unreadable: FileNotFoundError", None)}
    samples, told = recordings.load(files, {"eeg": None})
    assert samples.select("path").distinct().count() == 2 and told.count() == 6
    assert {r["path"].rsplit("/")[-1]: r["status"] for r in told.collect()}["cut"] == "the file ends inside a chunk"
    with pytest.raises(ValueError):
        xdf.read_streams(io.BytesIO(xdf.MAGIC + xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", 1) + header("x", ["a"], rate=1.0)) + numeric_chunk(1, [(None, [1.0])], "double64")))


def drifting(rng, n=3000, reset=1800, rate=100.0, outliers=True):
    """True times of samples at a steady rate, and what a drifting device that restarts once, and jitters, says."""
    truth = 500.0 + np.arange(n) / rate + np.where(np.arange(n) >= reset, 7.0, 0.0)
    zero = np.where(np.arange(n) >= reset, truth[reset] - 3.0, 12.0)
    rest = np.where(np.arange(n) >= reset, 1 + 8e-5, 1 - 4e-5)
    device = (truth - zero) * rest
    offsets = [(k + 0.5, device[k], truth[k] - device[k] + rng.gauss(0, 1e-4) + (0.4 if outliers and k % 7 == 3 else 0.0)) for k in range(0, n, 25)]
    return truth, device + np.array([rng.gauss(0, 0.004) for _ in range(n)]), offsets


def test_clock_synchronisation(spark, tmp_path):
    """Planted drift, one reset, wrong measurements and jitter: times within a millisecond; raw where asked for."""
    rng = random.Random(8)
    chunks, truths, said = [], {}, {}
    for name in ("one", "two"):
        truth, device, offsets = drifting(rng)
        truths[name], said[name] = truth, device
        at = {k: (t, v) for k, t, v in offsets}
        for k in range(0, len(device), 5):
            chunks.append((name, 2 * k, "eeg", ["v"], 100.0, [(float(device[j]), [float(j)]) for j in range(k, k + 5)], None))
            for j in range(k, k + 5):
                if j + 0.5 in at:
                    chunks.append((name, 2 * k + 1, "eeg", ["v"], 100.0, [], tuple(map(float, at[j + 0.5]))))
        chunks.append((name, -1, "still", ["v"], 0.0, [(1.5, [0.0]), (1.25, [1.0])], None))
    rows = spark.createDataFrame(chunks, "file string, place long, stream string, labels array<string>, rate double, samples array<struct<t: double, values: array<double>>>, offset struct<time: double, value: double>")
    written = xdf_scan.write_containers(rows, f"file://{tmp_path}/out").collect()
    assert sorted(r["streams"] for r in written) == [2, 2] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.xdf", "two.xdf"]
    files = spark.createDataFrame([(r["path"],) for r in written], "path string")
    samples, status = recordings.load(files, {"eeg": ["v"], "still": None}, split_bytes=2000)
    assert {r["status"] for r in status.collect()} == {"ready"}
    got = samples.collect()
    for name in truths:
        t = np.array([x[1] for x in sorted((r["seq"], r["t"]) for r in got if r["stream"] == "eeg" and name in r["path"])])
        assert len(t) == 3000 and np.abs(t - truths[name]).max() < 1e-3 and (np.diff(t) > 0).all()
        raw, _ = recordings.load(files.where(f"path LIKE '%{name}%'"), {"eeg": None}, synchronise=False, dejitter=False)
        assert [r["t"] for r in raw.orderBy("seq").collect()] == said[name].tolist()
        only, _ = recordings.load(files.where(f"path LIKE '%{name}%'"), {"eeg": None}, dejitter=False)
        assert 1e-3 < np.abs(np.array([r["t"] for r in only.orderBy("seq").collect()]) - truths[name]).max() < 0.03
    assert sorted((r["seq"], r["t"]) for r in got if r["stream"] == "still") == [(0, 1.5), (0, 1.5), (1, 1.25), (1, 1.25)]
    checks = {(r["path"][-7:], r["stream"]): r["status"] for r in recordings.checked(samples).collect()}
    assert checks == {("one.xdf", "eeg"): "ready", ("two.xdf", "eeg"): "ready", ("one.xdf", "still"): "times do not increase", ("two.xdf", "still"): "times do not increase"}


def test_clock_edges(spark):
    """No offsets, one, equal times, nulls in any column, an empty table, breaks and missing times."""
    samples = spark.createDataFrame([(k, s, i, 10 * i, t, 1.0) for k, s in (("a", 1), ("b", 1), (None, None)) for i, t in enumerate([0.0, 1.0, 2.2, None, 10.0, 10.9, 12.0])], "path string, stream_id int, seq long, place long, t double, rate double")
    offsets = spark.createDataFrame([("b", 1, 5, 1.0, 100.0), (None, None, 1, 4.0, 2.0), (None, None, 2, 4.0, 2.0), ("c", 1, 1, 0.0, 0.0), ("b", 1, None, None, 1.0)], "path string, stream_id int, place long, time double, value double")
    got = clock_sync.synchronised(samples, offsets, ["path", "stream_id"])
    assert got.columns == [*samples.columns, "part"] and got.count() == 21
    assert sorted({(r["path"], r["t"]) for r in got.where("seq = 1").collect()}, key=repr) == [("a", 1.0), ("b", 101.0), (None, 3.0)]
    even = clock_sync.dejittered(got, ["path", "stream_id"], "rate").where("path = 'a'").orderBy("seq").collect()
    assert [r["t"] if r["t"] is None else round(r["t"], 6) for r in even] == [-0.033333, 1.066667, 2.166667, None, 9.966667, 10.966667, 11.966667]
    none = samples.where("false")
    assert clock_sync.dejittered(clock_sync.synchronised(none, offsets, ["path", "stream_id"]), ["path", "stream_id"], "rate").count() == 0
    assert clock_sync.synchronised(samples, offsets.where("false"), ["path", "stream_id"]).where("t <> t + 0").count() == 0


def test_streams_side_by_side(spark):
    rows = [("p", "a", 1, 0, 0.0, ["x", "y"], [1.0, 2e9], None), ("p", "a", 1, 1, 1.0, ["x", "y"], [3.0, math.nan], None), ("p", "a", 2, 0, 9.0, ["x", "y"], [3.0, 1.0], None), ("p", "b", 3, 0, 1.0, ["x"], [5.0], None), ("p", "c", 4, 0, 1.0, ["z"], [7.0], None), ("p", "c", 4, 1, 1.0, ["z"], [8.0], None), ("p", "c", 4, 2, None, ["z"], [8.0], None), ("p", "m", 5, 0, 1.0, ["m"], None, ["t"])]
    s = spark.createDataFrame(rows, "path string, stream string, stream_id int, seq long, t double, labels array<string>, numbers array<double>, texts array<string>")
    got = [r.asDict() for r in recordings.side_by_side(s, ["a", "b", "c", "m"]).orderBy("t").collect()]
    assert got == [{"path": "p", "t": 0.0, "a.x": 1.0, "a.y": None, "b.x": None, "c.z": None}, {"path": "p", "t": 1.0, "a.x": 3.0, "a.y": None, "b.x": 5.0, "c.z": 7.0}]
