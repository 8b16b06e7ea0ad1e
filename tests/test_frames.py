"""Frame index, exact times and decode plans against brute force, and at broken probes."""

import bisect
import json
import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from chronoweave.functions import scalars
from chronoweave.operators import frames
from chronoweave.sources import probe, tables


def brute_index(stream, packets, shown):
    """source, status and rows of one video's probe."""

    def built(ticks, keys):
        try:
            base = Fraction(stream["time_base"])
        except (ValueError, ZeroDivisionError):
            return "invalid time base", []
        if base <= 0:
            return "invalid time base", []
        if stream["width"] <= 0 or stream["height"] <= 0:
            return "invalid dimensions", []
        if not ticks:
            return "no frames", []
        if None in ticks:
            return "missing timestamps", []
        steps = [b - a for a, b in zip(ticks, ticks[1:], strict=False)]
        if min(steps, default=1) <= 0:
            return ("backward" if min(steps) < 0 else "duplicate") + " timestamps", []
        keys = keys if any(keys) else [True] + [False] * (len(ticks) - 1)
        last, rows = 0, []
        for k, (t, key) in enumerate(zip(ticks, keys, strict=True)):
            last = k if key else last
            rows.append((k, t, (float(t - ticks[0]) * base.numerator) / base.denominator, key, last, base.numerator, base.denominator, ticks[0]))
        return "ready", rows

    number = lambda x: int(x) if x is not None and x.strip().lstrip("+-").isdigit() else None
    pts = [number(p["pts"]) for p in packets]
    fast = stream["codec_name"].lower() == "h264" and stream["field_order"] == "progressive" and stream["has_b_frames"] == 0 and stream["attached_pic"] == 0 and packets
    fast = fast and stream["nb_frames"] in (None, "", "N/A", str(len(packets))) and all(t is not None and t == number(p["dts"]) and "D" not in (p["flags"] or "") and "C" not in (p["flags"] or "") for t, p in zip(pts, packets, strict=True))
    fast = fast and "K" in (packets[0]["flags"] or "") and all(b > a for a, b in zip(pts, pts[1:], strict=False))
    if fast:
        return ("packets", *built(pts, ["K" in (p["flags"] or "") for p in packets]))
    return ("frames" if shown else None, *built([number(f["best_effort_timestamp"]) for f in shown], [f["key_frame"] == 1 for f in shown]))


def some_probe(rng):
    n = rng.choice([1, 2, 5, 30])
    ticks, t = [], rng.randrange(-50, 50)
    for _ in range(n):
        ticks.append(t)
        t += rng.choice([1, 500, 501]) if rng.random() > 0.02 else rng.choice([0, -3])
    text = lambda x: str(x) if rng.random() > 0.01 else rng.choice([None, "N/A", "", "x1"])
    stream = {"codec_name": rng.choice(["h264", "H264", "h264", "vp9"]), "time_base": rng.choice(["1/30000", "2/60000", "1001/30000", "1/30000", "90/0", "0/5", "", "3"]), "width": rng.choice([640] * 9 + [0]), "height": 480, "field_order": rng.choice(["progressive"] * 4 + ["tt"]), "has_b_frames": rng.choice([0, 0, 0, 2]), "nb_frames": rng.choice([None, "N/A", str(n), str(n), str(n + 1)]), "attached_pic": rng.choice([0] * 9 + [1])}
    packets = [{"pts": text(x), "flags": ("K" if k % 7 == 0 else "_") + rng.choice(["__"] * 60 + ["D_", "_C"])} for k, x in enumerate(ticks)]
    packets = [p | {"dts": p["pts"] if rng.random() > 0.005 else "7"} for p in packets]
    shown = [{"best_effort_timestamp": text(x), "key_frame": int(k % 7 == 0 and n != 5)} for k, x in enumerate(ticks)]
    return stream, packets if rng.random() > 0.1 else [], shown if rng.random() > 0.1 else []


def test_index_of_probes(spark, tmp_path):
    rng = random.Random(22)
    probes = {f"v{k}": some_probe(rng) for k in range(150)}
    for name, (s, p, f) in probes.items():
        stream = {**{k: v for k, v in s.items() if k != "attached_pic"}, "disposition": {"attached_pic": s["attached_pic"]}}
        (tmp_path / f"{name}.json").write_text(json.dumps({"streams": [stream] * (2 if name == "v3" else 1), "packets": p, "frames": f}, indent=1))
    (tmp_path / "broken.json").write_text('{"streams": [')
    index, audit = frames.frame_index(*probe.read_probe(spark, f"file://{tmp_path}"))
    index, audit = index.collect(), audit.collect()
    want = {name: brute_index(*p) for name, p in probes.items()}
    got = {r["video"]: (r["source"], r["status"]) for r in audit}
    assert got.pop("v3")[1] == "several streams"
    assert got == {name: (source, status) for name, (source, status, _) in want.items() if name != "v3"}
    rows = {}
    for r in sorted(index, key=lambda r: (r["video"], r["frame"])):
        rows.setdefault(r["video"], []).append(tuple(r)[1:])
    assert rows == {name: rows_ for name, (_, _, rows_) in want.items() if rows_ and name != "v3"}
    assert {s for _, s, _ in want.values()} >= {"ready", "invalid time base", "duplicate timestamps", "backward timestamps", "missing timestamps", "no frames", "invalid dimensions"}


def index_frame(spark, times):
    return spark.createDataFrame([(v, k, t, k - k % 4) for v, ts in times.items() for k, t in enumerate(ts)], "video string, frame long, time double, keyframe long")


def test_lookups_and_ranges(spark):
    rng = random.Random(25)
    times = {v: sorted({0.0, *(round(rng.random() * 10, 1) for _ in range(60))}) for v in ("a", "b")}
    asked = [(v, k, t) for v in ("a", "b", "none") for k, t in enumerate([None, math.nan, math.inf, -1.0, 11.0, *(round(rng.random() * 10, 2) for _ in range(25))])]
    found = frames.lookup(spark.createDataFrame(asked, "video string, k long, time double"), index_frame(spark, times))

    def brute(v, t):
        if v not in times:
            return (None, None, "no index")
        if t is None or not math.isfinite(t):
            return (None, None, "no time")
        ts = times[v]
        i = min(max(bisect.bisect_left(ts, t), 0), len(ts) - 1)
        if i and not (i == len(ts) - 1 and t > ts[i]) and abs(ts[i - 1] - t) <= abs(ts[i] - t):
            i -= 1
        return (i, i - i % 4, "before" if t < 0 else "after" if t > ts[-1] else "ready")

    got = {(r["video"], r["k"]): (r["frame"], r["keyframe"], r["found"]) for r in found.collect()}
    assert got == {(v, k): brute(v, t) for v, k, t in asked}
    for v in ("a", "b"):
        need = {f for (w, _), (last, first, _) in got.items() if w == v and last is not None for f in range(first, last + 1)}
        ranges = sorted((r["first"], r["last"]) for r in frames.decode_ranges(found).where(F.col("video") == v).collect())
        assert sorted(f for a, b in ranges for f in range(a, b + 1)) == sorted(need) and all(b[0] > a[1] + 1 for a, b in zip(ranges, ranges[1:], strict=False))


def test_exact_times_and_verification(spark):
    index = index_frame(spark, {v: [0.0, 0.04, 0.09] for v in ("good", "off", "more", "fewer")})
    rows = [("good", k, k) for k in range(3)] + [("off", 0, 0), ("off", 1, 2), ("off", 2, 1)] + [("more", k, k) for k in range(4)] + [("fewer", k, k) for k in range(2)] + [("none", 0, 0), ("off", 3, None)]
    timed, audit = frames.exact_times(spark.createDataFrame(rows, "video string, place long, frame_index long"), index)
    assert [tuple(r) for r in timed.orderBy("place").collect()] == [("good", 0, 0, 0.0), ("good", 1, 1, 0.04), ("good", 2, 2, 0.09)]
    assert {r["video"]: r["status"] for r in audit.collect()} == {"good": "written", "off": "frame numbers out of place", "more": "more rows than frames", "fewer": "fewer rows than frames", "none": "no index"}
    decoded = spark.createDataFrame([("good", 1, 1, 0.0439), ("good", 1, 1, 0.045), ("good", 1, 2, 0.04), ("good", 2, 2, None), ("good", 7, 7, 0.0), ("good", 0, 0, 0.0)], "video string, frame long, decoded_frame long, decoded_time double")
    assert sorted(r["status"] for r in frames.verified(decoded, index).collect()) == sorted(["verified", "another time", "another frame", "another time", "no such frame", "verified"])
    none = spark.createDataFrame([], frames.STREAMS), spark.createDataFrame([], frames.PACKETS), spark.createDataFrame([], frames.FRAMES)
    assert [x.count() for x in frames.frame_index(*none)] == [0, 0]


def test_fifteen_digits(spark, tmp_path):
    rng = random.Random(15)
    values = [0.0, -0.0, 1.0, 0.1 + 0.2, 1.000000000000005, 123456789012345678.0, 1e15, 999999999999999.9, 1e-5, 0.0001, 1.5e300, 5e-324, 2.5, 100.0, -1 / 3, math.nan, math.inf, None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = {r["k"]: r["t"] for r in df.select("k", scalars.fifteen_digits(F.col("v")).alias("t")).collect()}
    assert got == {k: None if v is None else ("%.15g" % v if math.isfinite(v) else "") for k, v in enumerate(values)}
    assert tables.write_contract(df.where("k IN (3, 8)"), f"file://{tmp_path}/out", ["k", "v"], digits=("v",))
    assert sorted(r["v"] for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()) == ["0.3", "1e-05"]
