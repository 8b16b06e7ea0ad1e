"""The jobs over growing input, run again, from the command line, and against brute force."""

import datetime
import hashlib
import json
import os
import re
import statistics
import subprocess
import sys

from jobs import common, recording_quality, release_texts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def brute_release(options, doc_id, text, lang, source):
    kinds = options["kinds"]
    found = []

    def name(m):
        kind = next(k for k, o in kinds.items() if re.fullmatch(o["pattern"], m[0]))
        bare = "".join(c for c in m[0].lower() if c not in kinds[kind]["loose"])
        found.append(kind)
        return f"<{kind}:{hashlib.sha256('|'.join((options['secret'], kind, bare)).encode()).hexdigest()[:16]}>"

    out = None if text is None else re.sub("|".join(f"(?:{o['pattern']})" for o in kinds.values()), name, text)
    release = "controlled" if re.search(options["controlled"], text or "") else "public"
    return (doc_id, source, out, len(found), ",".join(sorted(set(found))), release, lang or "und")


def test_release_of_growing_texts(spark, tmp_path):
    options = common.config(spark, release_texts.CONFIG)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    docs += [(-1, None, None, None), (-2, "", "", "a/b=c"), (-3, "call +1 (212) 555-0199 or +1 212 555 0199, a-b@c.example.org ab@c.example.org", "x y", "a"), (-3, "call +1 (212) 555-0199 or +1 212 555 0199, a-b@c.example.org ab@c.example.org", "x y", "a")]
    docs += [(-4, "x" * 200_000 + " 10.0.0.1 1234567890123456 token = 1", "en", None), (-5, "10.0.0.1" * 3 + "me@here.example.com", "en", "a")]
    rows = lambda part: spark.createDataFrame(part, "doc_id long, text string, lang string, source string")
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    half = len(docs) // 2
    wanted = [brute_release(options, *d) for d in docs]
    rows(docs[:half]).write.parquet(source)
    first = release_texts.run(spark, source, out, mark, options)
    assert first["read"] == first["rows"] == half
    assert sorted(map(tuple, release_texts.read(spark, out).collect()), key=repr) == sorted(wanted[:half], key=repr)
    rows(docs[half:]).write.mode("append").parquet(source)
    second = release_texts.run(spark, source, out, mark, options)
    assert second["rows"] == len(docs) - half and second["replaced"] == sum(w[3] for w in wanted[half:]) and second["controlled"] == sum(w[5] == "controlled" for w in wanted[half:])
    for _ in range(2):
        got = sorted(map(tuple, release_texts.read(spark, out).collect()), key=repr)
        assert got == sorted(wanted, key=repr)
        assert release_texts.run(spark, source, out, mark, options)["rows"] == 0  # nothing is new
    assert os.path.isdir(tmp_path / "out" / "release=controlled" / "lang=en")
    told = {w[0]: w[2] for w in got}[-3]
    assert len(set(re.findall("<phone:[0-9a-f]+>", told))) == 1 and len(set(re.findall("<email:[0-9a-f]+>", told))) == 2


def test_release_keeps_what_a_broken_run_wrote_once(spark, tmp_path):
    """A batch that was planned but not committed is done again by the next run, once."""
    options = common.config(spark, release_texts.CONFIG)
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    spark.createDataFrame([(k, f"text {k}", "en", "a") for k in range(10)], release_texts.INPUT).write.parquet(source)
    release_texts.run(spark, source, out, mark, options)
    for file in (tmp_path / "mark" / "commits").glob("*0*"):
        file.unlink()
    release_texts.run(spark, source, out, mark, options)
    assert sorted(r["doc_id"] for r in release_texts.read(spark, out).collect()) == list(range(10))


def brute_days(events, o):
    groups = {}
    for seq, ts, rec, value in events:
        if ts is not None:
            groups.setdefault((ts.date(), rec), []).append((seq, ts.replace(tzinfo=datetime.timezone.utc).timestamp(), value))
    low, high = o["valid"]
    out = {}
    for key, rows in groups.items():
        rows.sort()
        steps = [b[1] - a[1] for a, b in zip(rows, rows[1:], strict=False)]
        known = [v for _, _, v in rows if v is not None and low <= v <= high]
        wrong = sum(v is not None and not low <= v <= high for _, _, v in rows)
        centre = statistics.median(known) if known else None
        mad = statistics.median(abs(v - centre) for v in known) if known else None
        scale = (1.4826 * mad if mad > 0 else statistics.pstdev(known)) if known else None
        stretches, now = [], None
        for _, t, v in sorted(rows, key=lambda r: (r[1], r[0])):
            if v is None or not low <= v <= high:
                now = None
            elif now and t - now[1] <= o["longest_step_s"]:
                now[1] = t
            else:
                now = [t, t]
                stretches.append(now)
        span = max(r[1] for r in rows) - min(r[1] for r in rows)
        missing = len(rows) - len(known) - wrong
        few, gaps, back, same = len(known) < o["unusable_valid_rows"], missing + wrong > o["review_missing_share"] * len(rows), sum(s < 0 for s in steps), sum(s == 0 for s in steps)
        why = [w for w, x in (("too few valid samples", few), ("many samples missing or invalid", gaps), ("times go back", back), ("times repeat", same)) if x]
        out[key] = (
            len(rows), missing, wrong, back, same, None if not steps else round(max(steps), 4), None if centre is None else round(centre, 4), None if scale is None else round(scale, 4),
            sum(abs(v - centre) > o["outlier_scales"] * scale for v in known) if scale else 0, len(stretches), round(sum(b - a for a, b in stretches) / span, 4) if span else 0.0,
            "unusable" if few else "review" if gaps or back or same else "usable", "; ".join(why),
        )
    return out


def told_days(spark, out):
    rows = [r.asDict() for r in recording_quality.read(spark, out).collect()]
    short = lambda x: round(x, 4) if isinstance(x, float) else x
    return {(r["day"], r["rec"]): tuple(short(r[c]) for c in ("n", "missing", "invalid", "backward", "repeated", "longest_step", "median", "scale", "outliers", "stretches", "covered", "status", "reasons")) for r in rows}


def test_quality_of_growing_recordings(spark, tmp_path):
    o = common.config(spark, recording_quality.CONFIG)
    day = lambda d, h, m=0: datetime.datetime(2024, 3, d, h, m)
    events = [(k, day(1 + k % 3, k % 24, k % 7), k % 4, float(k % 50) if k % 9 else None) for k in range(400)]
    events += [(1000, None, 1, 1.0), (1001, day(1, 5), None, 3.0), (1002, day(1, 5), None, 900.0), (1003, day(1, 4), None, float("nan")), (1004, day(1, 6), None, 4.0), (1005, day(2, 0), 9, None)]
    events += [(1100 + k, day(3, 1, k), 77, v) for k, v in enumerate([5.0] * 20 + [150.0])]
    frame = lambda part: spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, value double")
    nan = lambda rows: [(a, b, c, None if v is not None and v != v else v) for a, b, c, v in rows]
    source, out = f"file://{tmp_path}/events", f"file://{tmp_path}/out"
    frame(events).write.parquet(source)
    done = recording_quality.run(spark, source, out, o)
    want = brute_days(nan(events), o)
    assert told_days(spark, out) == want and done["rows"] == len(want) and done["read"] == len(events) - 1
    assert {w[11] for w in want.values()} == {"usable", "review", "unusable"}
    parts = recording_quality.read(spark, out, "stretches").collect()
    assert len(parts) == sum(w[9] for w in want.values())
    # late samples of one day: that day is done again, the others' files stay as they are
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "out").rglob("*.parquet"))}
    late = [(2000 + k, day(2, 20, k), 1, 7.0) for k in range(30)]
    frame(late).write.mode("append").parquet(source)
    for _ in range(2):
        recording_quality.run(spark, source, out, o | {"from_day": "2024-03-02", "to_day": "2024-03-02"})
        assert told_days(spark, out) == brute_days(nan(events + late), o)
    after = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "out").rglob("*.parquet"))}
    assert {p: t for p, t in before.items() if "day=2024-03-02" not in p} == {p: t for p, t in after.items() if "day=2024-03-02" not in p}


def test_jobs_of_nothing(spark, tmp_path):
    source, out = f"file://{tmp_path}/none", f"file://{tmp_path}/out"
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, value double").write.parquet(source)
    assert recording_quality.run(spark, source, out, common.config(spark, recording_quality.CONFIG))["rows"] == 0
    spark.createDataFrame([], release_texts.INPUT).write.parquet(f"{source}-texts")
    assert release_texts.run(spark, f"{source}-texts", f"{out}-texts", f"{out}-mark", common.config(spark, release_texts.CONFIG))["rows"] == 0


def test_command_lines(tmp_path):
    for job, table, more in (("release_texts", "document[s]", ["--checkpoint", f"{tmp_path}/mark"]), ("recording_quality", "events", [])):
        call = [sys.executable, "-m", f"jobs.{job}", "--config", f"jobs/{job}.json", "--input", f"{SF}/{table}.parquet", "--output", f"{tmp_path}/{job}", *more]
        for _ in range(2):
            said = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=180, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
            assert said.returncode == 0 and re.search(r"read \d+ .*; wrote \d+", said.stderr), said.stderr[-2000:]
        assert list((tmp_path / job).rglob("*.parquet"))
    assert "wrote 0 rows" not in said.stderr and json.loads(open(f"{ROOT}/jobs/recording_quality.json").read())["to_day"] is None
