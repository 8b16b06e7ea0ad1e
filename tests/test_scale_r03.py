"""Queries that differed from their SQL on larger tables, or whose steps grew with what the tables hold."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from chronoweave.operators import alignment


def test_equal_spreads_rank_by_offset(spark):
    # a and b are as far apart as b and c but for the last bits
    rows = [(k, g, round(k * 0.37 + d, 2)) for k in range(300) for g, d in (("a", 0.0), ("b", 10.1), ("c", 20.2))]
    ranked = {(x.rec, x.rank): x.prior for x in alignment.priors(spark.createDataFrame(rows, "rec long, grp string, offset double"), 15.0, 5).collect()}
    assert all(ranked[k, 2] < ranked[k, 3] for k in range(300))


def test_cluster_means_take_the_events_order(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("""CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, k // 32 AS user_id, CASE WHEN k % 2 = 0 THEN 'click' ELSE 'view' END AS event_type,
        CAST(hash(k) % 20000 AS DOUBLE) / 100 AS value, '{}' AS props FROM range(32000) t(k)""")
    # Spark meets the rows in another order than the SQL does
    con.execute(f"COPY (SELECT * FROM events ORDER BY hash(event_id + 7)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(f"SELECT rec, prior, rank FROM ({entry.oracle_sql()['j17_w24_clusters']}) ORDER BY ALL").fetchall()
    got = sorted(tuple(x) for x in entry.queries()["j17_w24_clusters"](spark, str(tmp_path)).select("rec", "prior", "rank").collect())
    assert got == want


def test_identities_replaced_without_a_pattern_each(monkeypatch):
    import random

    from chronoweave.operators import anonymize

    plain = anonymize._bounded
    draw = random.Random(3)
    for alphabet in ("T1_v a", "T1_vſKa-"):
        for _ in range(3000):
            text, old = ("".join(draw.choices(alphabet, k=draw.randint(low, high))) for low, high in ((0, 12), (0, 3)))
            assert anonymize._word_replaced(text, old, r"\1R") == plain(old).sub(lambda _: r"\1R", text), (text, old)
    made = []
    monkeypatch.setattr(anonymize, "_bounded", lambda old: made.append(old) or plain(old))
    for k in range(5000):
        assert anonymize.replaced(f"t{k}_x at V{k % 7}", f"T{k}", f"V{k % 7}", f"R{k}") == f"R{k}_x at V0"
    assert not made


def test_small_chunks_and_files_share_batches(tmp_path):
    import io
    import struct

    import pyarrow as pa

    from chronoweave.sources import xdf, xdf_scan

    head = lambda sid, name, text=False: xdf.chunk(xdf.STREAM_HEADER, struct.pack("<I", sid) + xdf.stream_header(name, ["x"], text))
    some = lambda sid, t, v, text=False: xdf.chunk(xdf.SAMPLES, struct.pack("<I", sid) + xdf.encode_samples([t], [[v]], text))
    raw = xdf.MAGIC + head(1, "a") + head(2, "b") + head(3, "m", True)
    raw += b"".join(some(1 + k % 2, float(k), float(-k)) for k in range(600)) + some(3, 600.0, "go", True) + some(1, 601.0, -601.0)
    paths = [f"{tmp_path}/{k}.xdf" for k in range(3)]
    for p in paths:
        with open(p, "wb") as out:
            out.write(raw)
    files = pa.RecordBatch.from_pydict({"path": paths})
    indexed = list(xdf_scan._index_of(None, 1 << 20)([files]))
    assert len(indexed) == 1 and indexed[0].num_rows == 3
    batches = list(xdf_scan._scanned(None)(indexed))
    assert len(batches) <= 7  # numbers and texts take turns; a batch for each chunk would be 1806
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [p for p in paths for _ in range(602)]
    one = rows[:602]
    assert [(r["stream"], r["seq"], r["t"], r["numbers"]) for r in one[:600]] == [("ab"[k % 2], k // 2, float(k), [float(-k)]) for k in range(600)]
    assert one[600]["texts"] == ["go"] and one[600]["numbers"] is None and one[601]["numbers"] == [-601.0] and one[601]["seq"] == 300

    class Counted(io.BytesIO):
        reads = 0

        def read(self, *n):
            Counted.reads += 1
            return super().read(*n)

    assert xdf_scan.file_index(xdf_scan.Places(Counted(raw)), None, 1 << 20)[1] == "ready" and Counted.reads == 1


def test_frames_are_dealt_finer_than_the_sessions_shuffles(spark):
    from chronoweave.operators import frames

    streams = spark.createDataFrame([("v", "h264", "1/30", 640, 480, "progressive", 0, "2", 0)], frames.STREAMS)
    packets = spark.createDataFrame([("v", k, str(k), str(k), "K__") for k in range(2)], frames.PACKETS)
    index, _ = frames.frame_index(streams, packets, spark.createDataFrame([], frames.FRAMES))
    plan = index._jdf.queryExecution().toString()
    assert f", {frames.fine_tasks(spark)})" in plan
    assert [(r.frame, r.tick) for r in index.orderBy("frame").collect()] == [(0, 0), (1, 1)]


def test_folders_are_listed_by_tasks(spark, tmp_path):
    from chronoweave.operators import release
    from chronoweave.sources import tables

    for at in ("T001_V1/LSL/a.xdf", "T001_V1/LSL/deep er/b é.xdf", "T001_V1/.part", "T001_V1/_gone/x.xdf", "T001_V1/k=1/_y.xdf", "T001_V1/_k=1/z.xdf", "c.txt", "d._COPYING_", ".hidden/e.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(at)
    want = {(x.relative, x.size) for x in release.files_under(tables.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert len(want) == 4
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = release.found_under(spark, root).collect()
        assert sorted((x.relative, x.size) for x in found) == sorted(want)
        assert all(x.source == f"{root.rstrip('/')}/{x.relative}" for x in found)
    # a folder more is no task more: hundreds are what Spark's own listing makes of this
    for k in range(400):
        (tmp_path / f"R{k}/LSL").mkdir(parents=True)
        (tmp_path / f"R{k}/LSL/{k}.xdf").touch()
    assert release.found_under(spark, str(tmp_path)).count() == 404
    spark.sparkContext.setJobGroup("listed", "listed")
    assert release.found_under(spark, str(tmp_path)).count() == 404
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("listed") for s in told.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(s.numTasks for s in stages if s) < 60


def test_envelope_maps_fit_each_feature_once(spark):
    import numpy as np

    from chronoweave.operators import envelopes

    rng, rows = np.random.default_rng(5), []
    for rec in range(3):
        rows += [(rec, k / 10, float(v)) for k, v in enumerate(rng.normal(size=3000))]
    source = spark.createDataFrame(rows, "rec long, t double, value double")
    target = source.selectExpr("rec", "explode(array('a', 'b')) AS feature", "t + 4 AS t", "-value AS value")
    target = target.unionByName(source.selectExpr("rec", "'noise' AS feature", "t", "xxhash64(t) % 1000 / 1000.0 AS value"))
    priors = spark.createDataFrame([(0, 4.0), (1, 4.0), (2, 4.0), (9, 4.0)], "rec long, prior double")
    m = envelopes.envelope_maps(source, target, priors, 10.0, 10.0, length=100.0, step=50.0, coarse=5.0)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "FlatMapCoGroupsInPandas" not in plan
    got = {x.rec: (x.status, x.feature, x.intercept and round(x.intercept, 3), x.agreement) for x in m.collect()}
    assert got == {**{k: ("offset_only", "a", 4.0, False) for k in range(3)}, 9: ("unavailable", None, None, False)}


def test_agreement_of_maps(spark):
    from chronoweave.operators import envelopes

    fit = lambda rec, feature, kind, a, b, n, r=0.9: (rec, feature, kind, a, b, (b - 1) * 1e6 if kind == "affine" else None, n, n, r, 0.01, 0.0, 0.0, 900.0)
    fits = [
        fit(1, "a", "affine", 5.0, 1.0, 9), fit(1, "b", "affine", 5.2, 1.0, 6), fit(1, "c", "affine", 50.0, 1.0, 4), fit(1, "d", "offset_only", 50.0, 1.0, 9),
        fit(2, "a", "affine", 5.0, 1.0, 9), fit(2, "b", "affine", 5.2, 1.0, 6), fit(2, "c", "affine", 5.7, 1.0, 5),
        fit(3, "a", "affine", 5.0, 1.0, 9), fit(4, "a", "unavailable", None, None, 0, None), fit(5, "z", "affine", 5.0, 1.0, 9), fit(5, "y", "affine", 5.0, 1.0011, 9),
    ]
    spans = spark.createDataFrame([(k, 100.0) for k in range(1, 7)], "rec long, middle double")
    got = {x.rec: (x.feature, x.agreement, x.status) for x in envelopes.graded_maps(spark.createDataFrame(fits, envelopes.FIT), spans).collect()}
    assert got == {1: ("a", True, "affine"), 2: ("a", False, "affine_review"), 3: ("a", False, "affine_review"), 4: (None, False, "unavailable"), 5: ("y", False, "affine_review"), 6: (None, False, "unavailable")}


def test_repairs_look_for_chunks_once(spark):
    import random

    from chronoweave.operators import content

    draw, rows, copies = random.Random(9), [], []
    for rec in range(6):
        raw = [draw.randrange(2 + rec) for _ in range(90)]
        at = [draw.randrange(80) for _ in range(14)]
        part = [v for a in at for v in raw[a : a + 5]] + [7.5] * 5 + raw[:3]
        rows += [(rec, k, float(v)) for k, v in enumerate(raw)]
        copies += [(rec, k, float(v)) for k, v in enumerate(part)]
    frame = lambda x: spark.createDataFrame(x, "rec long, seq long, value double")
    first = spark.createDataFrame([(k, 10.0 * k) for k in range(4)], "rec long, expected double")
    found = content.matched_chunks(frame(rows), frame(copies), size=5, radius=9, expected=first)
    want = []
    for rec in range(6):
        raw, part = ([v for r, _, v in x if r == rec] for x in (rows, copies))
        last = None
        for c in range(0, len(part), 5):
            piece = part[c : c + 5]
            at = [k for k in range(len(raw) - len(piece) + 1) if raw[k : k + len(piece)] == piece]
            goal = (10 * rec if rec < 4 else None) if last is None else last + 5
            if last is not None:
                at = [k for k in at if k == goal] or [k for k in at if abs(k - goal) <= 9] or at
            if at:
                last = at[0] if goal is None else min(at, key=lambda k: (abs(k - goal), k))  # noqa: B023
            want.append((rec, c // 5, last if at else None, len(at)))
    assert sorted(tuple(x) for x in found.select("rec", "chunk", "start", "candidates").collect()) == want
    told = alignment.repair_summary(found, 5)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1
    for x in told.collect():
        mine = [w for w in want if w[0] == x.rec]
        starts = sorted({w[2] for w in mine if w[2] is not None})
        matched = sum(w[2] is not None for w in mine)
        gaps = sum(max(round((b - a) / 5) - 1, 0) for a, b in zip(starts, starts[1:], strict=False))
        assert (x.chunks, x.matched, x.ambiguous, x.duplicates, x.missing) == (len(mine), matched, sum(w[2] is not None and w[3] > 1 for w in mine), matched - len(starts), gaps)
