"""Queries of single rules through the functions that the engine itself runs: decisions between maps, envelopes, filters,
robust lines, window centres, priors, plans of exports, required numbers and names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alignment, envelopes, epochs, kernels, quality, release
from .base import SAMPLES, query, r, samples, table

_FITS = """facts AS (SELECT user_id AS rec, avg(value) AS a, count(*) AS n FROM events GROUP BY user_id),
    f AS (SELECT rec, ['good', 'review', 'invalid', NULL][1 + rec % 4] AS alls, ['good', 'review', 'invalid', NULL][1 + rec // 4 % 4] AS imus, ['good', 'review', 'invalid', NULL][1 + rec // 16 % 4] AS eyes,
      a, a + rec % 3 * 0.4 AS eye_a, 1.0::DOUBLE AS b, 1 + rec % 5 * 6e-4 AS eye_b, rec % 13 = 0 AS broken, rec % 2 = 0 AS legacy FROM facts),
    g AS (SELECT *, alls IN ('good', 'review') AS ua, imus IN ('good', 'review') AS ui, eyes IN ('good', 'review') AS ue, coalesce(imus, '') = 'good' AS gi, coalesce(eyes, '') = 'good' AS ge,
      coalesce(imus IN ('good', 'review') AND eyes IN ('good', 'review') AND (abs((a + (b - 1) * 100) - (eye_a + (eye_b - 1) * 100)) > 0.5 OR abs(b - eye_b) * 1e6 > 2000), false) AS apart FROM f),
    s AS (SELECT *, prefer, apart AND NOT (prefer AND gi <> ge) AS conflict FROM g, (VALUES (false), (true)) AS p(prefer)),
    c AS (SELECT *, CASE WHEN conflict THEN 'none' WHEN prefer AND apart AND gi AND NOT ge THEN 'imu' WHEN prefer AND apart AND ge AND NOT gi THEN 'eye' WHEN ua THEN 'all' WHEN ui THEN 'imu' WHEN ue THEN 'eye' WHEN legacy THEN 'legacy' ELSE 'none' END AS source FROM s),
    d AS (SELECT *, CASE source WHEN 'all' THEN alls WHEN 'imu' THEN imus WHEN 'eye' THEN eyes END AS own FROM c),
    e AS (SELECT *, CASE WHEN broken THEN 'invalid_timestamps' WHEN conflict THEN 'conflict_review' WHEN source = 'legacy' THEN 'legacy_fallback' WHEN own = 'good' THEN 'content_affine' WHEN own = 'review' THEN 'content_review' ELSE 'unavailable' END AS status FROM d)"""


@query("g3_family_decision", f"""WITH {_FITS} SELECT rec, prefer, status, status IN ('content_affine', 'content_review', 'legacy_fallback') AS usable,
    CASE WHEN status = 'content_affine' THEN CASE WHEN source = 'all' AND gi AND ge THEN 'A' ELSE 'B' END WHEN status IN ('content_review', 'legacy_fallback') THEN 'C' ELSE 'D' END AS grade, source,
    round(CASE WHEN status IN ('content_affine', 'content_review', 'legacy_fallback') THEN CASE source WHEN 'eye' THEN eye_a WHEN 'legacy' THEN a + 1 ELSE a END END, 6) AS intercept FROM e""")  # fmt: skip
def g3(spark, sf):
    """Maps of all groups and of two families that agree, differ, or are missing; with and without trust in a single good
    one; broken clocks and older maps (G1, G3)."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("rec")).agg(F.avg("value").alias("a"))
    rec, states = F.col("rec"), F.array(F.lit("good"), F.lit("review"), F.lit("invalid"), F.lit(None).cast("string"))

    def fit(shift, a, b):
        status = F.get(states, (F.floor(rec / shift) % 4).cast("int"))
        f = e.select("rec", status.alias("status"), a.alias("intercept"), b.alias("scale"), F.lit(0.0).alias("raw_drift_ppm"), F.lit(9).cast("long").alias("good_windows"), F.lit(0.01).alias("residual_p95"), F.lit("").alias("reasons"))
        return f.where("status IS NOT NULL")

    one = F.lit(1.0)
    fits = {"all": fit(1, F.col("a"), one), "imu": fit(4, F.col("a"), one), "eye": fit(16, F.col("a") + rec % 3 * 0.4, 1 + rec % 5 * 6e-4)}
    audits = e.select("rec", F.lit(100.0).alias("middle"), (rec % 13 == 0).alias("broken"))
    # older maps of every second recording; the others' are under names that no recording has
    legacy = e.select(F.when(rec % 2 == 0, rec).otherwise(-1 - rec).alias("rec"), (F.col("a") + 1).alias("intercept"), one.alias("scale"))
    both = [alignment.decided(fits, audits, prefer_good=p, legacy=legacy).withColumn("prefer", F.lit(p)) for p in (False, True)]
    return both[0].unionByName(both[1]).select("rec", "prefer", "status", "usable", "grade", "source", r(F.col("intercept")).alias("intercept"))


@query("g4_envelope_maps", """SELECT DISTINCT vec_id // 50 AS rec, 'offset_only' AS status, true AS usable, 'C' AS grade, 'same' AS feature, round(3 + vec_id // 50 % 4 * 0.5, 1) AS intercept FROM embeddings WHERE vec_id // 50 * 50 + 49 <= (SELECT max(vec_id) FROM embeddings)""")
def g4(spark, sf):
    """A recorder whose signal is another's by its activity alone, found by envelopes; a feature of noise isn't (W15, W27,
    W29, G4). Recordings are too short for a drift."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("rec"), "vec_id", "embedding").where("size(embedding) > 0")
    at = lambda pos: (F.col("vec_id") % 50 * 64 + pos) / 10.0
    full = e.groupBy("rec").agg(F.max(at(F.size("embedding") - 1)).alias("_end")).where("_end >= 319").select("rec")
    s = e.join(full, "rec").select("rec", "vec_id", F.posexplode("embedding").alias("pos", "value")).select("rec", at(F.col("pos")).alias("t"), F.col("value").cast("double").alias("value"))
    offset = 3 + F.col("rec") % 4 * 0.5
    target = s.select("rec", F.lit("same").alias("feature"), (F.col("t") + offset).alias("t"), (-3 * F.col("value")).alias("value"))
    noise = s.select("rec", F.lit("noise").alias("feature"), (F.col("t") + offset).alias("t"), (F.xxhash64("rec", "t") % 1000 / 1000.0).alias("value"))
    priors = full.select("rec", F.lit(4.0).alias("prior"))
    m = envelopes.envelope_maps(s, target.unionByName(noise), priors, 10.0, 10.0, length=100.0, step=50.0, coarse=5.0)
    return m.select("rec", "status", "usable", "grade", "feature", r(F.col("intercept"), 1).alias("intercept"))


def _gain_sql(kind: str, f: float, cut: float, hz: float = 10.0) -> str:
    """Squared gain of a Butterworth section at a frequency, from its definition."""
    w, c = 2 * np.pi * f / hz, 2 * np.pi * cut / hz
    ratio = np.tan(w / 2) / np.tan(c / 2)
    share = 1 / (1 + ratio**4) if kind == "low" else ratio**4 / (1 + ratio**4)
    return repr(float(share))


_SLOW, _FAST = (f"{_gain_sql('high', f, 0.5)} * {_gain_sql('low', f, 4.5)}" for f in (1.0, 2.5))


@query("w34_filtered_epochs", f"""WITH a AS (SELECT user_id AS rec, avg(value) AS amp FROM events GROUP BY user_id), m AS (SELECT unnest([10.0, 25.0, 40.0]::DOUBLE[]) AS marked), k AS (SELECT unnest(range(0, 61)) AS k)
    SELECT rec, marked AS "at", k, round(amp * ({_SLOW} * sin(2 * pi() * (marked - 1 + k / 10)) + 0.5 * {_FAST} * sin(5 * pi() * (marked - 1 + k / 10))), 4) + 0.0 AS value FROM a, m, k""")  # fmt: skip
def w34(spark, sf):
    """Two tones through the zero-phase band-pass: every value of every epoch is what the filter's definition makes of it."""
    a = table(spark, sf, "events").groupBy(F.col("user_id").alias("rec")).agg(F.avg("value").alias("amp"))
    t = F.col("i") / 10.0
    s = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(500)))).select("rec", F.lit("c").alias("channel"), t.alias("t"), (F.col("amp") * (F.sin(2 * np.pi * t) + 0.5 * F.sin(5 * np.pi * t))).alias("value"))
    markers = a.select("rec", F.lit("m").alias("marker"), F.explode(F.array(*map(F.lit, (10.0, 25.0, 40.0, 49.0)))).alias("at"))
    e = epochs.epochs(s, markers, -1.0, 5.0, 10.0, band=(0.5, 4.5))
    return e.select("rec", "at", F.posexplode("values").alias("k", "value")).select("rec", "at", F.col("k").cast("long").alias("k"), (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query("w28_robust_lines", f"""WITH {SAMPLES}, k AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY rec) AS n FROM samples),
    g AS (SELECT rec, any_value(n) AS n, count(*) FILTER (k % 7 <> 3) AS inliers FROM k GROUP BY rec)
    SELECT rec, 'trimmed' AS line, 2.5 + rec % 3 AS intercept, round(1 + rec % 4 * 1e-4, 6) AS scale, inliers FROM g WHERE n >= 30
    UNION ALL SELECT rec, 'capped', 2.5 + rec % 3, 1.0, inliers FROM g WHERE n >= 30 UNION ALL SELECT rec, 'short', NULL, NULL, n FROM g WHERE n < 30""")  # fmt: skip
def w28(spark, sf):
    """The line that alignments fit, through planted points of which every seventh is wrong, with and without a cap of
    the drift (W28). Recordings of under 30 points are told."""
    s = samples(spark, sf).select("rec", "seq")

    def run(key, g):
        k, rec, rows = np.arange(len(g)), key[0], []
        x, wrong = 30.0 * k, np.where(k % 7 == 3, 5.0 + k % 2, 0.0)
        for name, drift, cap in (("trimmed", rec % 4 * 1e-4, None), ("capped", 0.0, 50.0)) if len(g) >= 30 else ():
            line = kernels.robust_line(x, 2.5 + rec % 3 + drift * x + wrong, most_ppm=cap)
            rows.append((rec, name, round(line["intercept"], 6) + 0.0, round(line["scale"], 6), line["inliers"]))
        return pd.DataFrame(rows or [(rec, "short", None, None, len(g))], columns=["rec", "line", "intercept", "scale", "inliers"])

    return s.groupBy("rec").applyInPandas(run, "rec long, line string, intercept double, scale double, inliers long")


@query("w19_window_centres", f"""WITH {SAMPLES}, s AS (SELECT rec, floor(min(t)) AS a, floor(max(t)) AS b FROM samples GROUP BY rec)
    SELECT rec, k, a + 216000 + k * 216000.0 AS centre, 432000.0 AS length FROM s, unnest(range(0, CAST(ceil((b - a - 432000 + 108000) / 216000) AS BIGINT))) AS u(k) WHERE b - a > 432000
    UNION ALL SELECT rec, 0, (a + b) / 2, b - a FROM s WHERE b > a AND b - a <= 432000""")  # fmt: skip
def w19(spark, sf):
    """The centres that alignments walk through, by the function that they call."""
    spans = samples(spark, sf).groupBy("rec").agg(F.floor(F.min("t")).cast("double").alias("a"), F.floor(F.max("t")).cast("double").alias("b"))

    def run(batches):
        for pdf in batches:
            rows = [(s.rec, k, c, length) for s in pdf.itertuples() for centres, length in [kernels.window_centres(s.a, s.b, 432_000.0, 216_000.0)] for k, c in enumerate(centres)]
            yield pd.DataFrame(rows, columns=["rec", "k", "centre", "length"])

    return spans.mapInPandas(run, "rec long, k long, centre double, length double")


@query("t2_merged_priors", """WITH l AS (SELECT user_id AS rec, list(round(value / 10, 1) ORDER BY event_id) AS l FROM events GROUP BY user_id),
    k AS (SELECT rec, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda y: abs(y - x[1]) <= 0.25)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l)
    SELECT rec, unnest(kept) AS prior, unnest(range(1, len(kept) + 1)) AS rank FROM k""")  # fmt: skip
def t2(spark, sf):
    """Priors in order, without those near an earlier one, eight at most."""
    p = table(spark, sf, "events").select(F.col("user_id").alias("rec"), F.round(F.col("value") / 10, 1).alias("prior"), F.col("event_id").alias("rank"))
    return alignment.merged_priors(p)


_RAW = "CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN ' 1e3 ' WHEN 2 THEN '' WHEN 3 THEN 'n/a' WHEN 4 THEN 'NaN' WHEN 5 THEN '-Infinity' END"


@query("f10_required_numbers", f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ready' WHEN 1 THEN 'ready' WHEN 2 THEN 'missing' WHEN 3 THEN 'not a number' WHEN 4 THEN 'not finite' WHEN 5 THEN 'not finite' ELSE 'missing' END AS status,
    CASE event_id % 7 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN 1000.0::DOUBLE END AS x FROM events""")  # fmt: skip
def f10(spark, sf):
    """Required numbers: what is wrong with those that aren't, and the value of those that are, by the strict reading."""
    e = table(spark, sf, "events").selectExpr("event_id", f"{_RAW.replace('VARCHAR', 'STRING')} AS raw")
    e = e.withColumn("status", S.number_status(F.col("raw")))
    return e.select("event_id", "status", F.when(F.col("status") == "ready", S.required(F.col("raw"), "event")).alias("x"))


@query("p30_p32_names", """SELECT c_custkey, array_to_string(list_filter(['study', 'T' || c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN 'V' || c_nationkey END, CASE WHEN c_nationkey % 5 > 2 THEN 's' || c_nationkey END], lambda x: x IS NOT NULL), '/') AS name,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS left_area, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS left_code FROM customer""")  # fmt: skip
def p30(spark, sf):
    """Identities as text; features of accepted detections under their side's name."""
    c = table(spark, sf, "customer").withColumnsRenamed({"c_acctbal": "area", "c_nationkey": "code"})
    visit = F.when(F.col("code") % 3 > 0, F.concat(F.lit(" V"), F.col("code").cast("string"))).otherwise(" ")
    segment = F.when(F.col("code") % 5 > 2, F.concat(F.lit("s"), F.col("code").cast("string"))).when(F.col("code") % 5 == 1, "main")
    name = S.identity_text(F.lit("study"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")), visit, segment)
    return c.select("c_custkey", name.alias("name"), *S.accepted_features("left", ["area", "code"], F.col("area") > 0))


@query("s21_video_outputs", """WITH f AS (SELECT o_orderkey AS k, o_custkey % 400 || CASE o_orderkey % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mkv' ELSE '.txt' END AS name FROM orders),
    v AS (SELECT k, split_part(name, '.', 1) || '_landmarks.csv' AS output FROM f WHERE name NOT LIKE '%.txt') SELECT k, output, CASE WHEN count(*) OVER (PARTITION BY output) > 1 THEN 'collision' ELSE 'ready' END AS status FROM v""")  # fmt: skip
def s21(spark, sf):
    """Videos of a listing with their outputs, and which outputs two videos would share."""
    ext = F.when(F.col("o_orderkey") % 3 == 0, ".MP4").when(F.col("o_orderkey") % 3 == 1, ".mkv").otherwise(".txt")
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("/data/x.y/"), (F.col("o_custkey") % 400).cast("string"), ext).alias("path"))
    return quality.outputs(f, [".mp4", "MKV"], "_landmarks.csv").select("k", "output", "status")


@query("f6_eye_sensor", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS valid FROM events WHERE event_type = 'view' GROUP BY event_type")
def f6(spark, sf):
    """Availability counts of the eye sensor's rows alone."""
    return quality.eye_rows(table(spark, sf, "events"), "event_type", "view").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("valid"))


@query("s20_export_plan", """WITH f AS (SELECT o_orderkey AS k, o_custkey % 1000 AS p, o_orderkey % 4 AS kind, 'T' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS pid FROM orders),
    g AS (SELECT *, 'R' || p AS id, CASE kind WHEN 0 THEN 'ET' WHEN 1 THEN 'ET' WHEN 2 THEN 'IDUN' ELSE 'SILAB' END AS modality, CASE kind WHEN 0 THEN 'eyeball_video' WHEN 1 THEN 'et' WHEN 2 THEN 'eeg' ELSE 'silab' END AS label FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY p, kind ORDER BY CAST(k AS VARCHAR)) AS i FROM g)
    SELECT k, id || '/' || modality || '/' || id || '_VX_' || label || CASE WHEN kind = 2 THEN '_' || i WHEN i > 1 THEN '_' || (i - 1) ELSE '' END || CASE kind WHEN 0 THEN '.mp4' WHEN 1 THEN '.tsv' WHEN 2 THEN '.csv' ELSE '.asc' END AS target,
      CASE kind WHEN 0 THEN 'copy' ELSE 'text' END AS action, CASE WHEN p % 7 = 0 THEN 'excluded' ELSE 'ready' END AS status FROM n WHERE p % 11 <> 0
    UNION ALL SELECT k, NULL, CASE kind WHEN 0 THEN 'copy' ELSE 'text' END, CASE WHEN p % 7 = 0 THEN 'excluded' ELSE 'no id' END FROM n WHERE p % 11 = 0""")  # fmt: skip
def s20(spark, sf):
    """The plan of an anonymised export over a listing of files: names, numbers, actions, exclusions, visits without an
    id (S20, P17, P19, G14)."""
    o = table(spark, sf, "orders")
    pid = F.concat(F.lit("T"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    kind = F.col("o_orderkey") % 4
    folder = F.when(kind <= 1, "ET").when(kind == 2, "IDUN").otherwise("SILAB")
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(kind == 0, "-v.mp4").when(kind == 1, "-t.tsv").when(kind == 2, "-EEG.csv").otherwise("-s.asc"))
    path = F.concat(pid, F.lit("_V1/"), folder, F.lit("/"), name)
    files = o.select(path.alias("source"), path.alias("relative"), F.lit(1).alias("size"))
    people = o.select((F.col("o_custkey") % 1000).alias("p"), F.concat(pid, F.lit("_V1")).alias("key")).distinct()
    ids = people.select("key", F.when(F.col("p") % 11 != 0, F.concat(F.lit("R"), F.col("p").cast("string"))).alias("random_id"))
    plan = release.anonymise_plan(files, ids, people.select(F.when(F.col("p") % 7 == 0, F.col("key")).otherwise("nobody").alias("key")))
    return plan.select(F.regexp_extract("relative", r"/(\d+)-", 1).cast("long").alias("k"), "target", "action", "status")
