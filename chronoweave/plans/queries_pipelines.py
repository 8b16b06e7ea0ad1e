"""Queries of whole pipelines: clock maps from anchors and from signals, chunk repair, reports, metrics, spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alignment, anchors, anonymize, asof, content, epochs, quality, robust, runs
from .base import MODULES, SAMPLES, query, r, samples, table

_MARKS = """marks AS (SELECT 'p' AS project, CAST(o_custkey AS VARCHAR) AS pid, 'V1' AS visit, 'main' AS segment, o_orderkey AS seq,
      CASE WHEN o_orderkey % 2 = 0 THEN 'driver' ELSE 'scene' END AS source, CASE WHEN o_orderkey // 2 % 2 = 0 THEN 'off' ELSE 'on' END AS event,
      CASE WHEN o_orderkey % 9 <> 0 THEN 'accepted' ELSE 'pending' END AS status, ['high', 'high', 'high', 'medium', 'low'][1 + o_orderkey % 5] AS confidence,
      CASE WHEN o_orderkey % 23 <> 0 THEN CASE WHEN o_orderkey // 2 % 2 = 0 THEN 100 ELSE 1100 END + (o_orderkey % 4) * 0.4 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END END AS time, (o_orderkey % 6) * 0.06 AS uncertainty FROM orders)"""


def _marks(spark, sf):
    k = F.col("o_orderkey")
    on, scene = F.floor(k / 2) % 2 == 1, k % 2 == 1
    grades = F.array(*[F.lit(x) for x in ("high", "high", "high", "medium", "low")])
    time = F.when(on, 1100).otherwise(100) + (k % 4) * 0.4 + F.when(scene, 5).otherwise(0)
    return table(spark, sf, "orders").select(
        F.lit("p").alias("project"), F.col("o_custkey").cast("string").alias("pid"), F.lit("V1").alias("visit"), F.lit("main").alias("segment"), k.alias("seq"),
        F.when(scene, "scene").otherwise("driver").alias("source"), F.when(on, "on").otherwise("off").alias("event"), F.when(k % 9 != 0, "accepted").otherwise("pending").alias("status"),
        F.get(grades, (k % 5).cast("int")).alias("confidence"), F.when(k % 23 != 0, time.cast("double")).alias("time"), ((k % 6) * 0.06).alias("uncertainty"),
    )


def _last(source: str, event: str) -> str:
    return f"arg_max({{'t': time, 'u': uncertainty, 'c': confidence}}, seq) FILTER (status = 'accepted' AND source = '{source}' AND event = '{event}') AS {source[0]}{event}"


@query("g2_anchor_maps", f"""WITH {_MARKS}, a AS (SELECT pid, {", ".join(_last(s, e) for s in ("driver", "scene") for e in ("off", "on"))} FROM marks GROUP BY pid),
    b AS (SELECT *, coalesce(doff IS NOT NULL AND doff.t IS NULL, false) OR coalesce(don IS NOT NULL AND don.t IS NULL, false) OR coalesce(soff IS NOT NULL AND soff.t IS NULL, false) OR coalesce(son IS NOT NULL AND son.t IS NULL, false) AS broken,
      coalesce(doff.t IS NOT NULL AND soff.t IS NOT NULL, false) AS poff, coalesce(don.t IS NOT NULL AND son.t IS NOT NULL, false) AS pon FROM a),
    c AS (SELECT *, CAST(poff AS INT) + CAST(pon AS INT) AS anchors, poff AND pon AND don.t > doff.t AND son.t > soff.t AS straight,
      CASE WHEN poff THEN soff.t - doff.t ELSE son.t - don.t END AS one, CASE WHEN poff THEN soff.u + 1.005 * doff.u ELSE son.u + 1.005 * don.u END AS one_u FROM b),
    d AS (SELECT *, CASE WHEN anchors = 1 THEN 1.0 WHEN straight THEN (son.t - soff.t) / (don.t - doff.t) END AS scale FROM c),
    e AS (SELECT *, CASE WHEN anchors = 1 THEN one WHEN straight THEN soff.t - scale * doff.t END AS intercept, CASE WHEN straight THEN (scale - 1) * 1e6 END AS drift, CASE WHEN straight THEN greatest(soff.u + abs(scale) * doff.u, son.u + abs(scale) * don.u) WHEN anchors = 1 THEN one_u END AS u FROM d),
    f AS (SELECT *, coalesce(broken OR (anchors = 2 AND NOT straight) OR (straight AND (doff.t + doff.u >= don.t - don.u OR soff.t + soff.u >= son.t - son.u OR abs(drift) > 10000)), false) AS invalid,
      coalesce(abs(drift) > 2000, false) OR coalesce(u > 0.5, false) OR coalesce(doff.c = 'low', false) OR coalesce(don.c = 'low', false) OR coalesce(soff.c = 'low', false) OR coalesce(son.c = 'low', false) AS doubts,
      coalesce(doff.c = 'high' AND don.c = 'high' AND soff.c = 'high' AND son.c = 'high' AND abs(drift) <= 500 AND u <= 0.25, false) AS best FROM e),
    g AS (SELECT *, CASE WHEN straight AND invalid THEN 'invalid_affine' WHEN straight AND doubts THEN 'review_affine' WHEN straight THEN 'affine' WHEN anchors = 1 AND invalid THEN 'invalid_offset_only' WHEN anchors = 1 THEN 'offset_only' WHEN invalid THEN 'invalid' ELSE 'unavailable' END AS status FROM f)
    SELECT pid, CAST(anchors AS BIGINT) AS anchors, round(intercept, 6) AS intercept, round(scale, 9) AS scale, round(drift, 3) AS drift_ppm, status, status IN ('affine', 'review_affine', 'offset_only') AS usable,
      CASE WHEN status = 'affine' THEN CASE WHEN best THEN 'A' ELSE 'B' END WHEN status IN ('review_affine', 'offset_only') THEN 'C' ELSE 'D' END AS grade, status NOT IN ('affine', 'unavailable') AS review FROM g""")  # fmt: skip
def g2(spark, sf):
    m = anchors.anchored_maps(_marks(spark, sf))
    return m.select("pid", "anchors", r(F.col("intercept")).alias("intercept"), r(F.col("scale"), 9).alias("scale"), r(F.col("drift_ppm"), 3).alias("drift_ppm"), "status", "usable", "grade", "review")


def _signals(spark, sf):
    """Three signal groups of each recording of 50 embeddings, 64 samples a row, ten a second."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    s = e.select(F.floor(F.col("vec_id") / 50).cast("long").alias("rec"), ((F.col("vec_id") % 50 * 64 + F.col("pos")) / 10.0).alias("t"), F.col("value").cast("double").alias("value"))
    groups = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(f"{g}{k}").alias("channel"), F.lit(w).alias("w")) for g, k, w in (("gaze", 0, 1.0), ("gyro", 0, -2.0), ("pupil", 0, 0.5))])
    return s.withColumn("g", F.explode(groups)).select("rec", "g.grp", "g.channel", "t", (F.col("value") * F.col("g.w")).alias("value"))


_PLANTED = "true_a AS (SELECT DISTINCT vec_id // 50 AS rec FROM embeddings WHERE vec_id // 50 * 50 + 49 <= (SELECT max(vec_id) FROM embeddings))"


@query("g1_windowed_alignment", f"""WITH {_PLANTED} SELECT rec, 3 AS groups, 'good' AS status, '' AS reasons, round(7.5 + rec % 5, 1) AS intercept, true AS drift_found, rec % 3 = 0 AS exact,
      CAST(ceil((319.9 - 60 + 15) / 30) AS INTEGER) AS windows, CAST(ceil((319.9 - 60 + 15) / 30) AS INTEGER) AS good_windows, true AS tight FROM true_a""")  # fmt: skip
def g1(spark, sf):
    """A second recorder with planted offset and drift, found again from the signals (W19, W22 to W32, G1, G3, G4). The
    offset is compared to a tenth of a second, drift to 100 ppm (on noise at ten samples a second the parabola through
    a peak's neighbours is up to 70 ppm off), without drift both are exact; all windows that fit are good."""
    source = _signals(spark, sf)
    full = source.groupBy("rec").agg((F.max("t") >= 319).alias("_full")).where("_full").select("rec")
    source = source.join(full, "rec")
    a, b = 7.5 + F.col("rec") % 5, 1 + (F.col("rec") % 3) * 2e-4
    target = source.withColumn("t", a + b * F.col("t"))
    out = alignment.align(source, target, hz=10.0)
    fit_a, fit_b = F.abs(F.col("intercept") - a), F.abs(F.col("scale") - b)
    whole = [F.col(c).cast("int").alias(c) for c in ("groups", "windows", "good_windows")]
    return out.select("rec", *whole, "status", "reasons", r(F.col("intercept"), 1).alias("intercept"), (fit_b < 1e-4).alias("drift_found"), ((fit_a < 1e-6) & (fit_b < 1e-9)).alias("exact"), (F.col("residual_p95") < 0.02).alias("tight"))


@query("g5_chunk_repair", """WITH n AS (SELECT user_id AS rec, (count(*) - 7) // 5 AS n FROM events GROUP BY 1 HAVING count(*) >= 12), c AS (SELECT rec, unnest(range(0, n)) AS c FROM n),
    d AS (SELECT rec, c, rec % 3 = 0 AND c % 11 = 6 AS bad, CASE WHEN rec % 5 = 1 AND c % 5 = 2 THEN 2 ELSE 1 END AS reps FROM c WHERE NOT (rec % 4 = 1 AND c % 7 = 3)),
    g AS (SELECT rec, CAST(sum(reps) AS BIGINT) AS chunks, CAST(coalesce(sum(reps) FILTER (NOT bad), 0) AS BIGINT) AS matched, CAST(max(CASE WHEN rec % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous, CAST(coalesce(sum(reps - 1) FILTER (NOT bad), 0) AS BIGINT) AS duplicates,
      CAST(coalesce(max(c) FILTER (NOT bad) - min(c) FILTER (NOT bad) + 1 - count(*) FILTER (NOT bad), 0) AS BIGINT) AS missing FROM d GROUP BY rec)
    SELECT *, matched / chunks::DOUBLE AS ratio, CASE WHEN matched = chunks AND ambiguous + duplicates + missing = 0 THEN 'A' WHEN matched / chunks::DOUBLE >= 0.99 THEN 'B' WHEN matched / chunks::DOUBLE >= 0.95 THEN 'C' ELSE 'D' END AS grade FROM g""")  # fmt: skip
def g5(spark, sf):
    """Chunks of a damaged copy found in the raw sequence (J14, A25, A26, G5): some chunks are gone, some stand twice,
    some have values that the raw one hasn't, and where the raw one repeats its first chunk at its end, that is ambiguous."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    raw = table(spark, sf, "events").select(F.col("user_id").alias("rec"), k.cast("long").alias("seq"), "value")
    rec, c = F.col("rec"), F.col("c")
    whole = raw.withColumn("n", F.floor((F.count("*").over(Window.partitionBy("rec")) - 7) / 5)).where("seq >= 7")
    whole = whole.withColumn("c", F.floor((F.col("seq") - 7) / 5)).where("c < n AND NOT (rec % 4 = 1 AND c % 7 = 3)")
    twice = F.when((rec % 5 == 1) & (c % 5 == 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copy = whole.withColumn("rep", F.explode(twice)).withColumn("value", F.when((rec % 3 == 0) & (c % 11 == 6), F.col("value") + 0.005).otherwise(F.col("value")))
    copy = copy.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("c", "rep", "seq")).cast("long").alias("seq"), "value")
    again = raw.where("rec % 2 = 0 AND seq BETWEEN 7 AND 11").select("rec", (F.col("seq") + 1_000_000_000).alias("seq"), "value")
    found = content.matched_chunks(raw.unionByName(again), copy, size=5, radius=50)
    return alignment.repair_summary(found, 5).where("chunks > 0")


@query("w31_clock_jump", f"""WITH {SAMPLES}, d AS (SELECT rec, seq, value - quantile_cont(value, 0.5) OVER (PARTITION BY rec) AS e FROM samples WHERE value IS NOT NULL), m AS (SELECT rec, median(abs(e)) AS mad FROM d GROUP BY rec),
    k AS (SELECT d.rec, seq, e FROM d JOIN m USING (rec) WHERE abs(e) <= greatest(0.2, 4 * 1.4826 * mad)), j AS (SELECT rec, abs(e - lag(e) OVER (PARTITION BY rec ORDER BY seq)) AS j FROM k)
    SELECT rec, round(max(j), 6) AS jump FROM j GROUP BY rec""")  # fmt: skip
def w31(spark, sf):
    """The largest step between neighbours, without values that stand off."""
    s = samples(spark, sf).where("value IS NOT NULL").select("rec", "seq", "value")
    scale = robust.robust_scale(s, ["rec"], "value")
    kept = s.join(scale, "rec").withColumn("e", F.col("value") - F.col("median")).where(F.abs("e") <= F.greatest(F.lit(0.2), 4 * 1.4826 * F.col("mad")))
    return kept.withColumn("j", F.abs(F.col("e") - F.lag("e").over(Window.partitionBy("rec").orderBy("seq")))).groupBy("rec").agg(r(F.max("j")).alias("jump"))


_COVERED = f"""{SAMPLES}, spans AS (SELECT rec, min(t) + 86400 AS lo, max(t) - 86400 AS hi FROM samples GROUP BY rec),
    c AS (SELECT rec, count(*) AS total, count(value) AS finite, count(*) FILTER (value IS NOT NULL AND t BETWEEN lo AND hi) AS supported FROM samples JOIN spans USING (rec) GROUP BY rec)"""


@query("g9_user_summary", f"""WITH {_COVERED}, p AS (SELECT *, 100.0 * supported / total AS share FROM c)
    SELECT rec, CASE WHEN finite = 0 THEN 'unavailable' WHEN finite = total THEN 'complete' ELSE 'partial' END AS availability, CASE WHEN share > 0 AND share < 0.1 THEN '<0.1%' ELSE printf('%.0f', floor(share)) || '%' END AS aligned,
      array_to_string(list_filter([CASE WHEN finite < total THEN 'samples missing' END, CASE WHEN supported < finite THEN 'extrapolated at the ends' END], lambda x: x IS NOT NULL), '; ') AS notes FROM p""")  # fmt: skip
def g9(spark, sf):
    """Availability, aligned share and notes for readers."""
    s = samples(spark, sf).withColumn("known", F.when(F.col("value").isNotNull(), F.col("t")))
    span = s.groupBy("rec").agg((F.min("t") + 86400).alias("lo"), (F.max("t") - 86400).alias("hi"))
    c = quality.coverage(s.join(span, "rec"), ["rec"], "known", F.col("lo"), F.col("hi"))
    share = 100.0 * F.col("supported") / F.col("total")
    there = S.cascade((F.col("finite") == 0, "unavailable"), (F.col("finite") == F.col("total"), "complete"), otherwise="partial")
    aligned = F.when((share > 0) & (share < 0.1), "<0.1%").otherwise(F.concat(F.floor(share).cast("string"), F.lit("%")))
    return c.select("rec", there.alias("availability"), aligned.alias("aligned"), S.reasons(F.when(F.col("finite") < F.col("total"), "samples missing"), F.when(F.col("supported") < F.col("finite"), "extrapolated at the ends")).alias("notes"))


@query("g10_data_quality", f"""WITH {SAMPLES}, n AS (SELECT label AS modality, count(*) FILTER (module < 3) AS scope, count(*) FILTER (module < 3 AND value > 0) AS valid, count(*) FILTER (module < 3 AND value > 100) AS strong FROM samples GROUP BY label)
    SELECT modality, metric, CASE WHEN scope = 0 THEN 'unavailable' WHEN k = scope THEN 'complete' ELSE 'partial' END AS status, round(100.0 * k / scope, 6) AS percentage
    FROM (SELECT modality, scope, 'valid' AS metric, valid AS k FROM n UNION ALL SELECT modality, scope, 'strong', strong FROM n)""")  # fmt: skip
def g10(spark, sf):
    """Quality shares per modality and metric inside the modules, one scan, unpivoted."""
    inside = F.col("module") < 3
    n = samples(spark, sf).groupBy(F.col("label").alias("modality")).agg(F.count_if(inside).alias("scope"), F.count_if(inside & (F.col("value") > 0)).alias("valid"), F.count_if(inside & (F.col("value") > 100)).alias("strong"))
    long = n.unpivot(["modality", "scope"], ["valid", "strong"], "metric", "k")
    status = S.cascade((F.col("scope") == 0, "unavailable"), (F.col("k") == F.col("scope"), "complete"), otherwise="partial")
    return long.select("modality", "metric", status.alias("status"), r(100.0 * F.col("k") / F.col("scope")).alias("percentage"))


@query("g11_module_metrics", f"""WITH {SAMPLES}, sides AS (SELECT rec, t, seq % 10 AS scenario FROM samples WHERE label = 'signup'), ends AS (SELECT rec, max(t) AS last_t FROM sides GROUP BY rec),
    placed AS (SELECT l.*, CASE WHEN l.t <= e.last_t THEN x.scenario END AS scenario FROM (SELECT * FROM samples WHERE label <> 'signup') l ASOF LEFT JOIN sides x ON l.rec = x.rec AND l.t >= x.t LEFT JOIN ends e ON e.rec = l.rec),
    m AS (SELECT scenario, stddev_samp(value) AS sd, count(*) FILTER (label = 'purchase') AS questions, count(*) FILTER (label = 'purchase' AND value > 100) AS correct FROM placed WHERE scenario IS NOT NULL GROUP BY scenario)
    SELECT x.m AS module, round(sd, 6) AS sd, coalesce(questions, 0) AS questions, round(100.0 * correct / nullif(questions, 0), 6) AS accuracy FROM range(10) AS x(m) LEFT JOIN m ON scenario = x.m""")  # fmt: skip
def g11(spark, sf):
    """Dispersion and answers by module on the fixed dimension."""
    s = samples(spark, sf)
    at = asof.backward(s.where("label <> 'signup'"), s.where("label = 'signup'").select("rec", "t", (F.col("seq") % 10).alias("scenario")), ["rec"], "t", ["scenario"]).where("scenario IS NOT NULL")
    asked = F.col("label") == "purchase"
    m = at.groupBy("scenario").agg(r(F.stddev_samp("value")).alias("sd"), F.count_if(asked).alias("questions"), F.count_if(asked & (F.col("value") > 100)).alias("correct"))
    j = spark.range(len(MODULES)).withColumnRenamed("id", "module").join(m, F.col("module") == F.col("scenario"), "left")
    return j.select("module", "sd", F.coalesce("questions", F.lit(0)).alias("questions"), r(F.try_divide(100.0 * F.col("correct"), F.col("questions"))).alias("accuracy"))


@query("g12_signal_quality", """WITH q AS (SELECT user_id, least(value / 4, 100) AS q FROM events), b AS (SELECT CAST(least(floor(q / 5), 19) AS INTEGER) AS bin, count(*) AS n FROM q WHERE q BETWEEN 0 AND 100 GROUP BY 1) SELECT bin, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM b""")
def g12(spark, sf):
    q = table(spark, sf, "events").select(F.least(F.col("value") / 4, F.lit(100.0)).alias("q"))
    b = robust.histogram(q, [], "q", 0, 100, 5)
    total = b.agg(F.sum("n").alias("total"))
    return b.join(F.broadcast(total)).select("bin", "n", r(100.0 * F.col("n") / F.col("total")).alias("share"))  # twenty bins and one row


def _markers(s):
    """Six markers of each recording; the first and the last lie too near its ends."""
    return s.select("rec").distinct().select("rec", F.lit("easy").alias("marker"), F.explode(F.array(*[F.lit(x) for x in (1.0, 50.0, 100.0, 150.0, 200.0, 319.0)])).alias("at"))


@query("g13_epoch_power", """WITH m AS (SELECT DISTINCT vec_id // 50 AS rec FROM embeddings WHERE vec_id // 50 * 50 + 49 <= (SELECT max(vec_id) FROM embeddings)), f AS (SELECT k / 0.8 AS freq FROM range(0, 5) AS x(k) WHERE k / 0.8 BETWEEN 2 AND 4)
    SELECT rec, 'easy' AS marker, round(freq, 6) AS freq, 4 AS epochs FROM m, f""")  # fmt: skip
def g13(spark, sf):
    """Filtered epochs around markers and their mean spectra (J15, W33 to W35, A22): which cells there are."""
    s = _signals(spark, sf).where("grp = 'gaze'").select("rec", "channel", "t", "value")
    full = s.groupBy("rec").agg((F.max("t") >= 319).alias("_full")).where("_full").select("rec")
    e = epochs.epochs(s.join(full, "rec"), _markers(s.join(full, "rec")), -1.0, 5.0, 10.0, band=(0.5, 4.5), notch=None)
    p = epochs.mean_power(epochs.accepted(e, 1e9, 0.0), 10.0, window_s=0.8, step_s=0.1, low=2.0, high=4.0)
    return p.groupBy("rec", "marker", r(F.col("freq")).alias("freq")).agg(F.max("n").cast("int").alias("epochs"))


@query("g13_epoch_spectra", """WITH v AS (SELECT vec_id // 50 AS rec, vec_id % 50 * 64 + unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id // 50 * 50 + 49 <= (SELECT max(vec_id) FROM embeddings)),
    w AS (SELECT m, s, j, q, 0.5 - 0.5 * cos(2 * pi() * j / 7) AS h FROM (VALUES (50), (100), (150), (200)) AS a(m), range(0, 54) AS b(s), range(0, 8) AS c(j), range(2, 4) AS d(q)),
    f AS (SELECT rec, m, s, q, sum(v * h * cos(2 * pi() * q * j / 8)) AS re, sum(v * h * sin(2 * pi() * q * j / 8)) AS im, sum(h * h) AS hh FROM v JOIN w ON k = (m - 1) * 10 + s + j GROUP BY ALL)
    SELECT rec, 'easy' AS marker, q * 1.25::DOUBLE AS freq, round((s + 4) / 10.0::DOUBLE, 6) AS t, round(avg((re * re + im * im) / hh / 10), 6) AS power, count(*) AS n FROM f GROUP BY rec, q, s""")  # fmt: skip
def g13_spectra(spark, sf):
    """Mean spectra of unfiltered epochs, power by power."""
    s = _signals(spark, sf).where("grp = 'gaze'").select("rec", "channel", "t", "value")
    p = epochs.mean_power(epochs.accepted(epochs.epochs(s, _markers(s), -1.0, 5.0, 10.0), 1e9, 0.0), 10.0, window_s=0.8, step_s=0.1, low=2.0, high=4.0)
    return p.join(s.groupBy("rec").agg(F.max("t").alias("end")).where("end >= 319"), "rec").select("rec", "marker", "freq", r(F.col("t")).alias("t"), r(F.col("power")).alias("power"), "n")


@query("g14_anonymised_plan", """SELECT s_suppkey, 'R' || s_nationkey || '_' || CASE WHEN s_acctbal < 0 THEN 'eye' ELSE 'video' END || CASE WHEN count(*) OVER w > 1 THEN '_' || row_number() OVER (PARTITION BY s_nationkey, s_acctbal < 0 ORDER BY lower(s_name), s_name) ELSE '' END || '.csv' AS target FROM supplier WINDOW w AS (PARTITION BY s_nationkey, s_acctbal < 0)""")
def g14(spark, sf):
    s = table(spark, sf, "supplier")
    f = s.select("s_suppkey", F.col("s_nationkey").alias("record"), F.when(F.col("s_acctbal") < 0, "eye").otherwise("video").alias("label"), F.col("s_name").alias("path"), F.lit(".csv").alias("ext"), F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("random_id"))
    return anonymize.canonical_names(f).select("s_suppkey", "target")


@query("w9_closures", f"""WITH {SAMPLES}, v AS (SELECT rec, seq, t, value, CAST(floor(t / 2592000) AS BIGINT) AS scenario, value IS NOT NULL AS ok FROM samples),
    g AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR ok <> lag(ok) OVER w OR scenario <> lag(scenario) OVER w THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY rec ORDER BY t, seq)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM g),
    k AS (SELECT *, coalesce(last_value(CASE WHEN value < 60 THEN 1 WHEN value > 90 THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec, run ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS after FROM h WHERE ok),
    l AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY rec, run ORDER BY t, seq), 0) AS before FROM k),
    e AS (SELECT *, sum(CASE WHEN after = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rec, run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS ev FROM l),
    c AS (SELECT rec, run, ev, any_value(scenario) AS scenario, min(t) AS a, max(t) AS b FROM e WHERE value < 60 GROUP BY rec, run, ev),
    o AS (SELECT c.*, (SELECT max(t) FROM e WHERE e.rec = c.rec AND e.run = c.run AND value > 90 AND e.t < a) AS lo, (SELECT min(t) FROM e WHERE e.rec = c.rec AND e.run = c.run AND value > 90 AND e.t > b) AS hi FROM c)
    SELECT rec, CAST(run AS BIGINT) AS run, scenario, round(((b - a) + (hi - lo)) / 2, 3) AS duration FROM o WHERE ((b - a) + (hi - lo)) / 2 BETWEEN 10000 AND 2000000""")  # fmt: skip
def w9(spark, sf):
    """Closures inside contiguous valid stretches of one scenario, by the middle of their inner and outer duration."""
    s = samples(spark, sf).select("rec", "seq", "t", "value", F.floor(F.col("t") / 2592000).alias("scenario"), F.col("value").isNotNull().alias("ok"))
    s = runs.with_run(s, ["rec"], ["t", "seq"], "ok", "scenario").where("ok")
    c = runs.closures(s, ["rec", "run"], ["t", "seq"], "t", F.col("value") < 60, F.col("value") > 90, 10_000, 2_000_000, ["scenario"])
    return c.select("rec", "run", "scenario", r(F.col("duration"), 3).alias("duration"))
