"""Queries of filters, projections, validation, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import anonymize, quality, quantiles, robust, trackers
from .base import SAMPLES, query, r, samples, table

# --- scans, listings, filters -------------------------------------------------------------------------------------


@query("s3_gaze_projection", "SELECT vec_id, round(embedding[1], 6) AS x, round(embedding[2], 6) AS y, embedding[65] IS NULL AS beyond FROM embeddings")
def s3(spark, sf):
    """Array elements as columns, null where the array has none."""
    e = table(spark, sf, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k))
    return e.select("vec_id", r(at(0).cast("double")).alias("x"), r(at(1).cast("double")).alias("y"), at(64).isNull().alias("beyond"))


@query("s5_outer_by_time", """WITH a AS (SELECT user_id AS rec, ts, max(value) AS click FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id AS rec, ts, max(value) AS view FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT rec, epoch_us(ts) AS t, CASE WHEN click <= 400 THEN click END AS click, CASE WHEN view <= 400 THEN view END AS view FROM a FULL JOIN b USING (rec, ts)""")  # fmt: skip
def s5(spark, sf):
    """Streams of one recording side by side on their common times; implausible values nulled."""
    e = table(spark, sf, "events")
    side = lambda k: e.where(F.col("event_type") == k).groupBy(F.col("user_id").alias("rec"), "ts").agg(F.max("value").alias(k))
    j = side("click").join(side("view"), ["rec", "ts"], "full")
    return j.select("rec", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), S.below(F.col("click"), 400).alias("click"), S.below(F.col("view"), 400).alias("view"))


@query("s6_longest_stream", """WITH c AS (SELECT user_id AS rec, event_type AS stream, count(*) AS n FROM events GROUP BY ALL)
    SELECT rec, arg_max(stream, (n, stream)) AS stream, max(n) AS n, count(*) > 1 AS several FROM c GROUP BY rec""")  # fmt: skip
def s6(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("rec"), F.col("event_type").alias("stream")).count()
    return c.groupBy("rec").agg(F.max_by("stream", F.struct("count", "stream")).alias("stream"), F.max("count").alias("n"), (F.count("*") > 1).alias("several"))


_PATHS = """files AS (SELECT 'T' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '_V' || (c_nationkey % 3) || '_gaze.csv' AS path FROM customer)"""


def _paths(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("T"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("_V"), (F.col("c_nationkey") % 3).cast("string"), F.lit("_gaze.csv")).alias("path"))


@query("s19_identity", f"WITH {_PATHS} SELECT path, split_part(path, '_', 1) AS pid, regexp_extract(path, '_(V[0-9]+)', 1) AS visit FROM files")
def s19(spark, sf):
    return _paths(spark, sf).select("path", F.split("path", "_")[0].alias("pid"), F.regexp_extract("path", "_(V[0-9]+)", 1).alias("visit"))


_LISTINGS = """a AS (SELECT DISTINCT o_custkey AS pid, o_orderkey % 3 AS visit, o_orderpriority AS path FROM orders), b AS (SELECT DISTINCT user_id AS pid, event_id % 3 AS visit, event_type AS path FROM events)"""


def _listings(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), (F.col("o_orderkey") % 3).alias("visit"), F.col("o_orderpriority").alias("path")).distinct()
    b = table(spark, sf, "events").select(F.col("user_id").alias("pid"), (F.col("event_id") % 3).alias("visit"), F.col("event_type").alias("path")).distinct()
    return a, b


@query("s17_pairing", f"""WITH {_LISTINGS}, ga AS (SELECT pid, visit, count(DISTINCT path) AS n_a, min(path) AS path_a FROM a GROUP BY ALL), gb AS (SELECT pid, visit, count(DISTINCT path) AS n_b, min(path) AS path_b FROM b GROUP BY ALL),
    j AS (SELECT pid, visit, coalesce(n_a, 0) AS n_a, path_a, coalesce(n_b, 0) AS n_b, path_b FROM ga FULL JOIN gb USING (pid, visit))
    SELECT *, CASE WHEN n_a = 1 AND n_b = 1 THEN 'ready' WHEN n_a = 0 THEN 'missing_a' WHEN n_b = 0 THEN 'missing_b' WHEN n_a > 1 THEN 'ambiguous_a' ELSE 'ambiguous_b' END AS status FROM j""")  # fmt: skip
def s17(spark, sf):
    a, b = _listings(spark, sf)
    return quality.pairing(a, b, ["pid", "visit"], "path").select("pid", "visit", "n_a", "path_a", "n_b", "path_b", "status")


@query("f1_f5_filters", """SELECT event_id, value FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, event_type FROM events)
    WHERE user_id IN (1, 2, 3, 5, 8) AND value IS NOT NULL AND value > 0 AND event_type IN ('click', 'view') AND value <= 400""")  # fmt: skip
def f_filters(spark, sf):
    """IN list, finite, positive and confident, outliers, dropped nulls."""
    e = table(spark, sf, "events").where(F.col("user_id").isin(1, 2, 3, 5, 8))
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", S.below(S.confident(S.finite(v), F.col("event_type"), ("click", "view")), 400).alias("value")).na.drop(subset=["value"])


_FLAGS = """words AS (SELECT event_id, ['True', ' yes', '1', 'no', 'FALSE', '0', '', 'maybe', NULL][1 + event_id % 9] AS w FROM events)"""


@query("f8_f9_flags", f"""WITH {_FLAGS} SELECT event_id, CASE WHEN lower(trim(w)) IN ('true', '1', 'yes') THEN 'yes' WHEN lower(trim(w)) IN ('false', '0', 'no') THEN 'no' ELSE 'unknown' END AS flag,
    coalesce(lower(trim(w)) IN ('true', '1', 'yes'), false) AS loose, coalesce(lower(trim(w)) = 'true', false) AS strict, coalesce(trim(w), '') AS text FROM words""")  # fmt: skip
def f8(spark, sf):
    words = F.array(*[F.lit(x) for x in ("True", " yes", "1", "no", "FALSE", "0", "", "maybe", None)])
    e = table(spark, sf, "events").select("event_id", F.get(words, (F.col("event_id") % 9).cast("int")).alias("w"))
    w = F.col("w")
    told = F.when(S.flag(w), "yes").when(~S.flag(w), "no").otherwise("unknown")
    return e.select("event_id", told.alias("flag"), S.truthy(w).alias("loose"), S.truthy(w, S.TRUE_WORDS).alias("strict"), S.text(w).alias("text"))


@query("f10_numbers", """SELECT event_id, round(try_cast(CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 6) AS x FROM events""")
def f10(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "n/a").when(k == 2, "").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", r(S.number(raw)).alias("x"))


@query("f11_f12_predicates", """SELECT c_custkey, lower(trim(' ' || upper(c_mktsegment))) = lower('Building ') AS never, lower(trim(' ' || upper(c_mktsegment) || ' ')) = lower(trim('building')) AS building,
    CASE WHEN lower(c_name) LIKE '%#00%' THEN 'raw' WHEN lower(c_name) LIKE '%9' THEN 'video' ELSE 'other' END AS route FROM customer""")  # fmt: skip
def f11(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.concat(F.lit(" "), F.upper("c_mktsegment"))
    route = F.when(F.lower("c_name").like("%#00%"), "raw").when(F.lower("c_name").like("%9"), "video").otherwise("other")
    return c.select("c_custkey", (F.lower(F.trim(seg)) == F.lower(F.lit("Building "))).alias("never"), S.same_name(F.concat(seg, F.lit(" ")), F.lit("building")).alias("building"), route.alias("route"))


@query("f14_singletons", """SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey HAVING count(*) = 1""")
def f14(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order")).where("n = 1").drop("n")


# --- validation ---------------------------------------------------------------------------------------------------


@query("q1_timestamp_audit", """WITH s AS (SELECT l_suppkey AS rec, l_orderkey * 10 + l_linenumber AS k, l_partkey, l_shipdate FROM lineitem),
    d AS (SELECT rec, epoch_us(l_shipdate) - lag(epoch_us(l_shipdate)) OVER (PARTITION BY rec ORDER BY k, l_partkey, l_shipdate) AS d FROM s)
    SELECT rec, count(*) AS n, count(*) FILTER (d < 0) AS backward, count(*) FILTER (d = 0) AS repeated, max(d) AS longest_step FROM d GROUP BY rec""")  # fmt: skip
def q1(spark, sf):
    """Strictly increasing times, also across chunks (Q1, Q10)."""
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rec"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_partkey", "l_shipdate").alias("seq"), t.alias("t"))
    return quality.timestamp_audit(s, ["rec"], "seq", "t").drop("missing")


@query("q3_continuity", """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem)
    SELECT l_orderkey, count(*) AS n, count(*) FILTER (k - 1 <> l_linenumber - 1) AS misplaced FROM p GROUP BY l_orderkey""")  # fmt: skip
def q3(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("i"))
    return quality.row_continuity(x, ["l_orderkey"], "l_linenumber", "i")


@query("q4_parallel_streams", """WITH a AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN -1 - event_id ELSE event_id END AS seq, ts FROM events),
    b AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN event_id + 1000000000 ELSE event_id END AS seq, CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL 1 SECOND ELSE ts END AS ts2 FROM events)
    SELECT user_id, count(a.seq) AS n_a, count(b.seq) AS n_b, count(*) FILTER (a.seq IS NULL OR b.seq IS NULL OR ts <> ts2) AS unequal FROM a FULL JOIN b USING (user_id, seq) GROUP BY user_id""")  # fmt: skip
def q4(spark, sf):
    """Two streams of the same rows, in each of which some stand at places that the other hasn't."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    a = e.withColumn("seq", F.when(F.col("seq") % 11 == 0, -1 - F.col("seq")).otherwise(F.col("seq")))
    b = e.withColumns({"seq": F.when(F.col("seq") % 17 == 0, F.col("seq") + 1_000_000_000).otherwise(F.col("seq")), "t": F.when(F.col("seq") % 13 == 0, F.col("t") + 1_000_000).otherwise(F.col("t"))})
    return quality.parallel_streams(a, b, ["user_id"], "seq", "t")


@query("q5_duplicates", "SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def q5(spark, sf):
    return quality.duplicates(table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("d")), ["o_custkey", "d"])


_MAPS = f"""{SAMPLES}, maps AS (SELECT rec, 5.0 + rec AS a, 1.0 + rec % 5 * 1e-4 AS b, min(t) + 86400 AS lo, max(t) - 86400 AS hi FROM samples GROUP BY rec)"""


def _maps(spark, sf):
    m = samples(spark, sf).groupBy("rec").agg((F.min("t") + 86400).alias("lo"), (F.max("t") - 86400).alias("hi"))
    return m.select("rec", (5.0 + F.col("rec")).alias("a"), (1.0 + F.col("rec") % 5 * 1e-4).alias("b"), "lo", "hi")


@query("a7_coverage", f"""WITH {_MAPS}, c AS (SELECT s.rec, label, count(*) AS total, count(value) AS finite, count(*) FILTER (value IS NOT NULL AND t BETWEEN lo AND hi) AS supported, count(*) FILTER (value IS NOT NULL AND (t < lo OR t > hi)) AS extrapolated, count(*) FILTER (value IS NULL) AS missing FROM samples s JOIN maps USING (rec) GROUP BY ALL)
    SELECT *, finite + missing = total AND supported + extrapolated = finite AS valid FROM c""")  # fmt: skip
def a7(spark, sf):
    """Coverage facts with their invariants."""
    s = samples(spark, sf).withColumn("t", F.when(F.col("value").isNotNull(), F.col("t"))).join(_maps(spark, sf), "rec")
    return quality.coverage(s, ["rec", "label"], "t", F.col("lo"), F.col("hi"))


@query("q7_map_consistency", f"""WITH {_MAPS} SELECT rec, abs(a + b * lo - (a + b * lo + CASE WHEN rec % 3 = 0 THEN 1.0 ELSE 0 END)) <= 1e-6 + 1e-10 * abs(a + b * lo + CASE WHEN rec % 3 = 0 THEN 1.0 ELSE 0 END) AND lo <= hi AS consistent FROM maps""")
def q7(spark, sf):
    y = F.col("a") + F.col("b") * F.col("lo") + F.when(F.col("rec") % 3 == 0, 1.0).otherwise(0.0)
    return _maps(spark, sf).select("rec", quality.map_consistent(F.col("a"), F.col("b"), F.col("lo"), y).alias("k"), "lo", "hi").select("rec", (F.col("k") & (F.col("lo") <= F.col("hi"))).alias("consistent"))


# --- projections --------------------------------------------------------------------------------------------------


@query("p1_p4_clock_maps", f"""WITH {_MAPS} SELECT s.rec, s.seq, round(a + b * t, 3) AS mapped, round((a + b * t - a) / b, 3) AS back, round(a + (b - 1) * t, 3) AS offset_s, round((b - 1) * 1e6, 3) AS drift_ppm FROM samples s JOIN maps USING (rec)""")
def p1(spark, sf):
    s = samples(spark, sf).join(_maps(spark, sf), "rec")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    m = S.mapped(a, b, t)
    return s.select("rec", "seq", r(m, 3).alias("mapped"), r(S.unmapped(a, b, m), 3).alias("back"), r(S.offset_at(a, b, t), 3).alias("offset_s"), r(S.drift_ppm(b), 3).alias("drift_ppm"))


@query("p2_j18_composition", f"""WITH {_MAPS}, second AS (SELECT rec, 3.0 - rec AS la, CASE WHEN rec % 4 <> 0 THEN 1.0 - rec % 3 * 1e-4 END AS lb FROM maps)
    SELECT rec, round(la + lb * a, 6) AS intercept, round(lb * b, 9) AS scale, lb IS NOT NULL AS chained FROM maps LEFT JOIN second USING (rec)""")  # fmt: skip
def p2(spark, sf):
    m = _maps(spark, sf)
    second = m.select("rec", (3.0 - F.col("rec")).alias("la"), F.when(F.col("rec") % 4 != 0, 1.0 - F.col("rec") % 3 * 1e-4).alias("lb"))
    j = m.join(second, "rec", "left")
    a, b = S.composed((F.col("la"), F.col("lb")), (F.col("a"), F.col("b")))
    return j.select("rec", r(a).alias("intercept"), r(b, 9).alias("scale"), F.col("lb").isNotNull().alias("chained"))


@query("p5_p6_support", f"""WITH {_MAPS}, other AS (SELECT rec, lo + 43200 * (rec % 4) AS lo2, CASE WHEN rec % 6 <> 0 THEN hi - 3600 * (rec % 7) END AS hi2 FROM maps)
    SELECT rec, round(greatest(lo, lo2), 6) AS start, round(CASE WHEN hi2 IS NOT NULL THEN least(hi, hi2) END, 6) AS "end", round(coalesce(hi2, a + b * hi), 5) AS filled FROM maps JOIN other USING (rec)""")  # fmt: skip
def p6(spark, sf):
    """Support intersection, and measured bounds kept where there are any."""
    m = _maps(spark, sf).withColumn("lo2", F.col("lo") + 43200 * (F.col("rec") % 4)).withColumn("hi2", F.when(F.col("rec") % 6 != 0, F.col("hi") - 3600 * (F.col("rec") % 7)))
    filled = F.coalesce("hi2", S.mapped(F.col("a"), F.col("b"), F.col("hi")))
    return m.select("rec", r(S.both(F.greatest, F.col("lo"), F.col("lo2"))).alias("start"), r(S.both(F.least, F.col("hi"), F.col("hi2"))).alias("end"), r(filled, 5).alias("filled"))


@query("p7_p8_brackets", """SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round((o_orderkey + (o_orderkey + 7) - 2 * 100) / 2.0 * (1001.0 / 30000.0), 6) AS middle, round(7 / 2.0 * (1001.0 / 30000.0), 6) AS half FROM orders""")
def p8(spark, sf):
    k = F.col("o_orderkey")
    middle, half = S.bracket(k, k + 7, F.lit(100), F.lit(1001), F.lit(30000))
    return table(spark, sf, "orders").select("o_orderkey", r(F.sqrt("o_totalprice")).alias("root"), r(middle).alias("middle"), r(half).alias("half"))


@query("p9_aspect_ratio", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT vec_id,
    sqrt((v[3]-v[11])*(v[3]-v[11]) + (v[4]-v[12])*(v[4]-v[12])) AS h1, sqrt((v[5]-v[9])*(v[5]-v[9]) + (v[6]-v[10])*(v[6]-v[10])) AS h2, sqrt((v[1]-v[7])*(v[1]-v[7]) + (v[2]-v[8])*(v[2]-v[8])) AS w FROM e)
    SELECT vec_id, round(CASE WHEN w > 0 THEN (h1 + h2) / (2 * w) END, 6) AS ratio FROM d""")  # fmt: skip
def p9(spark, sf):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", r(S.aspect_ratio([(at(2 * k), at(2 * k + 1)) for k in range(6)])).alias("ratio"))


@query("p12_p26_formats", """SELECT event_id, CASE WHEN p > 0 AND p < 0.1 THEN '<0.1%' ELSE printf('%.1f%%', p) END AS share, printf('%02d:%02d.%03d', ms // 60000, ms % 60000 // 1000, ms % 1000) AS clock
    FROM (SELECT event_id, event_id % 1000 / 801.7 AS p, CAST(floor(event_id * 1.5 * 1000 + 0.5) AS BIGINT) AS ms FROM events)""")  # fmt: skip
def p12(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.percent(F.col("event_id") % 1000 / 801.7).alias("share"), S.clock_text(F.col("event_id") * 1.5).alias("clock"))


@query("p13_p15_cascades", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'invalid' WHEN c_acctbal <= 2000 THEN 'review' WHEN c_acctbal <= 10000 THEN 'good' ELSE 'unavailable' END AS status,
    array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey < 5 THEN 'near' END, CASE WHEN c_acctbal < 0 AND c_nationkey >= 5 THEN 'far' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM customer""")  # fmt: skip
def p13(spark, sf):
    b = F.col("c_acctbal")
    status = S.cascade((b < 0, "invalid"), (b <= 2000, "review"), (b <= 10000, "good"), otherwise="unavailable")
    why = S.reasons(F.when(b < 0, "negative"), F.when(F.col("c_nationkey") < 5, "near"), F.when(b < 0, F.when(F.col("c_nationkey") < 5, "near").otherwise("far")))
    return table(spark, sf, "customer").select("c_custkey", status.alias("status"), why.alias("reasons"))


@query("p17_identity_replaced", """SELECT c_custkey, 'Q' || c_custkey || '/x_V0-Q' || c_custkey || '/T' || c_custkey || '1.csv' AS name FROM customer""")
def p17(spark, sf):
    """pid_visit, pid and visit replaced where they stand alone, whatever the case, and left inside longer words."""
    k = F.col("c_custkey").cast("string")
    pid, new = F.concat(F.lit("T"), k), F.concat(F.lit("Q"), k)
    name = F.concat(F.lit("t"), k, F.lit("_v2/x_V2-"), F.lower(pid), F.lit("/"), pid, F.lit("1.csv"))
    return table(spark, sf, "customer").select("c_custkey", S.identity_replaced(name, pid, F.lit("V2"), new).alias("name"))


@query("p19_canonical_names", """WITH f AS (SELECT p_partkey, p_brand AS record, split_part(p_type, ' ', 1) AS label, p_name AS path FROM part)
    SELECT p_partkey, record || '_' || label || CASE WHEN count(*) OVER w > 1 THEN '_' || row_number() OVER (PARTITION BY record, label ORDER BY lower(path), path, p_partkey) ELSE '' END || '.csv' AS target FROM f WINDOW w AS (PARTITION BY record, label)""")  # fmt: skip
def p19(spark, sf):
    f = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("record"), F.split("p_type", " ")[0].alias("label"), F.concat(F.lower("p_name"), F.lit("\x00"), F.col("p_name"), F.lit("\x00"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("path"), F.lit(".csv").alias("ext"), F.col("p_brand").alias("random_id"))
    return anonymize.canonical_names(f).select("p_partkey", "target")


@query("p21_p22_time_shift", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS u FROM events), d AS (SELECT user_id, 946684800 - min(u) // 1000000 AS delta FROM e GROUP BY user_id)
    SELECT event_id, delta, CAST((u + delta * 1000000) // 1000000 AS VARCHAR) || '.' || lpad(CAST(u % 1000000 // 1000 AS VARCHAR), 3, '0') AS unix_text,
      strftime(make_timestamp(((u + delta * 1000000) // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(u % 1000000 // 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM e JOIN d USING (user_id)""")  # fmt: skip
def p21(spark, sf):
    """Decimal and ISO clocks of a record moved by its shift, digits kept."""
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    ms = F.lpad(F.floor(F.col("u") % 1_000_000 / 1000).cast("string"), 3, "0")
    e = table(spark, sf, "events").select("user_id", "event_id", u.alias("u"), (u / 1e6).alias("t"))
    e = e.withColumn("text", F.concat(F.floor(F.col("u") / 1_000_000).cast("string"), F.lit("."), ms)).withColumn("iso", F.concat(F.date_format(F.timestamp_micros("u"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), ms, F.lit("Z")))
    d = anonymize.time_shift(e, ["user_id"], "t")
    return e.join(d, "user_id").select("event_id", "delta", S.shifted_decimal(F.col("text"), F.col("delta")).alias("unix_text"), anonymize.shifted_iso(F.col("iso"), F.col("delta")).alias("iso"))


@query("p27_p29_pixels", """SELECT p_partkey, CAST(round_even(p_size * 0.5, 0) AS BIGINT) AS pixels, split_part(p_type, ' ', 1) AS kind, ends_with(p_type, 'STEEL') AS steel, round(10 * log10(p_retailprice / 900), 6) AS db FROM part""")
def p27(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.to_pixels(F.lit(0.5), F.col("p_size")).alias("pixels"), F.split("p_type", " ")[0].alias("kind"), F.endswith("p_type", F.lit("STEEL")).alias("steel"), r(S.decibel(F.col("p_retailprice"), F.lit(900.0))).alias("db"))


@query("p31_best_candidate", """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS c, l_quantity AS area, l_discount * 10 AS circularity, l_tax * 10 AS axis_ratio, 1 - l_discount AS solidity, CASE WHEN l_linenumber > 1 THEN l_quantity END AS distance, CASE WHEN l_linenumber > 1 THEN l_quantity / 10 END AS jump, l_partkey FROM lineitem),
    s AS (SELECT *, circularity + axis_ratio + solidity - 0.25 * least(coalesce(distance, 0) / 24.0, 1.8) - 0.10 * least(coalesce(jump, 0) / 2.5, 1.5) + CASE WHEN distance IS NULL THEN 0.15 ELSE 0 END + CASE WHEN coalesce(distance, 0) > 24 AND circularity + axis_ratio + solidity > 1.2 THEN 0.15 ELSE 0 END AS score FROM c WHERE circularity >= 0.08 AND axis_ratio >= 0.15 AND solidity >= 0.45)
    SELECT k, round(max(score), 6) AS score, CASE WHEN max(score) >= 0.85 THEN 'high' WHEN max(score) >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM s GROUP BY k""")  # fmt: skip
def p31(spark, sf):
    first = F.col("l_linenumber") > 1
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("candidate"), F.col("l_quantity").alias("area"), (F.col("l_discount") * 10).alias("circularity"), (F.col("l_tax") * 10).alias("axis_ratio"), (1 - F.col("l_discount")).alias("solidity"), F.when(first, F.col("l_quantity")).alias("distance"), F.when(first, F.col("l_quantity") / 10).alias("area_jump"))
    return trackers.best_candidate(c, ["k"]).select("k", r(F.col("score")).alias("score"), "confidence")


# --- joins --------------------------------------------------------------------------------------------------------


@query("j6_j7_lookup", """WITH d AS (SELECT o_custkey, coalesce(nullif(trim(o_orderstatus), 'F'), 'main') AS segment, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY ALL)
    SELECT c_custkey, coalesce(d.k, -1) AS last_order, coalesce(d.n, 0) = 1 AS single FROM customer LEFT JOIN d ON o_custkey = c_custkey AND segment = 'main'""")  # fmt: skip
def j6(spark, sf):
    """Left lookup by composite key with a default segment, and whether it was unique."""
    seg = F.coalesce(F.nullif(F.trim("o_orderstatus"), F.lit("F")), F.lit("main"))
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), seg.alias("segment")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))
    return table(spark, sf, "customer").select("c_custkey").join(d.where("segment = 'main'"), "c_custkey", "left").select("c_custkey", F.coalesce("last_order", F.lit(-1)).alias("last_order"), (F.coalesce("n", F.lit(0)) == 1).alias("single"))


@query("j8_full_outer", f"WITH {_LISTINGS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN x.pid IS NULL THEN 'b' WHEN y.pid IS NULL THEN 'a' ELSE 'both' END AS status FROM (SELECT DISTINCT pid FROM a) x FULL JOIN (SELECT DISTINCT pid FROM b) y ON x.pid = y.pid) GROUP BY status")
def j8(spark, sf):
    a, b = _listings(spark, sf)
    j = a.select("pid", F.lit(1).alias("x")).distinct().join(b.select("pid", F.lit(1).alias("y")).distinct(), "pid", "full")
    return j.groupBy(F.when(F.col("x").isNull(), "b").when(F.col("y").isNull(), "a").otherwise("both").alias("status")).agg(F.count("*").alias("n"))


@query("j9_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j9(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j10_j11_reindex", "SELECT n_nationkey, coalesce(count(s_suppkey), 0) AS n, round(avg(s_acctbal), 4) AS mean, count(s_suppkey) > 0 AS found FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def j10(spark, sf):
    """Reindexed onto a fixed dimension: counts 0, means null, flags false where nothing was."""
    g = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), r(F.avg("s_acctbal"), 4).alias("mean"), F.lit(True).alias("found"))
    return table(spark, sf, "nation").select("n_nationkey").join(g, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.coalesce("found", F.lit(False)).alias("found"))


@query("j12_positional", """WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view')
    SELECT user_id, k, round(a.value - b.value, 6) AS difference FROM a JOIN b USING (user_id, k)""")  # fmt: skip
def j12(spark, sf):
    e = table(spark, sf, "events")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("k"), F.col("value").alias(name))
    return side("click", "x").join(side("view", "y"), ["user_id", "k"]).select("user_id", "k", r(F.col("x") - F.col("y")).alias("difference"))


@query("j13_pivot", "SELECT user_id, max(event_id) FILTER (event_type = 'click') AS click, max(event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def j13(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.max("event_id"))


@query("j15_interval", f"""WITH {SAMPLES}, seg AS (SELECT rec, min(t) + 1000 AS s, min(t) + 900000 AS e FROM samples GROUP BY rec UNION ALL SELECT rec, min(t) + 1200000, min(t) + 1900000 FROM samples GROUP BY rec)
    SELECT x.rec, x.seq, round(g.s, 3) AS start FROM samples x JOIN seg g ON g.rec = x.rec AND x.t - 3600 >= g.s AND x.t + 7200 <= g.e""")  # fmt: skip
def j15(spark, sf):
    from ..operators import epochs

    s = samples(spark, sf)
    t0 = s.groupBy("rec").agg(F.min("t").alias("t0"))
    seg = t0.select("rec", F.explode(F.array(*[F.struct((F.col("t0") + a).alias("start"), (F.col("t0") + b).alias("end")) for a, b in ((1000, 900_000), (1_200_000, 1_900_000))])).alias("x")).select("rec", "x.*")
    return epochs.within_segments(s, seg, ["rec"], "t", -3600.0, 7200.0, cell=86_400.0).select("rec", "seq", r(F.col("start"), 3).alias("start"))


@query("j16_lag_products", """WITH d AS (SELECT user_id AS rec, epoch_us(ts) // 86400000000 AS day, sum(value) AS v FROM events GROUP BY ALL)
    SELECT a.rec, b.day - a.day AS lag, round(sum(a.v * b.v), 4) AS product, count(*) AS n FROM d a JOIN d b ON a.rec = b.rec AND abs(b.day - a.day) <= 3 GROUP BY ALL""")  # fmt: skip
def j16(spark, sf):
    """All lags of a small range: each row is dealt to its lags, and the join is an equality."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("rec"), day.alias("day")).agg(F.sum("value").alias("v"))
    lagged = d.withColumn("lag", F.explode(F.sequence(F.lit(-3), F.lit(3)))).select("rec", (F.col("day") + F.col("lag")).alias("day"), F.col("lag").cast("long").alias("lag"), F.col("v").alias("w"))
    return lagged.join(d, ["rec", "day"]).groupBy("rec", "lag").agg(r(F.sum(F.col("v") * F.col("w")), 4).alias("product"), F.count("*").alias("n"))


@query("j17_w24_clusters", """WITH o AS (SELECT user_id AS rec, event_type AS grp, avg(value) AS offset_s FROM events GROUP BY ALL), c AS (SELECT a.rec, a.grp AS seed, count(*) AS n, round(quantile_cont(b.offset_s, 0.5), 6) AS prior, round(stddev_pop(b.offset_s), 6) AS sd, string_agg(b.grp, ',' ORDER BY b.grp) AS members FROM o a JOIN o b ON a.rec = b.rec AND abs(a.offset_s - b.offset_s) < 15 GROUP BY ALL),
    u AS (SELECT DISTINCT rec, members, n, prior, sd FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY n DESC, sd, prior, members) AS rank FROM u) SELECT rec, prior, rank FROM k WHERE rank <= 5""")  # fmt: skip
def j17(spark, sf):
    from ..operators import alignment

    # sums in the events' order: means of 16 or 32 values end halfway between two microseconds, where any other order of
    # the same sum, as of a shuffle's parts, may round to the other side
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").where("value IS NOT NULL").withColumn("_sum", F.sum("value").over(w))
    o = e.groupBy(F.col("user_id").alias("rec"), F.col("event_type").alias("grp")).agg((F.max_by("_sum", "event_id") / F.count("*")).alias("offset"))
    return alignment.priors(o, 15.0, 5).select("rec", alignment.micros(F.col("prior")).alias("prior"), F.col("rank").cast("long").alias("rank"))


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("a1_a4_moments", f"""WITH {SAMPLES} SELECT rec, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd0, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(value) AS n, CASE WHEN max(t) - min(t) >= 240 THEN round(max(t) - min(t), 6) END AS span FROM samples GROUP BY rec""")
def a1(spark, sf):
    span = F.max("t") - F.min("t")
    return samples(spark, sf).groupBy("rec").agg(r(F.stddev_samp("value")).alias("sd"), r(F.stddev_pop("value")).alias("sd0"), r(F.avg("value")).alias("mean"), r(F.sum("value"), 4).alias("total"), F.count("value").alias("n"), F.when(span >= 240, r(span)).alias("span"))


@query("a5_first_last", f"WITH {SAMPLES} SELECT rec, arg_min(label, seq) AS first_label, min(t) AS t0, max(t) AS t1, count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS kinds FROM samples GROUP BY rec")
def a5(spark, sf):
    return samples(spark, sf).groupBy("rec").agg(F.min_by("label", "seq").alias("first_label"), F.min("t").alias("t0"), F.max("t").alias("t1"), (F.countDistinct("value") + F.max(F.col("value").isNull().cast("long"))).alias("kinds"))


@query("a6_availability", f"WITH {SAMPLES} SELECT label, count(*) AS total, count(*) FILTER (value > 0) AS available, round(100.0 * count(*) FILTER (value > 0) / count(*), 6) AS percentage, CASE WHEN count(*) FILTER (value > 0) = 0 THEN 'unavailable' WHEN count(*) FILTER (value > 0) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM samples GROUP BY label")
def a6(spark, sf):
    g = samples(spark, sf).groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 0).alias("available"))
    status = F.when(F.col("available") == 0, "unavailable").when(F.col("available") == F.col("total"), "complete").otherwise("partial")
    return g.select("*", r(100.0 * F.col("available") / F.col("total")).alias("percentage"), status.alias("status"))


@query("a8_global_ratio", f"WITH {SAMPLES}, g AS (SELECT label, sum(value) FILTER (value > 1000) AS a, sum(value) AS b FROM samples GROUP BY label) SELECT round(coalesce(sum(a) / sum(b), -1), 6) AS ratio, round(sum(b), 3) AS b FROM g")
def a8(spark, sf):
    g = samples(spark, sf).groupBy("label").agg(F.sum(F.when(F.col("value") > 1000, F.col("value"))).alias("a"), F.sum("value").alias("b"))
    return g.agg(r(F.coalesce(F.try_divide(F.sum("a"), F.sum("b")), F.lit(-1.0))).alias("ratio"), r(F.sum("b"), 3).alias("b"))


@query("a9_a11_robust", f"""WITH {SAMPLES}, c AS (SELECT rec, median(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.01) AS p01 FROM samples WHERE value IS NOT NULL GROUP BY rec),
    d AS (SELECT rec, median(abs(value - m)) AS mad FROM samples JOIN c USING (rec) GROUP BY rec)
    SELECT rec, round(m, 6) AS median, round(p95, 6) AS p95, round(p01, 6) AS p01, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END, 6) AS scale FROM c JOIN d USING (rec)""")  # fmt: skip
def a9(spark, sf):
    s = samples(spark, sf).where("value IS NOT NULL")
    p = s.groupBy("rec").agg(r(F.percentile("value", 0.95)).alias("p95"), r(F.percentile("value", 0.01)).alias("p01"))
    return robust.robust_scale(s, ["rec"], "value").join(p, "rec").select("rec", r(F.col("median")).alias("median"), "p95", "p01", r(F.col("mad")).alias("mad"), r(F.col("scale")).alias("scale"))


@query("a12_a13_lines", f"WITH {SAMPLES} SELECT rec, round(regr_slope(value, seq), 6) AS slope, round(regr_intercept(value, seq), 4) AS intercept, count(value) AS n, round(corr(seq, value), 6) AS r FROM samples WHERE value IS NOT NULL GROUP BY rec")
def a12(spark, sf):
    f = robust.line(samples(spark, sf).where("value IS NOT NULL"), ["rec"], "seq", "value")
    return f.select("rec", r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept"), "n", r(F.col("r")).alias("r"))


@query("w28_trimmed_line", f"""WITH {SAMPLES}, k0 AS (SELECT rec, seq, value FROM samples WHERE value IS NOT NULL), l0 AS (SELECT rec, regr_slope(value, seq) AS s, regr_intercept(value, seq) AS i FROM k0 GROUP BY rec),
    e0 AS (SELECT rec, seq, value, value - i - s * seq AS e FROM k0 JOIN l0 USING (rec)), m0 AS (SELECT rec, median(e) AS m FROM e0 GROUP BY rec), d0 AS (SELECT rec, any_value(m) AS m, median(abs(e - m)) AS mad FROM e0 JOIN m0 USING (rec) GROUP BY rec),
    k1 AS (SELECT rec, seq, value FROM e0 JOIN d0 USING (rec) WHERE abs(e - m) <= greatest(0.04, 1.5 * 1.4826 * mad)), l1 AS (SELECT rec, regr_slope(value, seq) AS s, regr_intercept(value, seq) AS i FROM k1 GROUP BY rec)
    SELECT rec, round(any_value(s), 6) AS slope, round(any_value(i), 4) AS intercept, count(*) AS n, round(quantile_cont(abs(value - i - s * seq), 0.95), 5) AS p95 FROM k1 JOIN l1 USING (rec) GROUP BY rec""")  # fmt: skip
def w28(spark, sf):
    s = samples(spark, sf).where("value IS NOT NULL").withColumn("seq", F.col("seq").cast("double"))
    f = robust.trimmed_line(s, ["rec"], "seq", "value", 0.04, 1.5, 1)
    return f.select("rec", r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept"), "n", r(F.col("p95"), 5).alias("p95"))


@query("w17_standardised", f"""WITH {SAMPLES}, c AS (SELECT rec, median(value) AS m, stddev_pop(value) AS sd FROM samples GROUP BY rec), d AS (SELECT rec, any_value(m) AS m, CASE WHEN median(abs(value - m)) > 0 THEN 1.4826 * median(abs(value - m)) ELSE any_value(sd) END AS s FROM samples JOIN c USING (rec) GROUP BY rec)
    SELECT rec, seq, round(CASE WHEN value IS NOT NULL THEN least(greatest(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, -2), 2) END, 5) AS z FROM samples JOIN d USING (rec)""")  # fmt: skip
def w17(spark, sf):
    return robust.standardised(samples(spark, sf), ["rec"], "value", 2.0).select("rec", "seq", r(F.col("z"), 5).alias("z"))


@query("a14_a16_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
def a14(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("a15_arg_max", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY user_id")
def a15(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", F.negative("event_id"))).alias("best"))


@query("a17_histogram", "SELECT event_type, CAST(least(floor(value / 25), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY ALL")
def a17(spark, sf):
    return robust.histogram(table(spark, sf, "events"), ["event_type"], "value", 0, 500, 25)


@query("a18_a19_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY event_type")
def a18(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), r(F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))


@query("a20_box_plot", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_type, min(value) AS low, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3, max(value) AS high FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type""")  # fmt: skip
def a20(spark, sf):
    return robust.box(table(spark, sf, "events"), ["event_type"], "value").select("event_type", "low", *[r(F.col(q)).alias(q) for q in ("q1", "q2", "q3")], "high")


@query("a20_large_box", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_type, min(value) AS low, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3, max(value) AS high FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type""")  # fmt: skip
def a20_large(spark, sf):
    """The box plot of groups that no task could hold."""
    return robust.box(table(spark, sf, "events"), ["event_type"], "value", large=True).select("event_type", "low", *[r(F.col(q)).alias(q) for q in ("q1", "q2", "q3")], "high")


@query("a9_exact_quantiles", """SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS p100 FROM lineitem GROUP BY ALL""")
def a9_large(spark, sf):
    """Exact quantiles by refinement, with so few splitters that it takes several passes."""
    q = quantiles.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.95, 1.0], splitters=63, few=2000)
    return q.select(F.col("l_returnflag").alias("flag"), "n", *[r(F.get("values", F.lit(k))).alias(c) for k, c in enumerate(("p01", "p50", "p95"))], F.get("values", F.lit(3)).alias("p100"))


@query("a21_a22_weighted_maps", "WITH m AS (SELECT user_id, event_type, avg(value) AS p, count(*) AS w FROM events GROUP BY ALL) SELECT event_type, round(sum(w * p) / sum(w), 6) AS weighted, round(avg(p), 6) AS plain FROM m GROUP BY event_type")
def a21(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("p"), F.count("*").alias("w"))
    return m.groupBy("event_type").agg(r(F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("weighted"), r(F.avg("p")).alias("plain"))


@query("a23_a24_rates", f"""WITH {SAMPLES}, d AS (SELECT rec, label, t - lag(t) OVER (PARTITION BY rec, label ORDER BY t) AS d FROM (SELECT DISTINCT rec, label, t FROM samples)), s AS (SELECT rec, max(t) - min(t) AS whole FROM samples GROUP BY rec),
    l AS (SELECT rec, label, max(t) - min(t) AS part FROM samples GROUP BY ALL), g AS (SELECT rec, label, median(d) AS m FROM d GROUP BY ALL)
    SELECT rec, label, round(least(0.0005, 1 / m), 9) AS rate, round(part / nullif(whole, 0), 6) AS covered FROM g JOIN l USING (rec, label) JOIN s USING (rec)""")  # fmt: skip
def a24(spark, sf):
    """Median sample rate with a cap, and a stream's span over the recording's."""
    s = samples(spark, sf)
    d = s.select("rec", "label", "t").distinct().withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("rec", "label").orderBy("t")))
    g = d.groupBy("rec", "label").agg(F.percentile("d", 0.5).alias("m"), (F.max("t") - F.min("t")).alias("part"))
    whole = s.groupBy("rec").agg((F.max("t") - F.min("t")).alias("whole"))
    rate = F.try_divide(F.lit(1.0), F.col("m"))
    return g.join(whole, "rec").select("rec", "label", r(F.when(rate.isNull(), F.lit(0.0005)).otherwise(F.least(F.lit(0.0005), rate)), 9).alias("rate"), r(F.try_divide("part", "whole")).alias("covered"))


@query("a27_any_finite", f"WITH {SAMPLES} SELECT rec, bool_or(value IS NOT NULL AND label = 'purchase') AS purchase, bool_or(value > 450) AS large FROM samples GROUP BY rec")
def a27(spark, sf):
    return samples(spark, sf).groupBy("rec").agg(F.bool_or(F.col("value").isNotNull() & (F.col("label") == "purchase")).alias("purchase"), F.bool_or(F.col("value") > 450).alias("large"))


@query("a28_a29_status_table", """WITH t AS (SELECT 'customer' AS pair, c_acctbal AS b FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier)
    SELECT pair, count(*) FILTER (b > 2000) AS usable, count(*) FILTER (b BETWEEN 0 AND 2000) AS review, count(*) FILTER (b < 0) AS unusable FROM t GROUP BY pair""")  # fmt: skip
def a28(spark, sf):
    """Status tables unpivoted to one with the pair's name, and counted for a bar chart."""
    t = table(spark, sf, "customer").select(F.lit("customer").alias("pair"), F.col("c_acctbal").alias("b")).unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("pair"), F.col("s_acctbal").alias("b")))
    return t.groupBy("pair").agg(F.count_if(F.col("b") > 2000).alias("usable"), F.count_if(F.col("b").between(0, 2000)).alias("review"), F.count_if(F.col("b") < 0).alias("unusable"))


# --- sorts, sets, upsert ------------------------------------------------------------------------------------------


@query("t1_t6_top_k", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS rank FROM events) WHERE rank <= 5")
def t1(spark, sf):
    """The best five per key, ties in a fixed order."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 5")


@query("t3_preview", "SELECT lower(p_name) AS name, p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 12")
def t3(spark, sf):
    return table(spark, sf, "part").select(F.lower("p_name").alias("name"), "p_partkey").orderBy("name", "p_partkey").limit(12)


@query("u1_u5_union", "SELECT k, max(bal) AS bal, max(segment) AS segment FROM (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier) GROUP BY k")
def u1(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("k").agg(F.max("bal").alias("bal"), F.max("segment").alias("segment"))


@query("u2_u4_sets", """SELECT 'both' AS part, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def u2(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("part"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("part"), "k"))


@query("k4_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT max(o_orderkey) + 10, 'new' FROM orders""")
def k4(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = old.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("new").alias("status")).unionByName(old.agg((F.max("o_orderkey") + 10).alias("o_orderkey")).select("o_orderkey", F.lit("new").alias("status")))
    return quality.upserted(old, new, ["o_orderkey"])


# --- more signals and exports -------------------------------------------------------------------------------------


@query("w15_activity_envelope", f"""WITH {SAMPLES}, a AS (SELECT *, value - sum(value) OVER (PARTITION BY rec ORDER BY t, seq ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS e FROM samples), c AS (SELECT rec, median(e) AS m, stddev_pop(e) AS sd FROM a GROUP BY rec),
    d AS (SELECT rec, any_value(m) AS m, CASE WHEN median(abs(e - m)) > 0 THEN 1.4826 * median(abs(e - m)) ELSE any_value(sd) END AS s FROM a JOIN c USING (rec) GROUP BY rec),
    z AS (SELECT rec, seq, t, CASE WHEN e IS NOT NULL THEN least(greatest(CASE WHEN s > 0 THEN (e - m) / s ELSE 0 END, -10), 10) END AS z FROM a JOIN d USING (rec)),
    k AS (SELECT rec, seq, sqrt(sum(z * z) OVER (PARTITION BY rec ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4) AS v, row_number() OVER (PARTITION BY rec ORDER BY t, seq) - 1 AS i FROM z)
    SELECT rec, seq, round(v, 5) AS envelope FROM k WHERE i % 5 = 0""")  # fmt: skip
def w15(spark, sf):
    return robust.activity_envelope(samples(spark, sf), ["rec"], ["t", "seq"], "value", 10, 4, 5).select("rec", "seq", r(F.col("envelope"), 5).alias("envelope"))


@query("g6_publication_export", f"""WITH {_MAPS} SELECT CAST(CAST(floor((a + b * t) * 1000 + 0.5) AS BIGINT) AS VARCHAR) AS time_ms, s.rec, s.seq, coalesce(printf('%.3f', value), '') AS value, coalesce(round(a + b * t, 6) BETWEEN round(a + b * lo, 6) AND round(a + b * hi, 6), false) AS supported FROM samples s JOIN maps USING (rec)""")
def g6(spark, sf):
    """Samples on the shared clock in whole milliseconds, in the contract's order of columns."""
    s = samples(spark, sf).join(_maps(spark, sf), "rec")
    a, b = F.col("a"), F.col("b")
    at = S.mapped(a, b, F.col("t"))
    inside = r(at).between(r(S.mapped(a, b, F.col("lo"))), r(S.mapped(a, b, F.col("hi"))))
    out = s.select(F.floor(at * 1000 + 0.5).cast("long").cast("string").alias("time_ms"), "rec", "seq", F.when(F.col("value").isNotNull(), F.format_string("%.3f", F.col("value"))).otherwise("").alias("value"), F.coalesce(inside, F.lit(False)).alias("supported"))
    return quality.exact_columns(out, ["time_ms", "rec", "seq", "value", "supported"])


@query("p28_markers", """SELECT event_id, split_part(m, '_', 1) AS difficulty, ends_with(m, 'keypress') AS pressed, split_part(m, '_', 2) = 'correct' AS correct FROM (SELECT event_id, ['easy_correct', 'easy_wrong', 'hard_correct_keypress', 'hard_wrong_keypress'][1 + event_id % 4] AS m FROM events)""")
def p28(spark, sf):
    names = F.array(*[F.lit(x) for x in ("easy_correct", "easy_wrong", "hard_correct_keypress", "hard_wrong_keypress")])
    m = F.get(names, (F.col("event_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", F.split(m, "_")[0].alias("difficulty"), m.endswith("keypress").alias("pressed"), (F.split(m, "_")[1] == "correct").alias("correct"))


@query("q9_flag_domain", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 3 NOT IN (0, 1)) AS outside FROM orders GROUP BY o_orderstatus")
def q9(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(~(F.col("o_orderkey") % 3).isin(0, 1)).alias("outside"))


@query("w12_fills", f"""WITH {SAMPLES} SELECT rec, seq, last_value(value IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS forward, first_value(value IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM samples""")
def w12(spark, sf):
    from ..operators import runs

    return samples(spark, sf).select("rec", "seq", runs.forward_filled("value", ["rec"], ["t", "seq"]).alias("forward"), runs.backward_filled("value", ["rec"], ["t", "seq"]).alias("backward"))
