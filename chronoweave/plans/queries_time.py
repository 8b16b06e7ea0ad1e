"""Queries along time: as-of joins, interpolation, runs, windows, fills, events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, runs, trackers
from .base import MODULES, ORACLES, SAMPLES, query, r, samples, table

_SIDES = """lefts AS (SELECT * FROM samples WHERE label <> 'signup'),
    rights AS (SELECT rec, t, seq % 10 AS scenario FROM samples WHERE label = 'signup')"""


def _sides(spark, sf):
    s = samples(spark, sf)
    return s.where("label <> 'signup'"), s.where("label = 'signup'").select("rec", "t", (F.col("seq") % 10).alias("scenario"))


@query("j1_asof_backward", f"""WITH {SAMPLES}, {_SIDES}, ends AS (SELECT rec, max(t) AS last_t FROM rights GROUP BY rec)
    SELECT l.rec, l.seq, coalesce(CASE WHEN l.t <= e.last_t THEN x.scenario END, -1) AS scenario
    FROM lefts l ASOF LEFT JOIN rights x ON l.rec = x.rec AND l.t >= x.t LEFT JOIN ends e ON e.rec = l.rec""")  # fmt: skip
def j1(spark, sf):
    a, b = _sides(spark, sf)
    return asof.backward(a, b, ["rec"], "t", ["scenario"]).select("rec", "seq", F.coalesce("scenario", F.lit(-1)).alias("scenario"))


@query("module_dispersion", f"""WITH {SAMPLES}, {_SIDES}, ends AS (SELECT rec, max(t) AS last_t FROM rights GROUP BY rec),
    placed AS (SELECT l.value, CASE WHEN l.t <= e.last_t THEN x.scenario END AS scenario
      FROM lefts l ASOF LEFT JOIN rights x ON l.rec = x.rec AND l.t >= x.t LEFT JOIN ends e ON e.rec = l.rec),
    sd AS (SELECT scenario, stddev_samp(value) AS sd, count(value) AS n FROM placed WHERE scenario IS NOT NULL GROUP BY scenario)
    SELECT m AS module, round(sd, 6) AS sd, coalesce(n, 0) AS n FROM range(10) AS x(m) LEFT JOIN sd ON scenario = m""")  # fmt: skip
def module_dispersion(spark, sf):
    """Lane-position deviation by module: as-of scenario, sample deviation, fixed dimension."""
    a, b = _sides(spark, sf)
    at = asof.backward(a, b, ["rec"], "t", ["scenario"])
    sd = at.where("scenario IS NOT NULL").groupBy("scenario").agg(r(F.stddev_samp("value")).alias("sd"), F.count("value").alias("n"))
    return spark.range(10).withColumnRenamed("id", "module").join(sd, F.col("module") == F.col("scenario"), "left").select("module", "sd", F.coalesce("n", F.lit(0)).alias("n"))


@query("j2_membership", f"""WITH {SAMPLES}, {_SIDES}, ends AS (SELECT rec, min(t) AS first_t, max(t) AS last_t FROM rights GROUP BY rec)
    SELECT l.rec, l.seq, CASE WHEN l.t BETWEEN e.first_t AND e.last_t THEN x.scenario IN (1, 3, 5) END AS member
    FROM lefts l ASOF LEFT JOIN rights x ON l.rec = x.rec AND l.t >= x.t LEFT JOIN ends e ON e.rec = l.rec""")  # fmt: skip
def j2(spark, sf):
    a, b = _sides(spark, sf)
    return asof.membership(a, b, ["rec"], "t", "scenario", [1, 3, 5]).select("rec", "seq", "member")


_KNOWN = "known AS (SELECT rec, t, value, lag(t) OVER (PARTITION BY rec ORDER BY t) AS prev_t FROM samples WHERE value IS NOT NULL)"
_GRID = """spans AS (SELECT rec, min(t) AS t0, max(t) AS t1 FROM samples GROUP BY rec),
    grid AS (SELECT rec, i, t0 + i * 21600.0 AS t FROM spans, unnest(range(0, CAST(ceil((t1 - t0) / 21600.0) AS BIGINT))) AS u(i))"""


def _grid(spark, sf):
    spans = samples(spark, sf).groupBy("rec").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    n = F.ceil((F.col("t1") - F.col("t0")) / 21600.0).cast("long")
    return spans.where(n > 0).select("rec", "t0", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")).select("rec", "i", (F.col("t0") + F.col("i") * 21600.0).alias("t"))


@query("w20_grid", f"WITH {SAMPLES}, {_GRID} SELECT rec, i, round(t, 3) AS t FROM grid")
def w20(spark, sf):
    return _grid(spark, sf).select("rec", "i", r(F.col("t"), 3).alias("t"))


@query("j3_interpolation", f"""WITH {SAMPLES}, {_GRID}, {_KNOWN}
    SELECT g.rec, g.i, round(CASE WHEN a.t IS NULL OR b.t IS NULL THEN NULL WHEN a.t = b.t THEN a.value ELSE a.value + (b.value - a.value) * (g.t - a.t) / (b.t - a.t) END, 6) AS value
    FROM grid g ASOF LEFT JOIN known a ON g.rec = a.rec AND g.t >= a.t ASOF LEFT JOIN known b ON g.rec = b.rec AND g.t <= b.t""")  # fmt: skip
def j3(spark, sf):
    known = samples(spark, sf).where("value IS NOT NULL").select("rec", "t", "value")
    return asof.interpolated(_grid(spark, sf), known, ["rec"], "t", "value").select("rec", "i", r(F.col("value")).alias("value"))


@query("j3_gap_limited", f"""WITH {SAMPLES}, {_GRID}, {_KNOWN}
    SELECT g.rec, g.i, round(CASE WHEN a.t IS NULL OR b.t IS NULL OR coalesce(CASE WHEN a.t = b.t THEN g.t - b.prev_t ELSE b.t - a.t END, 1e18) > 86400 THEN NULL
      WHEN a.t = b.t THEN a.value ELSE a.value + (b.value - a.value) * (g.t - a.t) / (b.t - a.t) END, 6) AS value
    FROM grid g ASOF LEFT JOIN known a ON g.rec = a.rec AND g.t >= a.t ASOF LEFT JOIN known b ON g.rec = b.rec AND g.t <= b.t""")  # fmt: skip
def j3_gap(spark, sf):
    known = samples(spark, sf).where("value IS NOT NULL").select("rec", "t", "value")
    return asof.interpolated(_grid(spark, sf), known, ["rec"], "t", "value", max_gap=86400.0).select("rec", "i", r(F.col("value")).alias("value"))


@query("j4_nearest", f"""WITH {SAMPLES}, {_SIDES}
    SELECT l.rec, l.seq, CASE WHEN a.t IS NULL OR (b.t IS NOT NULL AND b.t - l.t < l.t - a.t) THEN b.scenario ELSE a.scenario END AS scenario
    FROM lefts l ASOF LEFT JOIN rights a ON l.rec = a.rec AND l.t >= a.t ASOF LEFT JOIN rights b ON l.rec = b.rec AND l.t <= b.t""")  # fmt: skip
def j4(spark, sf):
    a, b = _sides(spark, sf)
    return asof.nearest(a, b, ["rec"], "t", ["scenario"]).select("rec", "seq", "scenario")


_W = "PARTITION BY rec ORDER BY t, seq"


@query("j5_open_neighbours", f"""WITH {SAMPLES}
    SELECT rec, seq, last_value(CASE WHEN value > 50 THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
           first_value(CASE WHEN value > 50 THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM samples""")  # fmt: skip
def j5(spark, sf):
    return asof.neighbours_where(samples(spark, sf), ["rec"], ["t", "seq"], F.col("value") > 50, "t").select("rec", "seq", "previous", "following")


_BY, _ON = ["rec"], ["t", "seq"]


@query("w1_rolling_median", f"""WITH {SAMPLES}, m AS (
      SELECT rec, seq, t, CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.5) OVER w END AS m FROM samples WINDOW w AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT rec, seq, round(coalesce(last_value(m IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS baseline FROM m""")  # fmt: skip
def w1(spark, sf):
    """Baseline: rolling median, filled forwards and then backwards."""
    s = samples(spark, sf).withColumn("m", runs.rolling_median("value", _BY, _ON, 30, 10))
    return s.select("rec", "seq", r(F.coalesce(runs.forward_filled("m", _BY, _ON), runs.backward_filled("m", _BY, _ON))).alias("baseline"))


@query("w2_dilation", f"WITH {SAMPLES} SELECT rec, seq, coalesce(bool_or(value < 10) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS wide FROM samples")
def w2(spark, sf):
    s = samples(spark, sf).withColumn("low", F.col("value") < 10)
    return s.select("rec", "seq", F.coalesce(runs.widened("low", _BY, _ON, 3), F.lit(False)).alias("wide"))


_RUNS = f"""flagged AS (SELECT *, CASE WHEN row_number() OVER ({_W}) = 1 OR label IS DISTINCT FROM lag(label) OVER ({_W}) THEN 1 ELSE 0 END AS new FROM samples),
    runs AS (SELECT *, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM flagged)"""


@query("w3_label_runs", f"WITH {SAMPLES}, {_RUNS} SELECT rec, CAST(run AS BIGINT) AS run, min(label) AS label, min(t) AS t0, max(t) AS t1, count(*) AS n FROM runs GROUP BY rec, run")
def w3(spark, sf):
    s = runs.with_run(samples(spark, sf), _BY, _ON, "label")
    return s.groupBy("rec", "run").agg(F.min("label").alias("label"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))


@query("w4_answers", """WITH s AS (SELECT conv_id, turn, role, lead(role) OVER w AS next, lead(role, 2) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'user' AND next = 'assistant') AS answered, count(*) FILTER (role = 'user' AND next <> 'assistant' AND after = 'assistant') AS late FROM s GROUP BY conv_id""")  # fmt: skip
def w4(spark, sf):
    """Questions with their answer one or two places on."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, sf, "conversations").select("conv_id", "role", F.lead("role").over(w).alias("next"), F.lead("role", 2).over(w).alias("after"))
    q = F.col("role") == "user"
    return s.groupBy("conv_id").agg(F.count_if(q).alias("questions"), F.count_if(q & (F.col("next") == "assistant")).alias("answered"), F.count_if(q & (F.col("next") != "assistant") & (F.col("after") == "assistant")).alias("late"))


_STATE = f"""f AS (SELECT *, coalesce(value < 30, false) AS c, coalesce(value > 25 AND value < 200, false) AS o FROM samples),
    k AS (SELECT *, sum(CASE WHEN c AND o THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS toggles FROM f),
    z AS (SELECT *, last_value(CASE WHEN c <> o THEN {{'v': CASE WHEN c THEN 1 ELSE 0 END, 'k': toggles}} END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s FROM k),
    a AS (SELECT *, (coalesce(s.v, 0) + toggles - coalesce(s.k, 0)) % 2 AS after FROM z),
    b AS (SELECT *, coalesce(lag(after) OVER ({_W}), 0) AS before FROM a),
    e AS (SELECT *, CASE WHEN after = 1 OR before = 1 THEN sum(CASE WHEN after = 1 AND before = 0 THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) END AS event FROM b)"""


def _flags(spark, sf):
    return samples(spark, sf).withColumn("c", F.coalesce(F.col("value") < 30, F.lit(False))).withColumn("o", F.coalesce((F.col("value") > 25) & (F.col("value") < 200), F.lit(False)))


@query("w5_hysteresis", f"WITH {SAMPLES}, {_STATE} SELECT rec, seq, CAST(coalesce(event, 0) AS BIGINT) AS event FROM e")
def w5(spark, sf):
    return runs.hysteresis(_flags(spark, sf), _BY, _ON, "c", "o").select("rec", "seq", F.coalesce("event", F.lit(0)).alias("event"))


_MERGED = """iv AS (SELECT rec, event, min(t) AS s0, max(t) AS s1 FROM e WHERE event IS NOT NULL AND c GROUP BY rec, event),
    n AS (SELECT *, CASE WHEN max(s1) OVER w IS NULL OR s0 - max(s1) OVER w >= 7200 THEN 1 ELSE 0 END AS new FROM iv WINDOW w AS (PARTITION BY rec ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS island FROM n),
    merged AS (SELECT rec, min(s0) AS start, max(s1) AS "end", count(*) AS parts FROM i GROUP BY rec, island)"""


def _blinks(spark, sf):
    e = runs.hysteresis(_flags(spark, sf), _BY, _ON, "c", "o")
    return runs.merged_intervals(runs.events_of(e, _BY, "t", "event", F.col("c")), _BY, "start", "end", 7200.0)


@query("w6_merged_events", f'WITH {SAMPLES}, {_STATE}, {_MERGED} SELECT rec, start, "end", parts FROM merged')
def w6(spark, sf):
    """Events trimmed to their closed rows and merged over short gaps."""
    return _blinks(spark, sf).select("rec", "start", "end", "parts")


@query("w7_marked_rows", f"""WITH {SAMPLES}, {_STATE}, {_MERGED}
    SELECT s.rec, s.seq, coalesce(s.t <= m."end", false) AS inside FROM samples s
    ASOF LEFT JOIN (SELECT * FROM merged WHERE "end" - start BETWEEN 0 AND 86400) m ON s.rec = m.rec AND s.t >= m.start""")  # fmt: skip
def w7(spark, sf):
    """Rows inside an event of accepted duration."""
    e = _blinks(spark, sf).where("end - start BETWEEN 0 AND 86400").select("rec", F.col("start").alias("t"), F.col("end").alias("until"))
    hit = asof.backward(samples(spark, sf), e, ["rec"], "t", ["until"], bounded=False)
    return hit.select("rec", "seq", F.coalesce(F.col("t") <= F.col("until"), F.lit(False)).alias("inside"))


@query("w8_events_by_module", f"""WITH {SAMPLES}, x AS (SELECT *, coalesce(value < 60, false) AS low FROM samples),
    g AS (SELECT *, CASE WHEN row_number() OVER (p) = 1 OR low <> lag(low) OVER (p) THEN 1 ELSE 0 END AS new FROM x WINDOW p AS (PARTITION BY rec, module ORDER BY t, seq)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY rec, module ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM g),
    d AS (SELECT module, max(t) - min(t) AS d FROM h WHERE low GROUP BY rec, module, run HAVING count(*) >= 2)
    SELECT module, count(*) AS events, round(avg(d), 6) AS mean_duration FROM d GROUP BY module""")  # fmt: skip
def w8(spark, sf):
    s = samples(spark, sf).withColumn("low", F.coalesce(F.col("value") < 60, F.lit(False)))
    e = runs.with_run(s, ["rec", "module"], _ON, "low").where("low").groupBy("rec", "module", "run").agg((F.max("t") - F.min("t")).alias("d"), F.count("*").alias("n"))
    return e.where("n >= 2").groupBy("module").agg(F.count("*").alias("events"), r(F.avg("d")).alias("mean_duration"))


@query("w10_complete_runs", f"""WITH {SAMPLES}, {_RUNS}, p AS (
      SELECT *, lag(module) OVER ({_W}) AS pm, lead(module) OVER ({_W}) AS nm, row_number() OVER ({_W}) AS k, count(*) OVER (PARTITION BY rec) AS size FROM runs)
    SELECT rec, CAST(run AS BIGINT) AS run, count(*) AS n, count(DISTINCT module) AS scopes,
      count(DISTINCT module) = 1 AND min(k) > 1 AND max(k) < min(size) AND arg_min(pm, k) IS NOT DISTINCT FROM min(module) AND arg_max(nm, k) IS NOT DISTINCT FROM min(module) AS complete
    FROM p GROUP BY rec, run""")  # fmt: skip
def w10(spark, sf):
    return runs.label_runs(samples(spark, sf), _BY, _ON, "label", "module", "t").select("rec", "run", "n", "scopes", "complete")


@query("w11_short_gaps", f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER ({_W}) AS k, value IS NULL AS gone FROM samples),
    g AS (SELECT *, CASE WHEN k = 1 OR gone <> lag(gone) OVER ({_W}) THEN 1 ELSE 0 END AS new FROM n),
    h AS (SELECT *, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM g),
    q AS (SELECT *, count(*) OVER (PARTITION BY rec, run) AS len,
      last_value(CASE WHEN NOT gone THEN {{'n': k, 'v': value}} END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS a,
      first_value(CASE WHEN NOT gone THEN {{'n': k, 'v': value}} END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h)
    SELECT rec, seq, round(CASE WHEN gone AND len <= 1 THEN coalesce(a.v + (b.v - a.v) * (k - a.n) / (b.n - a.n), a.v, b.v) ELSE value END, 6) AS value,
      gone AND len <= 1 AND coalesce(a.v, b.v) IS NOT NULL AS filled FROM q""")  # fmt: skip
def w11(spark, sf):
    return runs.short_gaps_filled(samples(spark, sf), _BY, _ON, "value", 1).select("rec", "seq", r(F.col("value")).alias("value"), "filled")


@query("w13_tracker_resets", f"""WITH {SAMPLES}, l AS (SELECT *, coalesce(value < 60, true) AS low FROM samples),
    g AS (SELECT *, CASE WHEN row_number() OVER ({_W}) = 1 OR low <> lag(low) OVER ({_W}) THEN 1 ELSE 0 END AS new FROM l),
    h AS (SELECT *, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT rec, seq, low AND row_number() OVER (PARTITION BY rec, run ORDER BY t, seq) % 2 = 0 AS reset FROM h""")  # fmt: skip
def w13(spark, sf):
    return trackers.tracker_resets(samples(spark, sf), _BY, _ON, F.coalesce(F.col("value") < 60, F.lit(True))).select("rec", "seq", "reset")


@query("w14_moving_mean", f"WITH {SAMPLES} SELECT rec, seq, round(sum(value) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6, 6) AS mean FROM samples")
def w14(spark, sf):
    return samples(spark, sf).select("rec", "seq", r(runs.moving_mean("value", _BY, _ON, 6)).alias("mean"))


@query("w16_index_fill", f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER ({_W}) AS k FROM samples),
    q AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {{'n': k, 'v': value}} END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS a,
      first_value(CASE WHEN value IS NOT NULL THEN {{'n': k, 'v': value}} END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM n)
    SELECT rec, seq, round(coalesce(value, a.v + (b.v - a.v) * (k - a.n) / (b.n - a.n), a.v, b.v), 6) AS value FROM q""")  # fmt: skip
def w16(spark, sf):
    return runs.short_gaps_filled(samples(spark, sf), _BY, _ON, "value", 1 << 40).select("rec", "seq", r(F.col("value")).alias("value"))


@query("w19_sliding_windows", f"""WITH {SAMPLES}, s AS (SELECT rec, min(t) AS t0, max(t) AS t1 FROM samples GROUP BY rec),
    c AS (SELECT rec, k, t0 + 216000 + k * 216000 AS centre FROM s, unnest(range(0, greatest(0, CAST(ceil((t1 - t0 - 432000 + 108000) / 216000) AS BIGINT)))) AS u(k) WHERE t1 - t0 > 432000)
    SELECT c.rec, c.k, count(*) AS n, round(avg(value), 6) AS mean FROM c JOIN samples x ON x.rec = c.rec AND x.t >= c.centre - 216000 AND x.t < c.centre + 216000 GROUP BY c.rec, c.k""")  # fmt: skip
def w19(spark, sf):
    """Overlapping windows that begin with the data: a row knows by arithmetic which windows hold it."""
    length, step = 432_000.0, 216_000.0
    s = samples(spark, sf)
    w = Window.partitionBy("rec")
    s = s.withColumn("t0", F.min("t").over(w)).withColumn("t1", F.max("t").over(w)).where(F.col("t1") - F.col("t0") > length)
    n = F.ceil((F.col("t1") - F.col("t0") - length + step / 2) / step)
    place = F.floor((F.col("t") - F.col("t0")) / step).cast("long")
    s = s.withColumn("n_windows", n).withColumn("k", F.explode(F.array(place - 1, place))).where((F.col("k") >= 0) & (F.col("k") < F.col("n_windows")))
    return s.groupBy("rec", "k").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("w21_last_duplicate", "SELECT o_custkey AS rec, o_orderdate AS t, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def w21(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("rec"), F.col("o_orderdate").alias("t")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))


@query("w33_segments", f"""WITH {SAMPLES}, d AS (SELECT *, t - lag(t) OVER ({_W}) AS step, coalesce(lag(value IS NULL) OVER ({_W}), true) AS was FROM samples),
    g AS (SELECT *, sum(CASE WHEN value IS NULL OR was OR step > 86400 THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS segment FROM d)
    SELECT rec, min(t) AS start, max(t) AS "end", count(*) AS n FROM g WHERE value IS NOT NULL GROUP BY rec, segment""")  # fmt: skip
def w33(spark, sf):
    return runs.segments(samples(spark, sf), _BY, "t", "value", 86400.0).select("rec", "start", "end", "n")


@query("w37_row_index", f"WITH {SAMPLES} SELECT rec, seq, row_number() OVER ({_W}) - 1 AS i FROM samples")
def w37(spark, sf):
    return samples(spark, sf).select("rec", "seq", (F.row_number().over(Window.partitionBy("rec").orderBy("t", "seq")) - 1).cast("long").alias("i"))


@query("p11_monotonic_times", """WITH RECURSIVE f AS (SELECT user_id AS rec, event_id AS seq, event_id * 37 % 997 AS c, event_id % 89 * 10 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    w(rec, seq, k, repaired) AS (SELECT rec, seq, k, CASE WHEN c > -1 THEN c ELSE greatest(n, 0) END FROM f WHERE k = 1
      UNION ALL SELECT f.rec, f.seq, f.k, CASE WHEN f.c > w.repaired THEN f.c ELSE greatest(f.n, w.repaired + 1) END FROM w JOIN f ON f.rec = w.rec AND f.k = w.k + 1)
    SELECT rec, seq, repaired FROM w""")  # fmt: skip
def p11(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("rec"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 997).alias("c"), (F.col("event_id") % 89 * 10).alias("n"))
    return trackers.monotonic_times(e, ["rec"], "seq", "c", "n").select("rec", "seq", "repaired")


@query("w38_module_status", f"""WITH {SAMPLES}, m AS (SELECT rec, list_sort(list(DISTINCT CAST(seq % 13 AS INTEGER)) FILTER (seq % 13 < 10)) AS f FROM samples GROUP BY rec)
    SELECT rec, array_to_string(coalesce(f, []), ',') AS found, array_to_string(list_filter(range(10), lambda x: NOT list_contains(coalesce(f, []), x)), ',') AS missing,
      CASE WHEN len(coalesce(f, [])) = 10 THEN 'complete' WHEN len(coalesce(f, [])) > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM m""")  # fmt: skip
def w38(spark, sf):
    from ..operators import quality

    s = samples(spark, sf).withColumn("m", (F.col("seq") % 13).cast("int"))
    out = quality.module_status(s, ["rec"], "m", MODULES)
    return out.select("rec", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("found", "missing")], "status")


@query("x1_time_windows", f"""WITH e AS (SELECT user_id AS rec, epoch_us(ts) // 1000000 AS s, value FROM events),
    w AS (SELECT rec, value, unnest([s // 43200 * 43200 - 43200, s // 43200 * 43200]) AS start FROM e)
    SELECT rec, start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY rec, start""")  # fmt: skip
def x1(spark, sf):
    """Fixed-step overlapping windows: the streaming operator over the whole table as one batch."""
    from ..streaming import streams

    e = table(spark, sf, "events").select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return streams.windowed(e, "24 hours", "12 hours").select("rec", F.unix_seconds("start").alias("start"), "n", r(F.col("mean")).alias("mean"))


@query("x2_sessions", """WITH e AS (SELECT user_id AS rec, epoch_us(ts) AS u FROM events),
    g AS (SELECT *, CASE WHEN lag(u) OVER w IS NULL OR u - lag(u) OVER w >= 43200000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY rec ORDER BY u)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY u ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT rec, min(u) AS start, count(*) AS n FROM h GROUP BY rec, s""")  # fmt: skip
def x2(spark, sf):
    from ..streaming import streams

    e = table(spark, sf, "events").select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return streams.sessions(e, "12 hours").select("rec", F.unix_micros("start").alias("start"), "n")


@query("j1_long_backward", ORACLES["j1_asof_backward"])
def j1_long(spark, sf):
    """The backward join with a recording dealt to days."""
    a, b = _sides(spark, sf)
    return asof.backward(a, b, ["rec"], "t", ["scenario"], cell=86400.0).select("rec", "seq", F.coalesce("scenario", F.lit(-1)).alias("scenario"))


@query("j3_long_interpolation", ORACLES["j3_interpolation"])
def j3_long(spark, sf):
    """The interpolating join with a recording dealt to hours, most of which hold no sample."""
    known = samples(spark, sf).where("value IS NOT NULL")
    return asof.interpolated(_grid(spark, sf), known, ["rec"], "t", "value", cell=3600.0).select("rec", "i", r(F.col("value")).alias("value"))


@query("j4_long_nearest", ORACLES["j4_nearest"])
def j4_long(spark, sf):
    """The nearest join with a recording dealt to days."""
    a, b = _sides(spark, sf)
    return asof.nearest(a, b, ["rec"], "t", ["scenario"], cell=86400.0).select("rec", "seq", "scenario")
