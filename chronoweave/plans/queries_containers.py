"""Queries over containers and video frames. Each plants, from the events, what a device or a probe would have written,
and must find what was planted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import new_folder
from ..functions import delimited
from ..functions import scalars as S
from ..operators import anonymize, frames, release
from ..sources import recordings, xdf_scan
from .base import query, r, table

#: A recording's events in order: k from 0, of n.
_PLACED = """placed AS (SELECT user_id AS rec, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def _placed(spark, sf):
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("rec"), "event_id", "value", "event_type", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("k"), F.count("*").over(w).alias("n"))


@query("s7_container_sync", f"""WITH {_PLACED} SELECT rec, k AS seq, round(10 + 0.5 * k + CASE WHEN k >= n // 2 THEN 7 ELSE 0 END, 2) AS t, round(value, 6) AS value FROM placed""")
def s7(spark, sf):
    """Containers of a steady device whose clock drifts, jitters and restarts half-way, with some wrong clock offsets,
    written on the executors; of two streams and two channels one is read back, in splits, with its true times."""
    p = _placed(spark, sf)
    late = F.col("k") >= F.floor(F.col("n") / 2)
    truth = 10 + 0.5 * F.col("k") + F.when(late, 7).otherwise(0)
    zero = F.when(late, 10 + 0.5 * F.floor(F.col("n") / 2) + 4).otherwise(2)
    device = (truth - zero) * (1 + F.when(late, 8e-5).otherwise(-1e-5 * (F.col("rec") % 7)))
    jitter = ((F.col("k") * 7) % 5 - 2) * 0.001
    at = p.select(F.concat(F.lit("rec"), F.col("rec").cast("string")).alias("file"), "k", "value", truth.alias("truth"), device.alias("device"), jitter.alias("jitter"))
    chunk = lambda df, place, stream, labels, samples, offset: df.select("file", place.alias("place"), F.lit(stream).alias("stream"), F.array(*map(F.lit, labels)).alias("labels"), F.lit(2.0).alias("rate"), samples.alias("samples"), offset.alias("offset"))
    sample = lambda *v: F.array(F.struct((F.col("device") + F.col("jitter")).alias("t"), F.array(*v).alias("values")))
    none, k = F.lit(None).cast("struct<time: double, value: double>"), F.col("k")
    wrong = F.when(F.floor(k / 2) % 6 == 3, 0.4).otherwise(0.0)
    chunks = chunk(at, 3 * k, "gaze", ["other", "value"], sample(F.lit(0.0), F.col("value")), none)
    chunks = chunks.unionByName(chunk(at, 3 * k + 1, "unread", ["x"], sample(F.lit(1.0)), none))
    chunks = chunks.unionByName(chunk(at.where(k % 2 == 0), 3 * k + 2, "gaze", ["other", "value"], F.array().cast("array<struct<t: double, values: array<double>>>"), F.struct(F.col("device").alias("time"), (F.col("truth") - F.col("device") + wrong).alias("value"))))
    files = xdf_scan.write_containers(chunks, new_folder(spark, "containers")).select("path")
    samples, _ = recordings.load(files, {"gaze": ["value"]}, split_bytes=1 << 16)
    return samples.select(F.regexp_extract("path", r"rec(\d+)\.xdf$", 1).cast("long").alias("rec"), "seq", r("t", 2).alias("t"), r(F.get("numbers", F.lit(0))).alias("value"))


@query("s5_side_by_side", """WITH s AS (SELECT user_id AS rec, epoch_us(ts) / 1e6 AS t, event_type, arg_min(CASE WHEN value <= 400 THEN value END, event_id) AS value FROM events WHERE event_type IN ('click', 'signup', 'view') GROUP BY ALL)
    SELECT rec, t, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'signup') AS signup, max(value) FILTER (event_type = 'view') AS view FROM s GROUP BY rec, t""")  # fmt: skip
def s5_streams(spark, sf):
    """Three streams of a recording side by side, by the operator that takes any number."""
    e = table(spark, sf, "events")
    s = e.select(
        F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("stream"), F.length("event_type").alias("stream_id"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.array(F.lit("v")).alias("labels"), F.array("value").alias("numbers"),
    )
    j = recordings.side_by_side(s, ["click", "signup", "view"], 400)
    return j.select(F.col("path").cast("long").alias("rec"), "t", *[F.col(f"`{c}.v`").alias(c) for c in ("click", "signup", "view")])


@query("s6_longest_by_name", """WITH s AS (SELECT user_id AS rec, CASE WHEN event_type IN ('click', 'view') THEN 'eye' ELSE 'body' END AS stream, length(event_type) AS id, count(*) AS n FROM events GROUP BY ALL)
    SELECT rec, stream, arg_max(id, n * 100 - id) AS stream_id, max(n) AS n FROM s GROUP BY rec, stream""")  # fmt: skip
def s6_streams(spark, sf):
    """Of several streams of a name the longest, of equally long ones the first, by the operator that recordings use."""
    name = F.when(F.col("event_type").isin("click", "view"), "eye").otherwise("body")
    s = table(spark, sf, "events").select(F.col("user_id").alias("path"), name.alias("stream"), F.length("event_type").alias("stream_id"))
    return recordings.longest(s).groupBy(F.col("path").alias("rec"), "stream", "stream_id").agg(F.count("*").alias("n"))


#: What a probe says of a recording's video, by the recording's number modulo 8: 0 packets that stand for frames, 1 reordered
#: packets, 2 a packet without a time, 3 two packets at one time, 4 another count than said, 5 frames at one time, 6 no
#: time base, 7 frames only, none of them a key frame.
_TICKS = "k * 1001 + rec + CAST(floor(value) AS BIGINT) % 500"
_INDEX = f"""{_PLACED}, indexed AS (
    SELECT rec, k AS frame, {_TICKS} AS tick, CASE WHEN rec % 8 = 7 THEN k = 0 ELSE k % 12 = 0 END AS key, CASE WHEN rec % 8 = 7 THEN 0 ELSE k - k % 12 END AS keyframe, CASE WHEN rec % 2 = 0 THEN 1 ELSE 1001 END AS num, 30000 AS den,
           first_value({_TICKS}) OVER (PARTITION BY rec ORDER BY k) AS origin FROM placed WHERE rec % 8 NOT IN (5, 6)),
    timed AS (SELECT *, CAST(tick - origin AS DOUBLE) * num / den AS time FROM indexed)"""


def _probed(spark, sf):
    p = _placed(spark, sf)
    kind, k = F.col("rec") % 8, F.col("k")
    video, tick = F.col("rec").cast("string").alias("video"), k * 1001 + F.col("rec") + F.floor("value") % 500
    one = p.where(k == 0)
    base = F.when(kind == 6, "0/1").when(F.col("rec") % 2 == 0, "2/60000").otherwise("1001/30000")
    streams = one.select(
        video, F.lit("H264").alias("codec_name"), base.alias("time_base"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("progressive").alias("field_order"), F.when(kind == 1, 2).otherwise(0).alias("has_b_frames"),
        F.when(kind == 4, (F.col("n") + 1).cast("string")).when(kind == 0, F.col("n").cast("string")).alias("nb_frames"), F.lit(0).alias("attached_pic"),
    )
    pts = F.when((kind == 2) & (k == 1), "N/A").when(((kind == 3) | (kind == 5)) & (k == 2), F.lag(tick).over(Window.partitionBy("rec").orderBy("k")).cast("string")).otherwise(tick.cast("string"))
    flags = F.when(k % 12 == 0, "K__").otherwise("___")
    packets = p.where(kind != 7).select(video, k.alias("place"), pts.alias("pts"), F.when((kind == 1) & (k > 0), (tick - 1).cast("string")).otherwise(pts).alias("dts"), flags.alias("flags"))
    best = F.when((kind == 5) & (k == 2), F.lag(tick).over(Window.partitionBy("rec").orderBy("k"))).otherwise(tick)
    shown = p.where(kind != 0).select(video, k.alias("place"), best.cast("string").alias("best_effort_timestamp"), F.when((kind != 7) & (k % 12 == 0), 1).otherwise(0).alias("key_frame"))
    return frames.frame_index(streams, packets, shown)


@query("s22_frame_index", f"""WITH {_INDEX} SELECT rec, frame, tick, key, keyframe, num, den, round(time, 9) AS time FROM timed""")
def s22(spark, sf):
    """Exact frame index of videos, from packets where they may stand for frames, else from frames."""
    i, _ = _probed(spark, sf)
    return i.select(F.col("video").cast("long").alias("rec"), "frame", "tick", "key", "keyframe", "num", "den", r("time", 9).alias("time"))


@query("s22_frame_audit", f"""WITH {_PLACED} SELECT rec, count(*) AS frames, CASE WHEN rec % 8 = 0 OR rec % 8 = 6 THEN 'packets' ELSE 'frames' END AS source, CASE rec % 8 WHEN 5 THEN 'duplicate timestamps' WHEN 6 THEN 'invalid time base' ELSE 'ready' END AS status FROM placed GROUP BY rec""")
def s22_audit(spark, sf):
    _, a = _probed(spark, sf)
    return a.select(F.col("video").cast("long").alias("rec"), "frames", "source", "status")


@query("g7_exact_frame_times", f"""WITH {_INDEX} SELECT p.rec, p.event_id, printf('%.15g', time) AS time FROM placed p JOIN timed t ON t.rec = p.rec AND t.frame = p.k WHERE p.rec % 5 <> 4""")
def g7(spark, sf):
    """Exact times for rows made frame by frame; recordings whose rows aren't their frames one to one get none (every
    fifth has its first row's number altered)."""
    i, _ = _probed(spark, sf)
    number = F.when((F.col("rec") % 5 == 4) & (F.col("k") == 0), F.col("k") + 3).otherwise(F.col("k"))
    rows = _placed(spark, sf).select(F.col("rec").cast("string").alias("video"), F.col("event_id").alias("place"), number.alias("frame_index"))
    timed, _ = frames.exact_times(rows, i)
    return timed.select(F.col("video").cast("long").alias("rec"), F.col("place").alias("event_id"), S.fifteen_digits(F.col("exact_time")).alias("time"))


_WANTED = f"""{_INDEX}, wanted AS (SELECT rec, event_id, value * (1 + rec % 2 * 20) / 20 - 0.5 AS t FROM placed),
    looked AS (SELECT w.rec, w.event_id, w.t, CASE WHEN a.time IS NULL OR (b.time IS NOT NULL AND b.time - w.t < w.t - a.time) THEN b.frame ELSE a.frame END AS frame, e.last
      FROM wanted w ASOF LEFT JOIN timed a ON w.rec = a.rec AND w.t >= a.time ASOF LEFT JOIN timed b ON w.rec = b.rec AND w.t <= b.time LEFT JOIN (SELECT rec, max(time) AS last FROM timed GROUP BY rec) e ON e.rec = w.rec),
    found AS (SELECT l.*, t.keyframe, CASE WHEN last IS NULL THEN 'no index' WHEN l.t < 0 THEN 'before' WHEN l.t > last THEN 'after' ELSE 'ready' END AS found FROM looked l LEFT JOIN timed t ON t.rec = l.rec AND t.frame = l.frame)"""


def _looked_up(spark, sf):
    i, _ = _probed(spark, sf)
    t = F.col("value") * (1 + F.col("rec") % 2 * 20) / 20 - 0.5
    return frames.lookup(_placed(spark, sf).select(F.col("rec").cast("string").alias("video"), "event_id", t.alias("time")), i)


@query("s25_frame_lookup", f"""WITH {_WANTED} SELECT rec, event_id, frame, keyframe, found FROM found""")
def s25(spark, sf):
    """The frame nearest to a time, and the key frame that its decoding begins with."""
    return _looked_up(spark, sf).select(F.col("video").cast("long").alias("rec"), "event_id", "frame", "keyframe", "found")


@query("s25_decode_ranges", f"""WITH {_WANTED}, o AS (SELECT rec, event_id, keyframe, frame, max(frame) OVER (PARTITION BY rec ORDER BY keyframe, frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found WHERE frame IS NOT NULL),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR keyframe - before >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY keyframe, frame, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT rec, min(keyframe) AS first, max(frame) AS last, count(*) AS parts FROM g GROUP BY rec, island""")  # fmt: skip
def s25_ranges(spark, sf):
    return frames.decode_ranges(_looked_up(spark, sf)).select(F.col("video").cast("long").alias("rec"), "first", "last", "parts")


#: A recording as a participant's visit.
_WHO = "'T' || lpad(CAST(rec % 1000 AS VARCHAR), 3, '0')", "'V' || CAST(1 + rec // 1000 AS VARCHAR)"


def _who(rec):
    return F.concat(F.lit("T"), F.lpad((rec % 1000).cast("string"), 3, "0")), F.concat(F.lit("V"), (1 + F.floor(rec / 1000)).cast("string"))


@query("g15_released_recordings", f"""WITH {_PLACED}, e AS (SELECT user_id AS rec, event_id, value, epoch(date_trunc('second', ts)) AS s FROM events),
    c AS (SELECT rec, value < 50 AS low, count(*) AS n FROM e GROUP BY rec, value < 50), w AS (SELECT rec, min(s) AS lo, max(s) AS hi, count(DISTINCT value < 50) AS files FROM e GROUP BY rec)
    SELECT 'R' || rec || '/LSL/R' || rec || '_VX_lsl' || CASE WHEN low OR files = 1 THEN '' ELSE '_1' END || '.xdf' AS target,
           strftime(TIMESTAMP '2000-01-01 02:00:00' + to_seconds(CAST(CASE WHEN low OR files = 1 THEN 0 ELSE hi - lo END AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '.25+02:00' AS created, 'speed' AS labels, n FROM c JOIN w USING (rec)""")  # fmt: skip
def g15(spark, sf):
    """A folder of recordings released: every file gets its anonymous name, then every record's clocks are moved so that
    its earliest is in the origin's second, simulator streams without their wall-clock channel. Read back."""
    e = table(spark, sf, "events")
    rec, low = F.col("user_id"), F.col("value") < 50
    w = Window.partitionBy("user_id")
    stamp = F.date_format(F.when(low, F.min("ts").over(w)).otherwise(F.max("ts").over(w)), "yyyy-MM-dd'T'HH:mm:ss")
    pid, visit = _who(rec)
    name = F.concat(pid, F.lit("_"), visit)
    chunks = e.select(
        F.concat(name, F.lit("/LSL/"), name, F.when(low, "_a").otherwise("_b")).alias("file"), F.concat(stamp, F.lit(".25+02:00")).alias("created"), F.col("event_id").alias("place"), F.lit("SILAB").alias("stream"),
        F.array(F.lit("Date"), F.lit("speed")).alias("labels"), F.lit(0.0).alias("rate"), F.array(F.struct(F.col("event_id").cast("double").alias("t"), F.array(F.lit(1.0), F.col("value")).alias("values"))).alias("samples"), F.lit(None).cast("struct<time: double, value: double>").alias("offset"),
    )
    root = new_folder(spark, "release")
    xdf_scan.write_containers(chunks, f"{root}/source")
    ids = e.select(F.upper(name).alias("key"), F.concat(F.lit("R"), rec.cast("string")).alias("random_id")).distinct()
    for at, plan in (("source", lambda f: release.anonymise_plan(f, ids)), ("named", release.time_shift_plan)):
        to = {"source": "named", "named": "shifted"}[at]
        files = release.found_under(spark, f"{root}/{at}").where("relative LIKE '%.xdf'")
        release.carried_out(plan(files), f"{root}/{to}").write.parquet(f"{root}/{to}-done")
    files = spark.read.parquet(f"{root}/shifted-done").where("status = 'written'").select("target", F.concat(F.lit(f"{root}/shifted/"), "target").alias("path"))
    samples, _ = recordings.load(files, {"SILAB": None}, synchronise=False, dejitter=False)
    n = samples.groupBy("path", F.array_join("labels", ",").alias("labels")).agg(F.count("*").alias("n"))
    return files.join(n, "path").join(xdf_scan.header_dates(files), "path").select("target", "created", "labels", "n")


@query("p18_nested_json", """SELECT event_id, '{"R' || user_id || '": [{"note": "R' || user_id || ' was at V0, not V' || (user_id % 7) || '1", "k": ' || (event_id % 9) || '}, null, ["R' || user_id || '_x"]]}' AS told FROM events""")
def p18(spark, sf):
    """Identities replaced in keys and texts of nested JSON."""
    pid, visit = F.concat(F.lit("T"), F.col("user_id").cast("string")), F.concat(F.lit("V"), (F.col("user_id") % 7).cast("string"))
    text = F.format_string('{"%s_%s": [{"note":"%s was at %s, not %s1","k":%d},null,["t%d_x"]]}', pid, visit, F.lower(pid), visit, visit, F.col("event_id") % 9, F.col("user_id"))
    return table(spark, sf, "events").select("event_id", anonymize.json_renamed(text, pid, visit, F.concat(F.lit("R"), F.col("user_id").cast("string"))).alias("told"))


@query("p23_shifted_lines", """SELECT event_id, event_id || ',"a ""b"", c",' || q || CAST(10000000 + event_id AS VARCHAR) || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '0' || q || ', x"y,z"' || CASE WHEN event_id % 3 = 0 THEN ',"open, end' ELSE ',' END AS line,
    event_id || ',' || q || CAST(9000000 + event_id AS VARCHAR) || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '0' || q || CASE WHEN event_id % 3 = 0 THEN ',"open, end' ELSE ',' END AS fewer FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '"' ELSE '' END AS q FROM events)""")  # fmt: skip
def p23(spark, sf):
    """A clock's cell moved where it stands, and lines without some cells; all other bytes stay."""
    k, q = F.col("event_id"), F.when(F.col("event_id") % 2 == 0, '"').otherwise("")
    time = F.concat(q, (9000000 + k).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("0"), q)
    lines = table(spark, sf, "events").select("event_id", F.concat(k.cast("string"), F.lit(',"a ""b"", c",'), time, F.lit(', x"y,z"'), F.when(k % 3 == 0, ',"open, end').otherwise(",")).alias("line"))
    bare, quote = delimited.unquoted(delimited.cell(F.col("line"), 2))
    moved = F.concat(quote, S.shifted_decimal(bare, F.lit(1000000)), quote)
    return lines.select("event_id", delimited.with_cell(F.col("line"), 2, moved).alias("line"), delimited.without_cells(F.col("line"), [1, 3]).alias("fewer"))
