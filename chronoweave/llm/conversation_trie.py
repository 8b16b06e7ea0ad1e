"""Prefix trie of conversations, without walking it: sorted conversations, the array of their longest common prefixes,
and that array's Cartesian tree.

1. Turns get places by one global sort, and conversations are rebuilt from them; a long one is cut into chunks of
   CHUNK turns, so that no row or task holds it whole.
2. Conversations are sorted turn by turn (by digests of role and text). Where some have several chunks, every chunk is
   first replaced by its place among all distinct chunks, which keeps the order and shortens the sequence CHUNK times.
3. lcp(k): how many turns the k-th shares with the one before. The nearest smaller values on both sides of k bound the
   conversations that share lcp(k) turns: a node of the Cartesian tree. They come from `nearest_smaller`, block by
   block with block minima, together with the node's aggregates: the smallest member, childless nodes, bytes shared.
4. Equal nodes are merged, each conversation that goes on by itself adds one, and a node is repeated for the depths
   between its parent's and its own, at which nothing branches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest_smaller import nearest_smaller
from .shared import Scratch

#: Turns of a chunk.
CHUNK = 1024
#: A conversation takes up to SPAN - 1 first turns of the first conversation of its FAMILY.
FAMILY, SPAN = 5, 9
_EMPTY = hashlib.sha256(b"").hexdigest()


def _placed(rows: DataFrame, order: list[Column], scratch: Scratch, tag: str) -> DataFrame:
    """rows sorted through all partitions, with part and row: rows of a part follow each other by row, parts by part."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return scratch.table(ranged.withColumn("_at", at).select(*rows.columns, F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("row")), tag)


def _numbered(rows: DataFrame, order: list[Column], scratch: Scratch, tag: str) -> DataFrame:
    """rows with their place in the order, from 0. Only a count for each partition is summed up in one task."""
    placed = _placed(rows, order, scratch, tag)
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(parts.select("part", before.alias("_before")), "part").withColumn("place", F.col("row") + F.col("_before")).drop("part", "row", "_before")


def own_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns of all conversations as (conv_id, id, bytes, part, row), and (conv_id, part, first, before, own): where a
    part's turns of a conversation begin, how many turns come before, and how many the conversation has. A hot
    conversation lies in many parts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed = _placed(turns, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("id"), F.col("tie")], scratch, "turns")
    parts = placed.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(of).alias("own"))
    return placed.select("conv_id", "id", "bytes", "part", "row"), scratch.table(parts, "parts")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations as (conv_id, depth from 1, id, bytes), and (conv_id, length) of each."""
    turns, parts = own_turns(conversations, scratch)
    convs = parts.groupBy("conv_id").agg(F.first("own").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPAN
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    first = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least(F.col("h"), F.coalesce("base_own", F.lit(0)))
    convs = scratch.table(convs.join(first, "base", "left").select("conv_id", "own", "h", "base", taken.alias("taken")), "rebuilding")
    # a turn's place is known from its part's row of `parts`: no hot conversation is one key
    placed = turns.join(parts.join(convs.drop("own", "base"), "conv_id"), ["conv_id", "part"])
    placed = placed.withColumn("place", F.col("row") - F.col("first") + F.col("before"))
    tails = placed.where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "id", "bytes")
    heads = placed.where(F.col("place") < SPAN - 1).select(F.col("conv_id").alias("base"), "place", "id", "bytes")
    heads = heads.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "id", "bytes")
    return tails.unionByName(heads), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _chunked(units: DataFrame, at: Column, *more: str) -> DataFrame:
    """conv_id, chunk and the units (conv_id, place, id, ...) of each chunk, in order."""
    parts = units.select("conv_id", F.floor(at / CHUNK).alias("chunk"), F.struct(at.alias("_at"), "id", *more).alias("u"))
    return parts.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("u")).alias("u"))


def sorted_conversations(chunks: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, length, k: the place of each among all, by its turns, then its id. Prefixes come first, and
    conversations that share their first d turns lie together."""
    keys = chunks.select("conv_id", "chunk", "ids")
    while (keys.agg(F.max("chunk")).first()[0] or 0) > 0:
        named = keys.withColumn("digest", F.sha2(F.array_join(F.transform("ids", lambda x: F.hex(x)), ","), 256))
        distinct = named.groupBy("digest").agg(F.first("ids").alias("ids"))
        ranks = _numbered(distinct, [F.col("ids")], scratch, "chunks").select("digest", F.col("place").alias("id"))
        keys = _chunked(named.select("conv_id", "chunk", "digest").join(ranks, "digest"), F.col("chunk"))
        keys = scratch.table(keys.select("conv_id", "chunk", F.transform("u", lambda x: x["id"]).alias("ids")), "keys")
    keyed = convs.join(keys.select("conv_id", "ids"), "conv_id", "left")
    keyed = keyed.withColumn("ids", F.coalesce("ids", F.array().cast(dict(keys.dtypes)["ids"])))
    return scratch.table(_numbered(keyed, [F.col("ids"), F.col("conv_id")], scratch, "sorted").select("conv_id", "length", F.col("place").alias("k")), "order")


def common_prefixes(chunks: DataFrame, order: DataFrame, scratch: Scratch) -> DataFrame:
    """k (from 1), v: turns that the k-th conversation shares with the one before, shared: their bytes; and of both the
    lengths and ids (prev_*). Chunks meet by place and number; the first that differs decides."""
    own = chunks.join(order.select("conv_id", "k"), "conv_id")
    before = own.select((F.col("k") + 1).alias("k"), "chunk", F.col("ids").alias("prev"))
    pairs = own.select("k", "chunk", "ids", "sizes", "bytes_before").join(before, ["k", "chunk"])
    differ = F.array_position(F.zip_with("ids", "prev", lambda a, b: a.eqNullSafe(b)), False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size("ids")).cast("int")
    pairs = pairs.withColumn("n", n)
    told = pairs.select("k", F.struct((F.col("n") == CHUNK).alias("whole"), "chunk", (F.col("chunk") * CHUNK + F.col("n")).alias("v"), (F.col("bytes_before") + F.aggregate(F.slice("sizes", 1, F.col("n")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("shared")).alias("s"))
    # the first chunk that isn't whole, else the last whole one
    ended, full = F.min(F.when(~F.col("s.whole"), F.struct("s.chunk", "s.v", "s.shared"))), F.max(F.struct("s.chunk", "s.v", "s.shared"))
    told = told.groupBy("k").agg(F.coalesce(ended, full).alias("s")).select("k", "s.v", "s.shared")
    last = order.select((F.col("k") + 1).alias("k"), F.col("conv_id").alias("prev_id"), F.col("length").alias("prev_length"))
    both = order.join(last, "k").join(told, "k", "left")
    return scratch.table(both.select("k", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("shared", F.lit(0)).alias("shared"), "conv_id", "length", "prev_id", "prev_length"), "lcp")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conversation: each node's count and hash of ids, taken up one by one."""
    now, digest, n = None, None, 0
    schema = pa.schema([("l", pa.int64()), ("m", pa.int64()), ("ends", pa.int64()), ("sha", pa.string())])
    row = lambda: ([now[0]], [now[1]], [n], [digest.hexdigest()])
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for left, m, conv in zip(*(batch.column(c).to_pylist() for c in ("l", "m", "conv_id")), strict=True):
            if (left, m) != now:
                if now:
                    for to, x in zip(out, row(), strict=True):
                        to += x
                now, digest, n = (left, m), hashlib.sha256(), 0
            digest.update(f",{conv}".encode() if n else f"{conv}".encode())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row(), schema, strict=True)], schema=schema)


def trie(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; ties by role, then the digest of role and text; repeated rows are turns of
    their own. Null roles and texts are empty ones. Rows without a conv_id belong to no conversation and make no node.
    Other columns aren't read; an empty table has no node, not even a root. Long conversations and texts are handled by
    chunks and digests. The hash of a node's ids is one sequence by its nature: ids of one node are streamed, sorted,
    through one task, without being held."""
    scratch = scratch or Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, scratch)
    chunks = _chunked(turns, F.col("depth") - 1, "bytes").select("conv_id", "chunk", F.transform("u", lambda x: x["id"]).alias("ids"), F.transform("u", lambda x: x["bytes"]).alias("sizes"))
    chunks = scratch.table(chunks, "chunks")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = chunks.select("conv_id", "chunk", F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bytes_before"))
    chunks = chunks.join(sums, ["conv_id", "chunk"])
    order = sorted_conversations(chunks, convs, scratch)
    n = order.count()
    lcp = common_prefixes(chunks, order, scratch)

    entries = lcp.select("k", "v", F.least("conv_id", "prev_id").alias("low"), (F.col("v") < F.col("prev_length")).cast("long").alias("leaves"), "shared")
    near = nearest_smaller(scratch.table(entries, "entries"), n - 1, scratch)
    up = F.coalesce("l_val", F.lit(-1)) >= F.coalesce("r_val", F.lit(-1))
    near = near.select(
        "k", F.coalesce("l_pos", F.lit(0)).alias("l"), (F.coalesce("r_pos", F.lit(n)) - 1).alias("r"), F.col("v").alias("m"),
        F.when(up, F.coalesce("l_val", F.lit(-1))).otherwise(F.col("r_val")).alias("p"), F.when(up, F.col("l_pos")).otherwise(F.col("r_pos")).alias("up"),
        F.least("l_low", "low", "r_low").alias("conv_id"), (F.col("leaves") + F.col("l_leaves") + F.col("r_leaves") + 1).alias("n_leaves"), (F.col("shared") + F.col("l_shared") + F.col("r_shared")).alias("shared"),
    )
    near = scratch.table(near, "near")
    same = [c for c in near.columns if c not in ("k", "l", "m")]
    inner = near.groupBy("l", "m").agg(F.count("*").alias("cuts"), *[F.min(c).alias(c) for c in same])

    # each conversation ends at a node of the array, or goes on by itself
    of = order.join(lcp.select("k", F.col("v").alias("here")), "k", "left")
    of = of.join(lcp.select((F.col("k") - 1).alias("k"), F.col("v").alias("next")), "k", "left")
    of = of.select("k", "conv_id", "length", F.coalesce("here", F.lit(-1)).alias("here"), F.coalesce("next", F.lit(-1)).alias("next"))
    of = scratch.table(of, "neighbours")
    alone = F.col("length") > F.greatest("here", "next")
    tips = of.where(alone).select(
        F.col("k").alias("l"), F.col("length").alias("m"), F.lit(0).cast("long").alias("cuts"), F.col("k").alias("r"), F.greatest("here", "next").alias("p"),
        F.when(F.greatest("here", "next") >= 0, F.when(F.col("here") >= F.col("next"), F.col("k")).otherwise(F.col("k") + 1)).alias("up"), "conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("shared"),
    )
    at = of.where(~alone).select(F.when(F.col("here") == F.col("length"), F.col("k")).otherwise(F.col("k") + 1).alias("k"), F.col("conv_id").alias("member"))
    ended = at.join(near.select("k", "l", "m"), "k").select("l", "m", F.col("member").alias("conv_id")).unionByName(tips.select("l", "m", "conv_id"))
    ends = ended.repartition("l", "m").sortWithinPartitions("l", "m", "conv_id").mapInArrow(_ends, "l long, m long, ends long, sha string")

    nodes = inner.select(*tips.columns).unionByName(tips).join(ends, ["l", "m"], "left")
    nodes = nodes.join(near.select(F.col("k").alias("up"), F.col("conv_id").alias("parent")), "up", "left")
    nodes = scratch.table(nodes.drop("up"), "nodes")

    # depths between a node's parent and itself; what precedes a depth matters where several conversations share it
    each = nodes.withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("m"))))
    deep = chunks.join(order.select("conv_id", F.col("k").alias("l")), "conv_id").select("l", "chunk", "sizes", "bytes_before")
    shared = nodes.where("r > l AND m > 0").select("l", F.posexplode(F.sequence(F.greatest(F.col("p") + 1, F.lit(1)), F.col("m"))).alias("_", "depth"))
    # by chunk first, so that a long shared conversation's sizes are looked up chunk by chunk
    wanted = shared.select("l", "depth", F.floor((F.col("depth") - 1) / CHUNK).alias("chunk")).groupBy("l", "chunk").agg(F.collect_set("depth").alias("depths"))
    running = deep.join(wanted, ["l", "chunk"]).select("l", "chunk", "depths", "bytes_before", F.posexplode("sizes").alias("i", "size"))
    running = running.withColumn("depth", F.col("chunk") * CHUNK + F.col("i") + 1)
    sofar = F.sum("size").over(Window.partitionBy("l", "chunk").orderBy("depth")) - F.col("size") + F.col("bytes_before")
    running = running.select("l", "depth", sofar.alias("before"), F.array_contains("depths", F.col("depth")).alias("asked")).where("asked").drop("asked")

    each = each.join(running, ["l", "depth"], "left")
    top = F.col("depth") == F.col("m")
    first = F.col("depth") == F.col("p") + 1
    return each.select(
        "conv_id", "depth", F.when(first, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), (F.col("r") - F.col("l") + 1).alias("n_convs"),
        F.when(~top, F.lit(1)).when(F.col("cuts") == 0, F.lit(0)).otherwise(F.col("cuts") + 1 - F.coalesce("ends", F.lit(0))).cast("long").alias("n_children"), "n_leaves",
        (F.col("shared") - (F.col("r") - F.col("l")) * F.coalesce("before", F.lit(0))).cast("long").alias("saved_tokens"),
        F.when(top, F.coalesce("sha", F.lit(_EMPTY))).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )


#: The trie in DuckDB: prefixes named by the hash of their turns, counted along every path. CRC-32 is told bit by bit.
ORACLE = f"""WITH told AS MATERIALIZED (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    counted AS MATERIALIZED (
      SELECT conv_id, count(*) AS own, conv_id - conv_id % {FAMILY} AS base,
             xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % {SPAN} AS h
      FROM told GROUP BY conv_id),
    convs AS MATERIALIZED (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM counted c LEFT JOIN counted b ON b.conv_id = c.base),
    turns AS MATERIALIZED (
      SELECT c.conv_id, pos + 1 AS depth, role, text FROM convs c JOIN told t ON t.conv_id = c.base AND pos < taken
      UNION ALL SELECT c.conv_id, pos - h + taken + 1, role, text FROM convs c JOIN told t USING (conv_id) WHERE pos >= h),
    paths AS MATERIALIZED (
      SELECT conv_id, depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, octet_length(encode(text)) AS bytes FROM turns
      UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
    ended AS (SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM paths JOIN lengths USING (conv_id) WHERE depth = length GROUP BY depth, key),
    nodes AS MATERIALIZED (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY depth, key),
    parents AS MATERIALIZED (SELECT n.depth, n.key, p.key AS parent_key FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
    children AS MATERIALIZED (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
    below AS (
      SELECT p.depth, p.key, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (c.n_children IS NULL) AS n_leaves
      FROM nodes n LEFT JOIN children c USING (depth, key) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, b.n_leaves,
           CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
    FROM nodes n JOIN parents p ON p.depth = n.depth AND p.key = n.key LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.key = p.parent_key
    LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key JOIN below b ON b.depth = n.depth AND b.key = n.key LEFT JOIN ended e ON e.depth = n.depth AND e.key = n.key"""
