"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension until
every leaf is one shard of its share of the bytes.

All nodes of a level are split together. Each document has one 62-bit key per dimension: the value's code above (its
place among the corpus's bytes in the dimension's order), then bits of the text's CRC and of the id's hash, so that a cut can pass between documents of equal value (equal texts lie
together along every dimension and are parted by a cut only where it falls inside their group). A weighted median is
found by counting bytes in ever finer bins of the keys of all nodes; the driver sees at most BINS rows per node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

BITS, BINS = 62, 2048
#: Bins are refined until the bytes left in the bin of a cut are under this share of a shard, or the bin is one key.
TOLERANCE = 1e-3
#: Rows that one task numbers, about, for slots.
SLOT_ROWS = 100_000
DIMENSIONS = ("source", "lang", "size")


def _place(name: str) -> Column:
    """What a dimension is ordered by: text by code points (UTF-8 bytes keep that order), sizes in fine logarithmic steps."""
    if name == "size":
        return F.floor(F.log2(F.col("size") + 1) * 1024).cast("long")
    return F.encode(F.col(f"_{name}").cast("string"), "UTF-8")


def _measured(docs: DataFrame, keep: list[str], dimensions: tuple[str, ...], text: str, scratch: Scratch) -> DataFrame:
    """keep, size, text_crc32 and a key for each dimension. A value's code is the share of all bytes that lie before it in
    its dimension's order (null comes last), so widths of different dimensions compare: a range of codes is the share
    of the corpus that it spans. The codes' tables have a row per distinct value."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    wide = docs.select(*keep, *[F.col(d).alias(f"_{d}") for d in dimensions if d != "size"], (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    wide = scratch.table(wide.select(*keep, "size", "text_crc32", *[_place(d).alias(f"_at_{d}") for d in dimensions]), "sizes")
    for d in dimensions:
        at = F.col(f"_at_{d}")
        values = wide.groupBy(at).agg(F.sum("size").alias("bytes"))
        before = F.sum("bytes").over(Window.orderBy(at.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
        share = F.coalesce(before, F.lit(0)) / F.sum("bytes").over(Window.partitionBy(F.lit(1)))
        codes = scratch.table(values.select(at.alias("_v"), F.floor(share * ((1 << 20) - 1)).cast("long").alias(f"_code_{d}")), f"codes-{d}")
        wide = wide.join(codes, at.eqNullSafe(F.col("_v"))).drop("_v")
    tie = F.shiftleft(F.col("text_crc32"), 10).bitwiseOR(F.pmod(F.xxhash64(*keep), F.lit(1 << 10)))
    keys = F.array(*[F.shiftleft(F.col(f"_code_{d}"), 42).bitwiseOR(tie) for d in dimensions])
    return wide.select(*keep, "size", "text_crc32", keys.alias("keys"))


def assign(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """keep, size (UTF-8 bytes and 8), text_crc32, shard and slot for every row of docs; law "bytes": sizes near equal.

    Null texts count 8 bytes; null metadata values sort last; repeated rows take slots of their own; an empty table
    gives an empty result. Other columns aren't read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    points = scratch.table(_measured(docs, list(keep), dimensions, text, scratch), "points")
    total = points.agg(F.sum("size")).first()[0] or 0
    leaves = {0: (0, shards)}  # node: first shard, shards; node k has children 2 k + 1 and 2 k + 2
    tree: dict[int, tuple[int, int]] = {}  # node: axis, cut
    while any(n > 1 for _, n in leaves.values()) and total:
        at = points.withColumn("node", _node(tree))
        splitting = {k: v for k, v in leaves.items() if v[1] > 1}
        axis = _widest(at, splitting, len(dimensions))
        cuts = _medians(at, {k: (axis[k], (v[1] // 2) / v[1]) for k, v in splitting.items() if k in axis}, total / shards)
        tree |= {k: (axis[k], cut) for k, cut in cuts.items()}
        new = {}
        for k, (first, n) in leaves.items():
            if k in cuts:
                new |= {2 * k + 1: (first, n // 2), 2 * k + 2: (first + n // 2, n - n // 2)}
            else:
                new[k] = (first, 1)  # one shard, or a node without rows
        leaves = new
    shard = _of(F.col("node"), {k: first for k, (first, _) in leaves.items()})
    placed = points.withColumn("node", _node(tree)).select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"))
    return _slots(placed, list(keep), shards, points, scratch)


def _of(node: Column, values: dict[int, int]) -> Column:
    """A value by node, from an array of constants."""
    return F.get(F.array(*[F.lit(values.get(k, -1)).cast("long") for k in range(max(values, default=0) + 1)]), node)


def _node(tree: dict[int, tuple[int, int]]) -> Column:
    """The node of a row, walked down from the root."""
    if not tree:
        return F.lit(0)
    depth = int(math.log2(max(tree) + 1)) + 1
    axes, cuts = {k: a for k, (a, _) in tree.items()}, {k: c for k, (_, c) in tree.items()}

    def step(node, _):
        axis = F.coalesce(_of(node, axes), F.lit(-1))
        right = F.get(F.col("keys"), axis.cast("int")) > _of(node, cuts)
        return F.when(axis < 0, node).otherwise(2 * node + F.when(right, 2).otherwise(1)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _widest(at: DataFrame, nodes: dict[int, tuple[int, int]], dimensions: int) -> dict[int, int]:
    """For each node, the dimension with the widest range of keys."""
    spans = at.where(F.col("node").isin(list(nodes))).groupBy("node").agg(*[(F.max(F.get("keys", F.lit(d))) - F.min(F.get("keys", F.lit(d)))).alias(f"d{d}") for d in range(dimensions)]).collect()
    return {r["node"]: max(range(dimensions), key=lambda d: r[f"d{d}"]) for r in spans}


def _medians(at: DataFrame, nodes: dict[int, tuple[int, float]], shard_bytes: float) -> dict[int, int]:
    """For each node, the key up to which its share of the bytes lies, by ever finer bins."""
    if not nodes:
        return {}
    shift = BITS - int(math.log2(BINS))
    ranges = {k: [0, 0.0, None] for k in nodes}  # node: start of the bin, bytes before it, wanted
    cuts: dict[int, int] = {}
    while ranges:
        live = at.where(F.col("node").isin(list(ranges)))
        key = F.get("keys", _of(F.col("node"), {k: nodes[k][0] for k in ranges}).cast("int"))
        past = key - _of(F.col("node"), {k: v[0] for k, v in ranges.items()})
        binned = live.select("node", past.alias("past"), "size").where(f"past >= 0 AND past < {BINS << shift}")
        counted: dict[int, list] = {}
        for r in binned.groupBy("node", F.shiftright("past", shift).alias("bin")).agg(F.sum("size").alias("bytes")).collect():  # BINS rows for each node at most
            counted.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for k in list(ranges):
            start, before, want = ranges[k]
            bins = sorted(counted.get(k, []))
            if want is None:
                want = sum(b for _, b in bins) * nodes[k][1]
            for b, n in bins:
                if before + n >= want:
                    break
                before += n
            low = start + (b << shift)
            if shift == 0 or n <= TOLERANCE * shard_bytes:
                cuts[k] = low + (1 << shift) - 1 if before + n - want <= want - before else low - 1
                del ranges[k]
            else:
                ranges[k] = [low, before, want]
        shift = max(0, shift - int(math.log2(BINS)))
    return cuts


def _slots(placed: DataFrame, keep: list[str], shards: int, points: DataFrame, scratch: Scratch) -> DataFrame:
    """Gapless slots: rows are numbered inside parts of each shard, parts by a hash of the row, and start where the
    earlier parts end."""
    rows = points.count()
    parts = max(16, math.ceil(rows / shards / SLOT_ROWS))
    placed = scratch.table(placed.withColumn("part", F.pmod(F.xxhash64(*keep), F.lit(parts)).cast("int")), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy(*keep, "text_crc32", "size")
    numbered = placed.withColumn("inside", F.row_number().over(inside) - 1)
    out = numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return out.select(*keep, "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), (F.col("inside") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
