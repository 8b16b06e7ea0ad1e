"""Near-duplicate documents by HyperMinHash.

A document's shingles are dealt to buckets by hash; a bucket's register holds the smallest hash's leading-zero count
and ten mantissa bits (16 bits in all), and empty buckets borrow from a bucket that a fixed random order names, so that two
registers agree with the sets' Jaccard similarity as probability. Bands of registers are hashed into LSH keys. Pairs
that share a key are estimated from all registers, corrected for accidental agreement, and, unless clearly below the
threshold, verified on the full shingle sets.

Work never squares a group. Equal sets are one class from the start. In a bucket, members are compared with two
representatives, and components are formed. Then only buckets that still hold several components go on. A member stays
as long as an exact bound lets it have a partner there: the shingles that no other open set has are in no intersection.
Of what is left, the members outside a bucket's largest component meet the others, and a pair is made only if a second
exact bound allows a link: besides those lone shingles, bitmaps of the shared ones (a bit that one set has and the
other lacks stands for a shingle at least). So nothing that the bands bring together goes unlinked; pairs inside one
component can't change the result and are never made.

Names and pairs of sets grow with the corpus, so their joins with the sets and the texts are merge joins at every size:
what a small corpus costs foretells a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash as H
from .shared import Scratch

MANTISSA = 10
#: Bands, and how likely a pair at the threshold may share none: rows per band are as many as that allows (6 for 0.85:
#: 6e-9, 5 for 0.8: 1.3e-7).
BANDS, MISS = 40, 1.5e-7
#: Pairs are verified unless the estimate is so far, or so many standard deviations, below the threshold.
SLACK, DEVIATIONS = 0.15, 5.5
#: How often sets without a possible partner are set aside, which leaves more shingles to one set alone.
PRUNINGS = 2
#: Longs in a set's bitmap.
LONGS = 16


def rows_per_band(threshold: float) -> int:
    """The most rows that keep a pair at the threshold; thresholds too low for BANDS bands are refused."""
    if not 0 < threshold <= 1:
        raise ValueError(f"no similarity: {threshold}")
    rows = 0
    while rows < 16 and (1 - threshold ** (rows + 1)) ** BANDS <= MISS:
        rows += 1
    if not rows:
        raise ValueError(f"{BANDS} bands would lose pairs at a similarity of {threshold}")
    return rows


def least_estimate(threshold: float, m: int) -> float:
    """Estimates of pairs at the threshold, from m registers, are above this."""
    return threshold - max(SLACK, DEVIATIONS * (threshold * (1 - threshold) / m) ** 0.5)


def _order(m: int) -> np.ndarray:
    """For each register a fixed random order of all registers to borrow from."""
    return np.argsort(np.random.default_rng(20240501).random((m, m)), axis=1).astype(np.int32)


def registers(hashes: np.ndarray, ends: np.ndarray, m: int, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (sets, m) as uint16; sets without members have zeros."""
    n = len(ends) - 1
    own = np.zeros((n, m), dtype=np.uint16)
    if len(hashes):
        owner = np.repeat(np.arange(n), np.diff(ends))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        value = H.mixed(hashes, 303)
        at = owner * m + bucket.astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # hashes are sorted, so a set's buckets are too
        low = np.minimum.reduceat(value, start)
        length = np.frexp(low.astype(np.float64))[1]
        length = np.clip(length, 1, 64)
        zeros = (64 - length).astype(np.uint64)
        mantissa = ((low << (zeros + np.uint64(1)).clip(max=np.uint64(63))) >> np.uint64(64 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
        own.reshape(-1)[at[start]] = ((np.minimum(zeros, 62) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16) + 1
    full = own.copy()
    some = np.flatnonzero(own.any(axis=1))
    for t in range(8):
        gaps = full == 0
        if not gaps[some].any():
            return full
        full = np.where(gaps, own[:, order[:, t]], full)
    for i in some[(full[some] == 0).any(axis=1)]:
        gaps, there = np.flatnonzero(full[i] == 0), np.flatnonzero(own[i])
        full[i, gaps] = own[i, there[rank[np.ix_(gaps, there)].argmin(axis=1)]]
    return full


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    rows = regs.shape[1] // bands
    cut = regs.reshape(len(regs), bands, rows).astype(np.uint64)
    sums = np.zeros(cut.shape[:2], dtype=np.uint64)
    for r in range(rows):
        sums = H.mixed(sums + cut[:, :, r], r)
    return H.mixed(sums + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


SKETCH = "doc_id long, text_key long, n_shingles long, class binary, bands array<long>"


def _sketch(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _order(m)
        rank = np.argsort(order, axis=1).astype(np.int32)
        seen: set[bytes] = set()  # copies inside a task carry no bands
        for batch in batches:
            ids, text_keys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in H.blocks(texts):
                hashes, ends = H.shingle_sets(texts[a:b], k)
                keys = H.set_keys(hashes, ends)
                lsh = band_keys(registers(hashes, ends, m, order, rank), bands)
                new = []
                for key in keys:
                    new.append(key is not None and key not in seen)
                    if new[-1]:
                        seen.add(key)
                if len(seen) > 2_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        text_keys.slice(a, b - a),
                        pa.array(np.diff(ends)),
                        pa.array(keys, pa.binary()),
                        pa.array([r if x else None for r, x in zip(lsh, new, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "class", "bands"],
                )

    return run


SETS = "class binary, regs binary, members array<long>"


def _sets(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _order(m)
        rank = np.argsort(order, axis=1).astype(np.int32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in H.blocks(texts):
                hashes, ends = H.shingle_sets(texts[a:b], k)
                regs = [r.tobytes() for r in registers(hashes, ends, m, order, rank)]
                members = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(H.set_keys(hashes, ends), pa.binary()), pa.array(regs, pa.binary()), members], ["class", "regs", "members"])

    return run


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers: the share that agrees, less what agrees by accident. Two different
    minima agree by accident if they have the same leading zeros and mantissa: about sum over z of 4**-z / 2**10 / 3."""
    accident = 1 / 3 / (1 << MANTISSA)
    return ((a == b).mean(axis=1) - accident) / (1 - accident)


def _linked(m: int, num: int, den: int):
    """Of pairs with their registers and sets those that are links: estimated first, then verified."""
    least = least_estimate(num / den, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, m) for c in ("ra", "rb"))
            keep = estimate(x, y) >= least
            left, right = batch.column("sa"), batch.column("sb")
            for i in np.flatnonzero(keep):
                u, v = (np.asarray(s[int(i)].values).astype(np.int64).view(np.uint64) for s in (left, right))
                at = np.minimum(np.searchsorted(u, v), len(u) - 1)
                common = int((u[at] == v).sum())
                keep[i] = den * common >= num * (len(u) + len(v) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


BITMAP = "class binary, alone long, " + ", ".join(f"b{k} long" for k in range(LONGS))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the members that aren't the set's alone, and how many are."""
    for batch in batches:
        members, own = batch.column("members"), batch.column("own")
        bits, alone = np.zeros((batch.num_rows, LONGS), dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            mine = np.asarray(members[i].values).astype(np.int64)
            if own[i].is_valid:
                lone = np.asarray(own[i].values).astype(np.int64)
                alone[i] = len(lone)
                mine = mine[~np.isin(mine, lone)]
            at = H.mixed(mine.view(np.uint64), 404) % np.uint64(64 * LONGS)
            np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(alone), *[pa.array(bits[:, k].astype(np.int64)) for k in range(LONGS)]], ["class", "alone", *[f"b{k}" for k in range(LONGS)]])


class _Linker:
    """Candidate pairs of classes to links, with the sets of all classes that share a bucket with another."""

    def __init__(self, sets: DataFrame, scratch: Scratch, num: int, den: int, m: int):
        self.sets, self.scratch, self.num, self.den, self.m = sets, scratch, num, den, m

    def alive(self, open_: DataFrame) -> DataFrame:
        """class, members of the open sets."""
        return self.sets.select("class", "members").join(open_.select("class").distinct().hint("merge"), "class", "left_semi")

    def lone(self, alive: DataFrame) -> DataFrame:
        """shingle, class: the shingles that one set alone of the open ones has."""
        return alive.select("class", F.explode("members").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")

    def possible(self, open_: DataFrame) -> DataFrame:
        """Members of open buckets (band, class, label, size) that may have a partner there, with alone, the number of
        shingles that no other member has, and bitmaps of the others. A link needs num * (size + size) <= (num + den) *
        intersection, and the intersection is at most either's shared shingles; the bucket's smallest set is the best
        partner by size."""
        for _ in range(PRUNINGS):
            alone = self.lone(self.alive(open_)).groupBy("class").agg(F.count("*").alias("alone"))
            told = open_.join(alone, "class", "left").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0)))
            best = told.groupBy("band").agg(F.min("size").alias("least"), F.max("shared").alias("most"))
            may = self.num * (F.col("size") + F.col("least")) <= (self.num + self.den) * F.least("shared", "most")
            left = told.join(best, "band").where(may).select("band", "class", "label", "size")
            kept = self.scratch.table(_mixed_buckets(left), "possible")
            self.scratch.drop(open_)
            open_ = kept
        alive = self.alive(open_)
        own = self.lone(alive).groupBy("class").agg(F.collect_list("shingle").alias("own"))  # at most a set's size
        return open_.join(alive.join(own, "class", "left").mapInArrow(_bitmaps, BITMAP), "class")

    def links(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Of pairs (a, b) of classes those that are links."""
        side = lambda name: self.sets.select(F.col("class").alias(name), F.col("regs").alias(f"r{name}"), F.col("members").alias(f"s{name}"))
        both = pairs.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a").select("a", "b", "ra", "rb", "sa", "sb")
        return self.scratch.table(both.mapInArrow(_linked(self.m, self.num, self.den), "a binary, b binary"), f"links-{tag}")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label for every node of links (a, b): the smallest node reachable. Smallest labels pass along links and
    labels jump to their label's label, so the rounds grow with the logarithm of a component's diameter."""
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        passed = label.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        far = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = scratch.table(passed.join(far, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "label")
        moved = jumped.where("label <> was").limit(1).count()
        scratch.drop(label)
        label = jumped
        if not moved:
            scratch.drop(both)
            return label.select("node", "label")


def _clustered(docs: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """cluster's columns and text_key, a hash of the text that tells rows of one doc_id apart."""
    rows = rows_per_band(num / den)
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sketches = scratch.table(narrow.mapInArrow(_sketch(k, BANDS, rows), SKETCH), "sketches")
    banded = sketches.where("bands IS NOT NULL AND doc_id IS NOT NULL").select("class", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("class", "size")).alias("low"), F.max(F.struct("class", "size")).alias("high")).where("low.class <> high.class")
    members = scratch.table(banded.join(shared, "band").dropDuplicates(["band", "class"]), "members")

    known = sketches.where("class IS NOT NULL AND doc_id IS NOT NULL")
    heads = known.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("head"))
    need = scratch.table(heads.join(members.select("class").distinct(), "class", "left_semi").select("head.*"), "need")
    texts = narrow.join(need.hint("merge"), ["doc_id", "text_key"], "left_semi").select("text")
    sets = scratch.table(texts.mapInArrow(_sets(k, BANDS * rows), SETS).where("class IS NOT NULL").dropDuplicates(["class"]), "sets")
    linker = _Linker(sets, scratch, num, den, BANDS * rows)

    # links need sets of like sizes
    ends = members.select(F.struct("class", "size").alias("x"), F.explode(F.array("low", "high")).alias("y")).where("x.class <> y.class")
    ends = ends.where(f"{den} * least(x.size, y.size) >= {num} * greatest(x.size, y.size)")
    star = ends.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    links = linker.links(star, "star")
    label = components(links, scratch)
    named = members.select("band", "class", "size").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_ = scratch.table(_mixed_buckets(named), "open")
    across = scratch.table(_across(scratch.table(linker.possible(open_), "bitmaps"), num, den, scratch).distinct(), "across")
    if across.limit(1).count():
        more = linker.links(across, "across")
        links = links.unionByName(more)
        label = components(links, scratch)
    classes = heads.join(label.withColumnRenamed("node", "class"), "class", "left").select("class", "head.doc_id", F.coalesce("label", "class").alias("label"))
    first = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = scratch.table(classes.join(first, "label").select("class", "component_id"), "named")
    scratch.drop(sets, members)
    out = sketches.select("doc_id", "text_key", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def cluster(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text): links where den * intersection >=
    num * union of k-word shingle sets; component_id is the smallest doc_id reachable.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id stay rows of their
    own. A row without doc_id links nothing, has no component (null) and is kept. An empty table gives an empty
    result; other columns aren't read. Similarities too low for the bands are refused (rows_per_band).
    """
    return _clustered(docs, k, num, den, scratch or Scratch(docs.sparkSession, "neardup")).drop("text_key")


def _mixed_buckets(named: DataFrame) -> DataFrame:
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    return named.join(mixed, "band", "left_semi")


def _across(possible: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs across components whose sizes, lone shingles and bitmaps allow a link: each bucket's members outside its
    largest component with all others."""
    counts = possible.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    x = possible.join(main, "band").where("label <> main")
    y = possible.select("band", F.col("class").alias("b"), F.col("label").alias("other"), F.col("size").alias("size_b"), F.col("alone").alias("alone_b"), *[F.col(f"b{k}").alias(f"y{k}") for k in range(LONGS)])
    lacks = lambda p, q: " + ".join(f"bit_count({p}{k} & ~{q}{k})" for k in range(LONGS))
    most = f"least(size - alone - ({lacks('b', 'y')}), size_b - alone_b - ({lacks('y', 'b')}))"
    may = f"label <> other AND (other = main OR class < b) AND {num} * (size + size_b) <= {num + den} * {most}"
    return x.join(y, "band").where(may).select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for near-duplicates of a document with a smaller doc_id, with docs' own columns. Rows of
    one doc_id and different texts are judged each; rows without doc_id and repeated rows stay."""
    scratch = Scratch(docs.sparkSession, "neardup")
    dropped = scratch.table(_clustered(docs, k, num, den, scratch).where("NOT kept").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text")).distinct(), "dropped")
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_text"))
    return docs.join(dropped, same, "left_anti")
