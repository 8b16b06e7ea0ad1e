"""Benchmark decontamination by the CGK embedding.

A random walk reads a window of words and writes a string: at each step it writes the current word and moves on or
stays, as a random bit of (step, word) says. Windows of the same words have the same walk, and windows that differ near
their end mostly too. The string's hash is the window's signature. Windows are so short that a passage within the
edits allowed has one without an edit, and every window of item and text is walked: no passage is missed, at any
length. Whatever meets a benchmark item's signature is verified by exact edit distance of the whole item against the
surrounding words.

Items are the stated query set. Their signatures go to the tasks in blocks of a bounded size; every block is probed
with all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash as H

#: Characters of benchmark items that one block holds.
ITEM_BLOCK = 4_000_000
#: Share of an item's words that may be edited.
EDITS = 0.15
_TABLE_BITS = 22


def window_of(n: int, edits: float) -> int:
    """Window length for an item of n words: of its pieces of that length, one more than it may have edits, one has
    none."""
    return max(1, n // (int(edits * n) + 1))


def signatures(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Signatures of the windows of x that begin at starts; x has 0 where no word is, at least twice `length` times
    at its end."""
    out = np.zeros(len(starts), dtype=np.uint64)
    odd = H.mixed(np.arange(2 * length, dtype=np.uint64), 999) | np.uint64(1)
    coins = [H.mixed(x, 1000 * length + half) for half in range((2 * length - 1) // 64 + 1)]
    for begin in range(0, len(starts), 1 << 15):
        s = starts[begin : begin + (1 << 15)]
        part = out[begin : begin + (1 << 15)]
        at, end, bit = s.copy(), s + length, np.empty(len(s), dtype=np.uint64)
        for step in range(2 * length):
            part += np.where(at < end, x[at], np.uint64(0)) * odd[step]  # a walk past its window writes blanks
            np.take(coins[step // 64], at, out=bit, mode="clip")
            bit >>= np.uint64(step % 64)
            bit &= np.uint64(1)
            at += bit.view(np.int64)
    return H.mixed(out + np.uint64(1000 * length))


def _padded(words: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with `pad` zeros after each text, and where each text begins there."""
    n = np.diff(ends)
    begins = ends[:-1] + pad * np.arange(len(n))
    x = np.zeros(len(words) + pad * (len(n) + 1), dtype=np.uint64)
    x[np.arange(len(words)) + np.repeat(pad * np.arange(len(n)), n)] = np.where(words == 0, np.uint64(1), words)
    return x, begins


class Index:
    """Signatures of benchmark items, by window length."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        words, ends = H.word_hashes([t for _, t in items])
        self.edits = edits
        self.ids = [i for i, _ in items]
        self.items = [words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.tables = {}
        by_window: dict[int, list[int]] = {}
        for i, w in enumerate(self.items):
            if len(w):
                by_window.setdefault(window_of(len(w), edits), []).append(i)
        for length, members in sorted(by_window.items()):
            own = [self.items[i] for i in members]
            x, begins = _padded(np.concatenate(own), np.concatenate([[0], np.cumsum([len(w) for w in own])]), 2 * length)
            offset = np.concatenate([np.arange(len(w) - length + 1) for w in own])
            which = np.repeat(np.arange(len(own)), [len(w) - length + 1 for w in own])
            sig = signatures(x, begins[which] + offset, length)
            order = np.argsort(sig, kind="stable")
            sig = sig[order]
            maybe = np.zeros(1 << _TABLE_BITS, dtype=bool)
            maybe[(sig >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.tables[length] = (sig, np.array(members)[which][order], offset[order], maybe)

    def search(self, texts: list) -> list[tuple[int, int, int, int]]:
        """(row, item, edit distance, first word) for every text and every item that it has a passage of."""
        words, ends = H.word_hashes(texts)
        if not len(words) or not self.tables:
            return []
        x, begins = _padded(words, ends, 2 * max(self.tables))
        rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        first = np.arange(len(words)) - ends[rows]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for length, (sig, which, offset, maybe) in self.tables.items():
            line = signatures(x, begins[rows] + first, length)
            hit = np.flatnonzero(maybe[(line >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(sig, line[hit], "left"), np.searchsorted(sig, line[hit], "right")
            for h, a, b in zip(hit[high > low], low[high > low], high[high > low], strict=True):
                r = int(rows[h])
                for j in range(a, b):
                    key, start = (r, int(which[j])), int(first[h] - offset[j])
                    if (*key, start) not in seen and found.get(key, (1, 0))[0] > 0:  # an exact copy can't be bettered
                        seen.add((*key, start))
                        self._verify(found, key, words[ends[r] : ends[r + 1]], start)
        return [(r, self.ids[i], d, at) for (r, i), (d, at) in sorted(found.items()) if d >= 0]

    def _verify(self, found: dict, key: tuple[int, int], text: np.ndarray, start: int) -> None:
        item = self.items[key[1]]
        most = int(self.edits * len(item))
        begin = max(0, start - most - 1)
        region = text[begin : max(0, start) + len(item) + most + 1]
        there = set(region.tolist())
        if sum(w not in there for w in item.tolist()) > most:  # each such word is an edit
            return
        distance, end = passage_distance(item, region)
        if distance <= most and distance < found.get(key, (most + 1, 0))[0]:
            found[key] = (distance, begin + max(0, end - len(item)))


def passage_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance, in words, of item to any passage of region, and where that passage ends."""
    row = np.zeros(len(region) + 1, dtype=np.int64)  # a passage may begin anywhere
    place = np.arange(len(region) + 1)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size > ITEM_BLOCK:
            yield block
            block, size = [], 0
    yield block


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in H.blocks(texts):
                got = index.search(texts[a:b])
                columns = [[ids[a + r] for r, *_ in got], *[[g[k] for g in got] for k in (1, 2, 3)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "edits", "first_word"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, first_word: a row for each row of docs and each item of which it has a passage within
    edits * the item's words (A-Z lower-cased; words are runs without ASCII white space).

    Null and empty texts have no passages and items without words none either; equal items and repeated rows are
    each reported; a null doc_id is carried. Empty tables give an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block, edits))  # at most ITEM_BLOCK characters, and a signature a word
        part = narrow.mapInArrow(_search(shared), "doc_id long, item_id long, edits long, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def _flags(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bad = np.zeros(len(texts), dtype=bool)
            for a, b in H.blocks(texts):
                for r, *_ in index.search(texts[a:b]):
                    bad[a + r] = True
            yield batch.filter(pa.array(~bad))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of docs without a passage of any item, with docs' own columns. Rows never leave their partition."""
    for block in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, edits))
        docs = docs.mapInArrow(_flags(shared, docs.columns.index("text")), docs.schema)
    return docs
