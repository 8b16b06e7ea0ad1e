"""Word hashes and shingle sets of batches of texts, in numpy.

Words are runs of characters other than ASCII white space; only A-Z are lower-cased. bytes.lower and bytes.split do
exactly that on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Bytes of text that are hashed at once, so that memory does not depend on the batch.
BLOCK = 2_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values whose bits are all well mixed."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 16
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the offsets of each text's words."""
    flat: list[bytes] = []
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            raw = t.encode("utf-8", "surrogatepass")
            flat += (raw.lower() if lower else raw).split()
        ends[i + 1] = len(flat)
    if not flat:
        return np.zeros(0, dtype=np.uint64), ends
    words = np.empty(len(flat), dtype=object)
    words[:] = flat
    return pd.util.hash_array(words, categorize=False), ends


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and the offsets of each text's set. A text with fewer
    words has one shingle, its whole sequence; a text without words has none."""
    words, ends = word_hashes(texts)
    n = np.diff(ends)
    rows = np.repeat(np.arange(len(texts)), n)
    parts, owners = [], []
    if len(words) >= k:
        sums = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            sums += words[j : len(words) - k + 1 + j] * _ODD[j]
        whole = rows[: len(sums)] == rows[k - 1 :]
        parts.append(mixed(sums[whole]))
        owners.append(rows[: len(sums)][whole])
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = words[ends[i] : ends[i + 1]]
        parts.append(mixed(np.array([(own * _ODD[: len(own)]).sum(dtype=np.uint64)]), salt=len(own)))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def set_keys(hashes: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set: two sums of differently mixed members, and the size. Empty sets have none."""
    out: list[bytes | None] = [None] * (len(ends) - 1)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        a = np.add.reduceat(mixed(hashes, 101), ends[full])
        b = np.add.reduceat(mixed(hashes, 202), ends[full]) + np.diff(ends)[full].astype(np.uint64)
        raw = np.stack([mixed(a, 7), mixed(b, 8)], axis=1).tobytes()
        for j, i in enumerate(full):
            out[i] = raw[16 * j : 16 * j + 16]
    return out
