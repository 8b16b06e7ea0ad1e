"""All nearest smaller values of a long distributed array, with what lies between, by blocks and block minima.

A block of BLOCK entries is one group: a stack finds what lies inside. What doesn't is looked for among the minima of
the blocks of the same parent block, then among those of the parents, until one parent is left; from the block so found
it goes down again. At each level a query is a block and a value, whoever asks, so equal questions are asked once and a
group holds BLOCK entries and at most BLOCK questions for each value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

BLOCK = 4096

#: An answer: where the nearest smaller value is and what it is (null: nowhere), and the least `low`, the sums of
#: `leaves` and `shared` of the entries strictly between.
_ANSWER = ["pos", "val", "low", "leaves", "shared"]
_ANSWER_T = "pos long, val long, low long, leaves long, shared long"
_FAR = np.iinfo(np.int64).max


class _Ranges:
    """Minimum and sums over ranges of a block's entries."""

    def __init__(self, e: pd.DataFrame):
        self.k, self.v = e["k"].to_numpy(np.int64), e["v"].to_numpy(np.int64)
        self.sums = [np.concatenate([[0], np.cumsum(e[c].to_numpy(np.int64))]) for c in ("leaves", "shared")]
        self.least = [e["low"].to_numpy(np.int64)]
        while (w := 1 << len(self.least)) <= len(e):
            x = self.least[-1]
            self.least.append(np.minimum(x[: len(e) - w + 1], x[w // 2 : w // 2 + len(e) - w + 1]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """Of entries lo up to, not with, hi."""
        low = np.full(len(lo), _FAR)
        width = np.maximum(hi - lo, 0)
        for level, x in enumerate(self.least):
            of = np.flatnonzero((width >> level) == 1)
            if len(of):
                low[of] = np.minimum(x[lo[of]], x[hi[of] - (1 << level)])
        return [low, *[np.where(width > 0, s[np.maximum(hi, lo)] - s[lo], 0) for s in self.sums]]

    def told(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
        """Answers: the hit's index (-1: none), and the range between."""
        there, where = at >= 0, np.maximum(at, 0)
        low, leaves, shared = self.between(lo, hi)
        some = lambda x, keep: pd.Series(x, dtype="Int64").where(keep)
        return pd.DataFrame({"pos": some(self.k[where], there), "val": some(self.v[where], there), "low": some(low, low != _FAR), "leaves": leaves, "shared": shared})

    def nearest(self, side: np.ndarray, start: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        """side -1: the last entry before `start` below value; side 1: the first from `start` on."""
        n = len(self.k)
        at = np.full(len(side), -1)
        for v in np.unique(value):
            below = self.v < v
            mine = value == v
            before = np.concatenate([[-1], np.maximum.accumulate(np.where(below, np.arange(n), -1))])
            after = np.concatenate([np.minimum.accumulate(np.where(below, np.arange(n), n)[::-1])[::-1], [n]])
            left, right = mine & (side < 0), mine & (side > 0)
            at[left] = before[start[left]]
            found = after[start[right]]
            at[right] = np.where(found == n, -1, found)
        lo = np.where(side < 0, at + 1, start)
        hi = np.where(side < 0, start, np.where(at < 0, n, at))
        return self.told(at, lo, hi)


def _inside(e: pd.DataFrame) -> pd.DataFrame:
    """Both answers of every entry of a block, as far as the block goes."""
    e = e.sort_values("k", ignore_index=True)
    n, v = len(e), e["v"].tolist()
    left, right, stack = np.full(n, -1), np.full(n, -1), []
    for i in range(n):
        while stack and v[stack[-1]] > v[i]:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack and v[stack[-1]] < v[i] else left[stack[-1]] if stack else -1
        stack.append(i)
    ranges, at = _Ranges(e), np.arange(n)
    out = e.drop(columns="block")
    for name, told in (("l", ranges.told(left, left + 1, at)), ("r", ranges.told(right, at + 1, np.where(right < 0, n, right)))):
        for c in _ANSWER:
            out[f"{name}_{c}"] = told[c]
    return out


def _looked(start):
    def look(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in ["side", "at", "v", *_ANSWER]})
        e = e.sort_values("k", ignore_index=True)
        side, q = q["side"].to_numpy(np.int64), q.reset_index(drop=True)
        told = _Ranges(e).nearest(side, start(q, e, side), q["v"].to_numpy(np.int64))
        return pd.concat([q[["side", "at", "v"]], told], axis=1)

    return look


def _beside(q: pd.DataFrame, e: pd.DataFrame, side: np.ndarray) -> np.ndarray:
    """Questions of an entry look from it outwards, itself left out."""
    own = np.searchsorted(e["k"].to_numpy(np.int64), q["at"].to_numpy(np.int64))
    return np.where(side < 0, own, own + 1)


def _within(q: pd.DataFrame, e: pd.DataFrame, side: np.ndarray) -> np.ndarray:
    """Questions of a found block look from its near end."""
    return np.where(side < 0, len(e), 0)


_ASKED = f"side int, at long, v long, {_ANSWER_T}"


def _joined(first: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """first's answers continued by more's: position and value are more's, ranges add up."""
    m = more.select(*on, *[F.col(c).alias(f"m_{c}") for c in _ANSWER])
    x = first.join(m, on, "left")
    return x.select("side", "at", "v", F.col("m_pos").alias("pos"), F.col("m_val").alias("val"), F.least("low", "m_low").alias("low"), *[(F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c) for c in ("leaves", "shared")])


def _grouped(q: DataFrame, entries: DataFrame, group, start) -> DataFrame:
    asked = q.withColumn("group", group).groupBy("group")
    return asked.cogroup(entries.withColumn("group", F.floor(F.col("k") / BLOCK)).groupBy("group")).applyInPandas(_looked(start), _ASKED)


def _down(levels: list[DataFrame], j: int, q: DataFrame, scratch: Scratch) -> DataFrame:
    """Answers at the lowest level of (side, at: an entry of level j that has a smaller value, v)."""
    found = _grouped(q, levels[j - 1], F.col("at"), _within)
    if j == 1:
        return found
    found = scratch.table(found, "down")
    deeper = _down(levels, j - 1, found.select("side", F.col("pos").alias("at"), "v").distinct(), scratch)
    return _joined(found.withColumn("_p", F.col("pos")), deeper.withColumnRenamed("at", "_p"), ["side", "_p", "v"])


def _up(levels: list[DataFrame], j: int, top: int, q: DataFrame, scratch: Scratch) -> DataFrame:
    """Answers at the lowest level of (side, at: an entry of level j, v), looked for beside that entry."""
    found = scratch.table(_grouped(q, levels[j], F.floor(F.col("at") / BLOCK), _beside), "up")
    hit, out = found.where("pos IS NOT NULL"), found.where("pos IS NULL")
    down = _down(levels, j, hit.select("side", F.col("pos").alias("at"), "v").distinct(), scratch)
    got = _joined(hit.withColumn("_p", F.col("pos")), down.withColumnRenamed("at", "_p"), ["side", "_p", "v"])
    if j < top:
        out = out.withColumn("_p", F.floor(F.col("at") / BLOCK))
        higher = _up(levels, j + 1, top, out.select("side", F.col("_p").alias("at"), "v").distinct(), scratch)
        out = _joined(out, higher.withColumnRenamed("at", "_p"), ["side", "_p", "v"])
    return got.unionByName(out.select(*got.columns))


def nearest_smaller(entries: DataFrame, last: int, scratch: Scratch) -> DataFrame:
    """Every entry (k, v, low, leaves, shared; k distinct, from 0 to `last`) with l_pos, l_val, l_low, l_leaves,
    l_shared: the nearest entry to the left with a strictly smaller v, and low's minimum, leaves' and shared's sums of
    the entries between; r_ the same to the right. Where there is none, position and value are null and the range goes
    to the end."""
    blocks = entries.withColumn("block", F.floor(F.col("k") / BLOCK))
    cols = "k long, v long, low long, leaves long, shared long"
    done = blocks.groupBy("block").applyInPandas(_inside, f"{cols}, " + ", ".join(f"{s}_{x}" for s in ("l", "r") for x in _ANSWER_T.split(", ")))
    top, n = 0, last // BLOCK
    while n > 0:  # the level at which one block holds all
        top, n = top + 1, n // BLOCK
    if not top:
        return done
    done = scratch.table(done, "inside")
    levels = [entries]
    for _ in range(top):
        up = levels[-1].groupBy(F.floor(F.col("k") / BLOCK).alias("k")).agg(F.min("v").alias("v"), F.min("low").alias("low"), F.sum("leaves").alias("leaves"), F.sum("shared").alias("shared"))
        levels.append(scratch.table(up, "minima"))
    for s, side in (("l", -1), ("r", 1)):
        open_ = done.where(F.col(f"{s}_pos").isNull()).withColumn("at", F.floor(F.col("k") / BLOCK))
        asked = open_.select(F.lit(side).alias("side"), "at", "v").distinct()
        told = scratch.table(_up(levels, 1, top, asked, scratch), "told").drop("side")
        more = told.select("at", "v", *[F.col(c).alias(f"m_{c}") for c in _ANSWER])
        whole = open_.join(more, ["at", "v"], "left")
        sums = {f"{s}_{c}": F.col(f"{s}_{c}") + F.coalesce(f"m_{c}", F.lit(0)) for c in ("leaves", "shared")}
        whole = whole.withColumns({f"{s}_pos": F.col("m_pos"), f"{s}_val": F.col("m_val"), f"{s}_low": F.least(f"{s}_low", "m_low"), **sums})
        done = done.where(F.col(f"{s}_pos").isNotNull()).unionByName(whole.select(*done.columns))
    return done

