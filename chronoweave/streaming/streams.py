"""Structured Streaming forms of the batch operators: each takes a streaming (or batch) frame of rec, ts, value.

The stateful ones fold a key's rows in order. Without `late` they order the rows of one trigger, and rows of an earlier
place that come with a later trigger are taken in the order of arrival. With `late` (a delay, such as "5 minutes") rows
also have ts, and wait in the state until the watermark, the latest ts less the delay, has passed them: then they are
folded by ts and seq, whichever trigger brought them, so that the result is the batch operator's. What waits is what a
key sends within the delay. Rows later than the delay are dropped, as Spark does; rows within it of the stream's end wait
for the stream to go on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trackers import later


def windowed(rows: DataFrame, length: str = "60 seconds", step: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Overlapping windows of fixed step with count and mean; rows later than `late` are dropped."""
    w = F.window("ts", length, step)
    return rows.withWatermark("ts", late).groupBy("rec", w).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("rec", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(rows: DataFrame, gap: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Events merged while no pause reaches the gap; an event's end is its last row's time plus the gap."""
    w = F.session_window("ts", gap)
    return rows.withWatermark("ts", late).groupBy("rec", w).agg(F.count("*").alias("n")).select("rec", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Fold:
    """What a stateful operator does: row (fields of an input row that it reads), state (fields of what it keeps), out
    (columns that it gives after rec), and step: kept values (None at first) and one row to kept values and new rows."""

    row: str
    state: str
    out: str

    def step(self, kept: tuple | None, row: dict) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def ended(self, kept: tuple | None) -> list[tuple]:
        """What a key gives when it has been quiet for long; its kept values then go."""
        return []


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


_KINDS = {"long": int, "double": float, "boolean": bool}


def _plain(values: pd.Series, kind: str) -> list:
    """A column's values as its type has them: pandas makes whole numbers with nulls to floats."""
    return [None if x is None or x != x else _KINDS[kind](x) for x in values]


class _Folding(StatefulProcessor):
    """Runs a fold on each trigger's rows; with a delay, on the rows that the watermark has passed."""

    def __init__(self, fold: _Fold, timed: bool, quiet_ms: int | None):
        self.fold, self.timed, self.quiet = fold, timed, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.fold.state)
        if self.timed:
            self.waiting = handle.getListState("waiting", f"ms long, seq long, {self.fold.row}")
            self.last = handle.getValueState("last", "ms long")

    def _frame(self, key, told: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(told, columns=_names(self.fold.out), dtype=object)
        frame.insert(0, "rec", key[0])
        return frame

    def _folded(self, rows) -> list[tuple]:
        kept, told = self.kept.get() if self.kept.exists() else None, []
        for row in rows:
            kept, new = self.fold.step(kept, row)
            told += new
        self.kept.clear() if kept is None else self.kept.update(kept)
        return told

    def _due(self, watermark: int) -> list[tuple]:
        """Folds what the watermark has passed, and sets a timer for what waits on, or for the end of a quiet key."""
        names = ["ms", "seq", *_names(self.fold.row)]
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= watermark), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        rest = [r for r in rows if r[0] > watermark]
        told = self._folded(dict(zip(names, r, strict=True)) for r in due)
        if due:
            self.last.update((due[-1][0],))
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest))
        elif self.quiet is not None and self.kept.exists() and self.last.exists():
            end = self.last.get()[0] + self.quiet
            if end > watermark:
                self.handle.registerTimer(end)
            else:
                told += self.fold.ended(self.kept.get())
                self.kept.clear()
        return told

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf, names = pd.concat(list(rows), ignore_index=True), ["seq", *_names(self.fold.row)]
        columns = [_plain(pdf[c], k) for c, k in zip(names, ["long", *(f.split()[1] for f in self.fold.row.split(", "))], strict=True)]
        if not self.timed:
            came = [dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True)]
            yield self._frame(key, self._folded(sorted(came, key=lambda r: (r["seq"] is not None, r["seq"] or 0))))
            return
        ms = pdf["ts"].astype("datetime64[ms]").astype("int64").tolist()
        self.waiting.appendList(list(zip(ms, *columns, strict=True)))
        yield self._frame(key, self._due(timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(key, self._due(timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def _run(rows: DataFrame, fold: _Fold, late: str | None, quiet_s: float | None = None, mode: str = "append") -> DataFrame:
    timed = late is not None
    wanted = ["rec", *(["ts"] if timed else []), "seq", *_names(fold.row)]
    # a row without a time has no place in the order of a delay
    source = rows.where("ts IS NOT NULL").withWatermark("ts", late) if timed else rows
    processor = _Folding(fold, timed, None if quiet_s is None else int(quiet_s * 1000))
    return source.select(*wanted).groupBy("rec").transformWithStateInPandas(processor, f"rec long, {fold.out}", mode, "eventTime" if timed else "none")


class _OrderCheck(_Fold):
    """Keeps the last time seen."""

    row, state, out = "t double", "t double", "n long, wrong long"

    def step(self, kept, row):
        last = kept[0] if kept else float("-inf")
        t = row["t"]
        return (last if t is None else max(last, t),), [(1, int(t is not None and t <= last))]


def order_checked(rows: DataFrame, late: str | None = None) -> DataFrame:
    """rec, seq, t (ts) -> rec, n, wrong of each row: whether it doesn't increase, also across the borders of chunks and
    micro-batches. A missing time is in no order."""
    return _run(rows, _OrderCheck(), late, mode="update" if late is None else "append")


class _Hysteresis(_Fold):
    """Keeps since when an event is open, and its last time."""

    row, state, out = "t double, closed boolean, opened boolean", "start double, last double", "start double, end double, complete boolean"

    def step(self, kept, row):
        if kept is None:
            return ((row["t"], row["t"]) if row["closed"] else None), []
        if row["opened"]:
            return None, [(kept[0], row["t"], True)]
        return (kept[0], row["t"]), []

    def ended(self, kept):
        return [(kept[0], kept[1], False)] if kept else []


def hysteresis_events(rows: DataFrame, late: str | None = None, quiet_s: float | None = None) -> DataFrame:
    """rec, seq, t, closed, opened (ts) -> events from a closed row to the next opened one, complete; with a delay and
    quiet_s, an event that is open when its key has sent nothing for so long ends with its last row, and isn't."""
    return _run(rows, _Hysteresis(), late, quiet_s)


class _Repair(_Fold):
    """Keeps the last time given. The stateful twin of trackers.monotonic_times."""

    row, state, out = "candidate long, nominal long", "t long", "seq long, repaired long"

    def step(self, kept, row):
        last = later(kept[0] if kept else -1, row["candidate"], row["nominal"])
        return (last,), [(row["seq"], last)]


def repaired_times(rows: DataFrame, late: str | None = None) -> DataFrame:
    """rec, seq, candidate, nominal (ts) -> rec, seq, repaired."""
    return _run(rows, _Repair(), late)
