"""Pieces of a copy found in the raw sequence, against a search of every place."""

import math
import random

import pytest

from chronoweave.operators import content


def brute(raw, copy, size, radius, expected):
    same = lambda x, y: x == y or (x is None or x != x) and (y is None or y != y)
    out, last = [], None
    for number, begin in enumerate(range(0, len(copy), size)):
        piece = copy[begin : begin + size]
        at = [s for s in range(len(raw) - len(piece) + 1) if all(map(same, raw[s : s + len(piece)], piece))]
        if last is not None:
            expected = last + size
            at = [s for s in at if s == expected] or [s for s in at if abs(s - expected) <= radius] or at
        start = min(at, key=lambda s: (0 if expected is None else abs(s - expected), s), default=None)
        last = last if start is None else start
        out.append((number, start, len(at)))
    return out


@pytest.mark.parametrize("values", [2, 5, 1000])
def test_pieces_are_found(spark, values):
    """Many places for a piece, few, or one; flat stretches, missing values, pieces that are lost, doubled or altered."""
    rng = random.Random(values)
    raws, copies, want, places = [], [], {}, []
    for rec in [*range(8), None]:
        raw = [rng.choice([float(rng.randrange(values)), None, math.nan, 0.0, -0.0]) if rng.random() < 0.05 else float(rng.randrange(values)) for _ in range(rng.choice([0, 3, 150, 400]))]
        if rec == 3:
            raw[50:150] = [7.0] * 100
        parts = []
        for begin in range(rng.randrange(9), len(raw), 6):
            piece = raw[begin : begin + 6]
            if rng.random() < 0.1:
                piece[rng.randrange(len(piece))] = -5.0
            parts += piece * rng.choice([0, 1, 1, 1, 1, 1, 2])
        parts += raw[: rng.randrange(6)]
        guess = rng.choice([None, rng.randrange(400)])
        raws += [(rec, 3 * k, v) for k, v in enumerate(raw)]
        copies += [(rec, 2 * k, v) for k, v in enumerate(parts)]
        if guess is not None:
            places.append((rec, guess))
        want |= {(rec, c): (s, n) for c, s, n in brute(raw, parts, 6, 40, guess)}
    rng.shuffle(raws)
    rows = "rec long, seq long, value double"
    got = content.matched_chunks(spark.createDataFrame(raws, rows), spark.createDataFrame(copies, rows), 6, 40, spark.createDataFrame(places, "rec long, expected long"))
    assert {(r["rec"], r["chunk"]): (r["start"], r["candidates"]) for r in got.collect()} == want and len(want) > 50


def test_nothing_to_find(spark):
    rows = "rec long, seq long, value double"
    some = spark.createDataFrame([(1, k, float(k)) for k in range(10)], rows)
    assert content.matched_chunks(some, some.where("false")).count() == 0
    assert [tuple(r) for r in content.matched_chunks(some.where("false"), some, 20).collect()] == [(1, 0, None, 0)]
    assert [tuple(r) for r in content.matched_chunks(some, some, 20).collect()] == [(1, 0, 0, 1)]
