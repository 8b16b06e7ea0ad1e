"""Exact quantiles by refinement against numpy, with few splitters and few values, so that passes are many."""

import math
import random

import numpy as np
import pytest

from chronoweave.operators import quantiles, robust

SHARES = [0.0, 0.01, 0.25, 0.5, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("splitters,few", [(3, 4), (7, 20), (255, 50_000)])
def test_quantiles(spark, splitters, few):
    rng = random.Random(splitters)
    groups = {
        "flat": [3.0] * 300, "hot": [0.0] * 250 + [rng.gauss(0, 1) for _ in range(50)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(200)], "one": [5.0], "two": [1.0, 2.0],
        None: [float(rng.randrange(20)) for _ in range(150)], "zeros": [0.0, -0.0, 1e-320, -1e-320] * 9, "bounds": [math.inf, -math.inf, 1.0, 2.0, 3.0], "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan), ("one", math.nan), (None, None)]
    rng.shuffle(rows)
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", SHARES, splitters, few).collect()
    assert {r["g"] for r in got} == {g for g, vs in groups.items() if vs}
    for r in got:
        vs = sorted(groups[r["g"]])
        assert r["n"] == len(vs)
        for s, v in zip(SHARES, r["values"], strict=True):
            at = (len(vs) - 1) * s
            a, b = vs[math.floor(at)], vs[math.ceil(at)]
            assert v == a if a == b or at == int(at) else v == pytest.approx((1 - at + int(at)) * a + (at - int(at)) * b, rel=1e-12), (r["g"], s)


def test_quantiles_without_keys(spark):
    rows = spark.createDataFrame([(float(k % 101), k) for k in range(1000)], "v double, bin int")
    assert [list(r) for r in quantiles.exact_quantiles(rows, [], "v", [0.5, 0.9], 5, 10).collect()] == [[1000, list(np.percentile([k % 101 for k in range(1000)], [50, 90]))]]
    assert quantiles.exact_quantiles(rows.where("false"), ["bin"], "v", [0.5]).count() == 0
    box = lambda large: [tuple(r) for r in robust.box(rows, [], "v", large).collect()]
    assert box(True) == box(False)
