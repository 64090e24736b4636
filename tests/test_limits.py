"""Limits of survival quantiles and curves against plain calculations and simulations."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import limits, survival


def test_supremum_of_a_bridge_against_simulation():
    assert limits.bridge_supremum(0.05) == pytest.approx(1.3581, abs=1e-4)
    assert limits.bridge_supremum(0.1) == pytest.approx(1.2239, abs=1e-4)
    draw = np.random.RandomState(3)
    steps, paths = 1500, 3000
    walk = np.cumsum(draw.randn(paths, steps) / math.sqrt(steps), axis=1)
    bridge = walk - walk[:, -1:] * np.arange(1, steps + 1) / steps
    beyond = (np.abs(bridge).max(axis=1) > limits.bridge_supremum(0.2)).mean()
    assert abs(beyond - 0.2) < 0.03


def _lives(n, seed, digits=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        death, end = rnd.expovariate(0.1), rnd.uniform(3, 40)
        out.append((round(min(death, end), digits), death <= end))
    return out


def _curve(data):
    """(t, survival, variance) at the times of deaths."""
    s, part, out = 1.0, 0.0, []
    for t in sorted({t for t, died in data if died}):
        n, d = sum(x >= t for x, _ in data), sum(x == t and died for x, died in data)
        s *= 1 - d / n
        part = part + d / (n * (n - d)) if n > d else part
        out.append((t, s, s * s * part))
    return out


@pytest.mark.parametrize("scale", ["cloglog", "log", "identity"])
@pytest.mark.parametrize("limit", [None, 10])
def test_quantile_limits_invert_the_pointwise_test(spark, scale, limit):
    groups = {"a": _lives(60, 1), "b": _lives(12, 2), None: _lives(5, 3)}
    df = spark.createDataFrame([(g, *row) for g, lives in groups.items() for row in lives], "g string, t double, e boolean")
    curve = survival.kaplan_meier(df, "t", "e", ["g"])
    got = {(r["g"], r["p"]): (r["t"], r["lower"], r["upper"]) for r in limits.quantile_limits(curve, [0.25, 0.5, 0.9], ["g"], 0.05, scale, limit).collect()}
    value = {"cloglog": lambda s: math.log(-math.log(s)), "log": math.log, "identity": lambda s: s}[scale]
    slope = {"cloglog": lambda s: 1 / (s * math.log(s)), "log": lambda s: 1 / s, "identity": lambda s: 1.0}[scale]
    for g, lives in groups.items():
        own = _curve(lives)
        for p in (0.25, 0.5, 0.9):
            inside = [
                k for k, (_, s, v) in enumerate(own)
                if 0 < s < 1 and v > 0 and abs(value(s) - value(1 - p)) <= 1.959963984540054 * abs(slope(s)) * math.sqrt(v)
            ]
            first = next((t for t, s, _ in own if s <= 1 - p + 1e-12), None)
            low = own[inside[0]][0] if inside else None
            high = own[inside[-1] + 1][0] if inside and inside[-1] + 1 < len(own) else None
            assert got[g, p] == (first, low, high)


def test_band_holds_the_whole_curve_as_often_as_stated(spark):
    samples = 60
    # rounded times would not follow the true curve
    rows = [(k, *row) for k in range(samples) for row in _lives(80, 100 + k, 9)]
    df = spark.createDataFrame(rows, "k int, t double, e boolean")
    curve = survival.kaplan_meier(df, "t", "e", ["k"])
    missed = {
        r["k"] for r in limits.simultaneous_band(curve, ["k"], 0.05).filter("lower IS NOT NULL").collect()
        if not r["lower"] - 1e-9 <= math.exp(-0.1 * r["t"]) <= r["upper"] + 1e-9
    }
    assert len(missed) <= 0.15 * samples


def test_limits_of_no_rows(spark):
    none = survival.kaplan_meier(spark.createDataFrame([], "t double, e boolean"), "t", "e")
    assert limits.simultaneous_band(none).count() == 0
    assert [tuple(r) for r in limits.quantile_limits(none, [0.5]).collect()] == [(0.5, None, None, None)]
