"""Limits of survival quantiles and bands for whole survival curves."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from .keys import null_safe_join
from .scan import ROWS_PER_GROUP, following, ordered_scan


def bridge_supremum(alpha: float) -> float:
    """Value that the absolute maximum of a Brownian bridge exceeds with a chance of ``alpha``.

    The chance of exceeding x is 2 * sum((-1)^(k - 1) * exp(-2 k^2 x^2)); the value is found by halving.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")

    def beyond(x: float) -> float:
        return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))

    low, high = 0.2, 10.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > alpha else (low, middle)
    return (low + high) / 2


# scales on which a survival is compared with a share: the function and its slope
SCALES = {
    "cloglog": (lambda s: F.log(-F.log(s)), lambda s: 1 / (s * F.log(s))),
    "log": (F.log, lambda s: 1 / s),
    "identity": (lambda s: s, lambda s: F.lit(1.0)),
}


def quantile_limits(
    curve: DataFrame, probabilities: list[float], by: list[str] = (), alpha: float = 0.05, scale: str = "cloglog",
    limit: int | None = ROWS_PER_GROUP,
) -> DataFrame:
    """``p``, ``t``, ``lower`` and ``upper`` per group and probability, from a curve with its variance.

    The quantile ``t`` is the first time at which survival has fallen to 1 - p.  Its limits invert the pointwise test
    that survival is 1 - p: the times of deaths at which the test does not reject, on the chosen scale, form the
    interval, which ends at the next time of a death behind them.  ``upper`` is NULL if no death follows, both are NULL
    if the test rejects everywhere.  Times at which survival is 0 or 1 have no test.
    """
    by = list(by)
    value, slope = SCALES[scale]
    reach = NormalDist().inv_cdf(1 - alpha / 2)
    died = curve.filter(F.col("d") > 0).select(*by, "t", "survival", "variance")
    died = ordered_scan(freeze(died), by, ["t"], {"_next": following("t")}, limit)
    s = F.col("survival")
    tested = (s > 0) & (s < 1) & (F.col("variance") > 0)
    error = F.abs(slope(s)) * F.sqrt("variance")
    found = []
    for i, p in enumerate(probabilities):
        aim = value(F.lit(1.0 - p))
        holds = F.when(tested, F.abs(value(s) - aim) <= reach * error)
        found += [
            F.min(F.when(s <= 1 - p + 1e-12, F.col("t"))).alias(f"_t{i}"), F.min(F.when(holds, F.col("t"))).alias(f"_low{i}"),
            F.max(F.when(holds, F.struct("t", "_next"))).alias(f"_high{i}"),
        ]
    wide = died.groupBy(*by).agg(*found)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("p"), F.col(f"_t{i}").alias("t"), F.col(f"_low{i}").alias("lower"),
                    F.col(f"_high{i}._next").alias("upper"),
                )
                for i, p in enumerate(probabilities)
            ]
        )
    )
    return wide.select(*by, rows.alias("q")).select(*by, "q.*")


def simultaneous_band(curve: DataFrame, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """The curve at its death times with ``lower`` and ``upper``, which hold the whole true curve with 1 - alpha.

    The band is that of Hall and Wellner on the log scale: with n subjects and the relative variance v = variance / s^2,
    theta = exp(k (1 + n v) / (sqrt(n) ln s)), the limits are s^(1 / theta) and s^theta, where k is the critical
    value of the supremum of a bridge.  Where survival is 0 or 1 there are none.
    """
    by = list(by)
    critical = bridge_supremum(alpha)
    # one row per group
    sizes = freeze(curve.groupBy(*by).agg(F.max("n").alias("_size")))
    rows = null_safe_join(curve.filter(F.col("d") > 0), sizes, by)
    s, n = F.col("survival"), F.col("_size").cast("double")
    theta = F.exp(critical * (1 + n * F.col("variance") / (s * s)) / (F.sqrt(n) * F.log(s)))

    def inside(limit: Column) -> Column:
        return F.when((s > 0) & (s < 1), limit)

    return rows.select(
        *by, "t", "survival", inside(F.pow(s, 1 / theta)).alias("lower"), inside(F.pow(s, theta)).alias("upper")
    )
