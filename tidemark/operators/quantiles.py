"""Exact quantiles, interpolated between neighbours, for columns of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from .keys import null_safe_join
from .scan import ROWS_PER_GROUP, ordered_scan, running_sum


def day_quantile(value: str, probability: float, weight: str):
    """Aggregate for whole-day values that were counted first; its buffer holds one entry per day."""
    return F.percentile(value, F.lit(probability), F.col(weight))


# ranks beyond the sought one that the first look at a column may be off by, as a share of its rows
NEAR = 1000


def exact_quantiles(
    df: DataFrame,
    value_columns: list[str],
    by: list[str] = (),
    probability: float = 0.5,
    limit: int | None = ROWS_PER_GROUP,
    near: int = NEAR,
) -> DataFrame:
    """One row per group with the quantile of every listed column, NULLs left out.

    The ranks are narrowed.  A first aggregate sketches all columns of a group and gives bounds around the sought
    ranks; a second one counts the values below and up to the bounds, so that bounds which miss a rank are known and
    dropped.  Only the values between the bounds, about one in ``near / 4`` and their repeats, are counted, summed in
    value order and picked from.  What is shuffled depends on the rows between the bounds, not on the distinct values,
    and no task holds all values of a column.  Reads ``df`` three times.
    """
    by = list(by)
    number = {c: f"_c{i}" for i, c in enumerate(value_columns)}
    values = df.select(*by, *[F.col(c).cast("double").alias(n) for c, n in number.items()])
    ends = F.array(F.lit(max(0.0, probability - 2 / near)), F.lit(min(1.0, probability + 2 / near)))
    sketch = values.groupBy(*by).agg(
        *[f(n).alias(f"{p}{n}") for n in number.values() for p, f in (
            ("_rows", F.count), ("_ends", lambda n: F.percentile_approx(n, ends, F.lit(near))),
        )]
    )
    sketch = freeze(sketch)
    seen = _beside(values, sketch, by)
    counts = seen.groupBy(*by).agg(
        *[f.alias(f"{p}{n}") for n in number.values() for p, f in (
            ("_below", F.count_if(F.col(n) < F.col(f"_ends{n}")[0])), ("_upto", F.count_if(F.col(n) <= F.col(f"_ends{n}")[1])),
        )]
    )
    found = _beside(sketch, counts, by)
    stated = [F.col(c) for c in by]
    for n in number.values():
        place = probability * (F.col(f"_rows{n}") - 1)
        # bounds that miss a rank give way to none
        holds = (F.col(f"_below{n}") <= F.floor(place)) & (F.col(f"_upto{n}") > F.ceil(place))
        low, high = F.col(f"_ends{n}")[0], F.col(f"_ends{n}")[1]
        stated.append(
            F.struct(
                place.alias("place"), F.when(holds, F.col(f"_below{n}")).otherwise(0).alias("below"),
                F.when(holds, low).alias("low"), F.when(holds, high).alias("high"),
            ).alias(f"_at{n}")
        )
    bounds = freeze(found.select(*stated))

    def inside(n: str) -> Column:
        low, high = F.col(f"_at{n}.low"), F.col(f"_at{n}.high")
        return F.col(n).isNotNull() & (low.isNull() | ((F.col(n) >= low) & (F.col(n) <= high)))

    near_ones = F.array_compact(
        F.array(*[F.when(inside(n), F.struct(F.lit(n).alias("_name"), F.col(n).alias("_value"))) for n in number.values()])
    )
    counted = (
        _beside(values, bounds, by)
        .select(*by, F.explode(near_ones).alias("_pair"))
        .groupBy(*by, "_pair._name", "_pair._value")
        .agg(F.count(F.lit(1)).alias("_weight"))
    )
    if limit is not None:
        # written, so that counting its groups does not read the rows again
        counted = freeze(counted)
    keys = by + ["_name"]
    summed = ordered_scan(counted, keys, ["_value"], {"_upto": running_sum("_weight")}, limit)
    at = F.coalesce(*[F.when(F.col("_name") == n, F.col(f"_at{n}")) for n in number.values()])
    ranked = _beside(summed, bounds, by).select(*keys, "_value", "_upto", at.alias("_at"))
    upto, place = F.col("_upto") + F.col("_at.below"), F.col("_at.place")
    picked = ranked.groupBy(*keys).agg(
        F.min(F.when(upto > F.floor(place), F.col("_value"))).alias("_low"),
        F.min(F.when(upto > F.ceil(place), F.col("_value"))).alias("_high"),
        F.max(place - F.floor(place)).alias("_share"),
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")
    value = F.when(F.col("_share") > 0, between).otherwise(F.col("_low"))
    return picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == n, value)).alias(c) for c, n in number.items()]
    )


def _beside(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the summary of their group; without groups it is one row."""
    return null_safe_join(rows, summary, by) if by else rows.join(F.broadcast(summary))


def box_statistics(df: DataFrame, by: str, days: str, reach: float = 1.5) -> DataFrame:
    """Quartiles and whiskers of whole-day values per group.

    Whiskers are the outermost values within ``reach`` times the quartile span.
    """
    counted = freeze(df.filter(F.col(days).isNotNull()).groupBy(by, days).agg(F.count(F.lit(1)).alias("_weight")))
    quarters = counted.groupBy(by).agg(
        F.sum("_weight").alias("n"),
        F.percentile(days, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_weight")).alias("_q"),
    )
    quarters = freeze(quarters).select(by, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])
    span = reach * (F.col("q3") - F.col("q1"))
    inside = (F.col(days) >= F.col("q1") - span) & (F.col(days) <= F.col("q3") + span)
    return (
        null_safe_join(counted, quarters, [by])
        .groupBy(by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(days))).alias("low_whisker"),
            F.max(F.when(inside, F.col(days))).alias("high_whisker"),
            F.sum(F.when(~inside, F.col("_weight")).otherwise(0)).alias("outliers"),
        )
    )
