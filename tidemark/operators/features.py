"""Feature preparation: indicators, imputation, scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ratio
from ..session import freeze
from .keys import null_safe_join
from .quantiles import exact_quantiles
from .scan import ROWS_PER_GROUP


def category_values(df: DataFrame, column: str) -> list:
    """Distinct values of a category column; each becomes a column, so a wide category needs a stated list instead."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in found)


def indicators(column: str, values: list, prefix: str = "") -> list[Column]:
    """One 0/1 column per value; a NULL category gives zeros."""
    return [
        F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values
    ]


def one_hot(df: DataFrame, column: str, values: list, prefix: str = "") -> DataFrame:
    return df.select("*", *indicators(column, values, prefix))


def known_label_indicators(df: DataFrame, label: str, classes: list[int], unknown: int) -> DataFrame:
    """Rows with a known label and one 0/1 column per class."""
    return df.filter(F.col(label) != unknown).select(
        "*", *[(F.col(label) == k).cast("int").alias(f"is_{k}") for k in classes]
    )


def impute(
    df: DataFrame, names: list[str], by: list[str] = (), limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Missing values become the exact median of the column in its group, or zero if there is none.

    Reads ``df`` twice; so do ``standardise`` and ``fill_and_scale``.
    """
    by = list(by)
    medians = freeze(exact_quantiles(df, names, by, limit=limit).withColumnsRenamed({c: f"_median_{c}" for c in names}))
    joined = null_safe_join(df, medians, by, "left") if by else df.join(F.broadcast(medians), how="left")
    return joined.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}"), F.lit(0.0)).alias(c) if c in names else F.col(c)
            for c in df.columns
        ]
    )


def standardise(df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """Zero mean and unit population deviation per group; a constant column becomes zero."""
    by = list(by)
    moments = freeze(
        df.groupBy(*by).agg(
            *[F.avg(c).alias(f"_mean_{c}") for c in names], *[F.stddev_pop(c).alias(f"_dev_{c}") for c in names]
        )
    )
    joined = null_safe_join(df, moments, by, "left") if by else df.join(F.broadcast(moments), how="left")

    def scaled(c: str) -> Column:
        dev = F.col(f"_dev_{c}")
        return F.when(dev > 1e-12, (F.col(c) - F.col(f"_mean_{c}")) / dev).otherwise(
            F.when(F.col(c).isNotNull(), F.lit(0.0))
        )

    return joined.select(*[scaled(c).alias(c) if c in names else F.col(c) for c in df.columns])


def fill_and_scale(
    df: DataFrame, names: list[str], by: list[str] = (), limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """``standardise(impute(df))`` in one pass over the rows.

    The moments of the filled column follow from those of its known values and
    the number of gaps, so the filled rows are not needed to find them.
    """
    by = list(by)
    known = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"_n_{c}") for c in names],
        *[F.avg(c).alias(f"_avg_{c}") for c in names],
        *[F.var_pop(c).alias(f"_var_{c}") for c in names],
    )
    medians = exact_quantiles(df, names, by, limit=limit).withColumnsRenamed({c: f"_median_{c}" for c in names})
    # one row per group
    summary = null_safe_join(known, medians, by, "left") if by else known.join(F.broadcast(medians), how="left")
    stated = [F.col(c) for c in by]
    for c in names:
        fill = F.coalesce(f"_median_{c}", F.lit(0.0))
        n, gaps = F.col(f"_n_{c}"), F.col("_rows") - F.col(f"_n_{c}")
        average, variance = F.coalesce(f"_avg_{c}", F.lit(0.0)), F.coalesce(f"_var_{c}", F.lit(0.0))
        mean = ratio(n * average + gaps * fill, "_rows")
        spread = ratio(
            n * (variance + (average - mean) * (average - mean)) + gaps * (fill - mean) * (fill - mean), "_rows"
        )
        stated += [fill.alias(f"_fill_{c}"), mean.alias(f"_mean_{c}"), F.sqrt(spread).alias(f"_dev_{c}")]
    # written first, so that the join sees its size and leaves the rows in place if it is small
    summary = freeze(summary.select(*stated))
    joined = null_safe_join(df, summary, by) if by else df.join(F.broadcast(summary))

    def scaled(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}"))
        dev = F.col(f"_dev_{c}")
        return F.when(dev > 1e-12, (value - F.col(f"_mean_{c}")) / dev).otherwise(F.lit(0.0))

    return joined.select(*[scaled(c).alias(c) if c in names else F.col(c) for c in df.columns])


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Lower triangle of the correlation matrix as rows, from a single aggregate."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), F.col(f"`{a}|{b}`").alias("corr"))
                    for a, b in pairs
                ]
            )
        ).alias("p")
    ).select("p.*")


def minus_minimum(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the distance of a column from its minimum, which is found as one row."""
    least = df.agg(F.min(column).alias("_least"))
    return df.join(F.broadcast(least)).withColumn(name, F.col(column) - F.col("_least")).drop("_least")


def noise_columns(df: DataFrame, count: int, seed: int, key: str) -> DataFrame:
    """Adds standard-normal noise columns, drawn from the md5 of ``key`` and so the same on every run."""

    def drawn(i: int) -> Column:
        digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(i))))

        def even(start: int) -> Column:
            return (F.conv(F.substring(digest, start, 12), 16, 10).cast("double") + 1) / (2.0**48 + 1)

        # two even draws in (0, 1) make a normal one
        return F.sqrt(-2 * F.log(even(1))) * F.cos(2 * math.pi * even(13))

    return df.select("*", *[drawn(i).alias(f"noise_{i}") for i in range(count)])
