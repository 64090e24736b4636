"""Repeatable numbering, splits and balanced draws.

Rows are numbered in the order of an md5 number.  That number is uniform, so
its leading bits cut every class, however large, into even bins; rows are
numbered inside a bin and shifted by the rows of the bins before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import draw_number, hash_number
from ..session import freeze
from .keys import null_safe_join

BINS = 65_536
_BIN_WIDTH = 2**32 // BINS
_DRAWS_PER_COPY = 1000


def numbered(df: DataFrame, by: list[str], key: str, name: str = "number") -> DataFrame:
    """Numbers the rows of each group from 1 in md5 order of ``key``, which must be unique."""
    by = list(by)
    hashed = df.withColumn("_hash", hash_number(key)).withColumn("_bin", F.floor(F.col("_hash") / _BIN_WIDTH))
    # at most BINS rows per group
    sizes = hashed.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    shifts = freeze(sizes.select(*by, "_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")))
    inside = W.partitionBy(*by, "_bin").orderBy("_hash", key)
    return (
        null_safe_join(hashed.withColumn(name, F.row_number().over(inside)), shifts, by + ["_bin"])
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_hash", "_bin", "_shift")
    )


def stratified_split(df: DataFrame, label: str | list[str] | None, key: str, share: float) -> DataFrame:
    """Adds ``is_train``, true for exactly ``round(share * n)`` rows of every class; several columns make classes of their own."""
    by = [label] if isinstance(label, str) else list(label or [])
    sizes = freeze(df.groupBy(*by).agg(F.round(F.count(F.lit(1)) * share).alias("_train")))
    return null_safe_join(numbered(df, by, key, "_number"), sizes, by).withColumn(
        "is_train", F.col("_number") <= F.col("_train")
    ).drop("_number", "_train")


def folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds ``fold`` in 0..k-1, even within every class."""
    return numbered(df, [label], key, "_number").withColumn(
        "fold", ((F.col("_number") - 1) % k).cast("int")
    ).drop("_number")


def upsample(df: DataFrame, label: str, key: str, majority: int, minorities: list[int]) -> DataFrame:
    """Majority rows once, and as many draws with replacement from every listed minority class.

    A draw is one majority number and one minority class, so the draws are made
    where the majority rows are; the drawn rows come by an equi join on
    (class, number).  Rows of a small class are drawn often, so they are copied
    until a copy serves about ``_DRAWS_PER_COPY`` draws and the draws are dealt
    over the copies.  ``draw`` tells copies of a row apart.
    """
    kind = df.schema[label].dataType
    # numbered once, read for the kept rows, the draws and the pool
    rows = freeze(numbered(df.filter(F.col(label).isin([majority, *minorities])), [label], key, "_number"))
    kept = rows.filter(F.col(label) == majority).withColumn("draw", F.col("_number")).drop("_number")
    # one row per listed class
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    drawn_classes = [m for m in minorities if m in sizes]
    if not drawn_classes:
        return kept
    copies = {m: max(1, -(-sizes.get(majority, 0) // (sizes[m] * _DRAWS_PER_COPY))) for m in drawn_classes}

    def of_class(values: dict) -> Column:
        return F.coalesce(*[F.when(F.col(label) == m, F.lit(values[m])) for m in drawn_classes])

    draws = (
        rows.filter(F.col(label) == majority)
        .select(F.col("_number").alias("draw"))
        .withColumn(label, F.explode(F.array(*[F.lit(m).cast(kind) for m in drawn_classes])))
        .withColumn("_number", draw_number(label, "draw") % of_class(sizes) + 1)
        .withColumn("_copy", F.pmod(F.xxhash64("draw"), of_class(copies)))
    )
    pool = rows.filter(F.col(label).isin(drawn_classes)).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), (of_class(copies) - 1).cast("long")))
    )
    drawn = draws.join(pool, [label, "_number", "_copy"]).drop("_number", "_copy")
    return kept.unionByName(drawn)


def upsample_within(
    df: DataFrame, by: list[str], label: str, key: str, majority: int, minorities: list[int]
) -> DataFrame:
    """``upsample`` inside every group of ``by``, all groups in the same jobs.

    Draws are made where the majority rows are, with the sizes of the group's classes beside them; they meet the drawn
    rows on (group, class, number, copy).  A class without rows is not drawn.
    """
    by = list(by)
    kind = df.schema[label].dataType
    rows = freeze(numbered(df.filter(F.col(label).isin([majority, *minorities])), [*by, label], key, "_number"))
    kept = rows.filter(F.col(label) == majority).withColumn("draw", F.col("_number")).drop("_number")
    # one row per group and class
    sizes = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_size"))
    most = sizes.filter(F.col(label) == majority).select(*by, F.col("_size").alias("_most"))
    small = null_safe_join(sizes.filter(F.col(label).isin(minorities)), most, by)
    small = freeze(small.withColumn(
        "_copies", F.greatest(F.lit(1), F.ceil(F.col("_most") / (F.col("_size") * _DRAWS_PER_COPY))).cast("long")
    ).drop("_most"))
    drawn = rows.filter(F.col(label) == majority).select(*by, F.col("_number").alias("draw")).withColumn(
        label, F.explode(F.array(*[F.lit(m).cast(kind) for m in minorities]))
    )
    draws = null_safe_join(drawn, small, [*by, label]).select(
        *by, label, "draw", (draw_number(label, "draw") % F.col("_size") + 1).alias("_number"),
        F.pmod(F.xxhash64("draw"), F.col("_copies")).alias("_copy"),
    )
    pool = null_safe_join(rows.filter(F.col(label).isin(minorities)), small, [*by, label]).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    ).drop("_size", "_copies")
    found = null_safe_join(draws, pool, [*by, label, "_number", "_copy"]).drop("_number", "_copy")
    return kept.unionByName(found)


def sample_entities(df: DataFrame, key: str, size: int) -> DataFrame:
    """All rows of ``size`` entities, chosen in md5 order."""
    chosen = df.select(key).distinct().orderBy(hash_number(key), key).limit(size)
    return df.join(chosen, key, "left_semi")
