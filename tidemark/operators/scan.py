"""Ordered calculations inside groups of any size.

A window over a group sorts that group in one task.  Most entities have few
events, but a single one may hold a large part of all rows.  ``ordered_scan``
therefore counts the groups first.  Groups within the limit take the plain
window.  Rows of larger groups are range-partitioned by group and order, each
part is scanned on its own, and what the earlier parts carry over is added from
a table with one row per part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import freeze
from .keys import columns, null_safe_join

ROWS_PER_GROUP = 5_000_000


@dataclass(frozen=True)
class Calc:
    kind: str
    value: str | None = None


def running_sum(column: str) -> Calc:
    return Calc("sum", column)


def running_product(column: str) -> Calc:
    return Calc("product", column)


def running_max(column: str) -> Calc:
    return Calc("max", column)


def group_sum(column: str) -> Calc:
    """Sum over the whole group, on every row."""
    return Calc("total", column)


def last_known(column: str) -> Calc:
    """Latest non-null value up to and including the row."""
    return Calc("last", column)


def row_number() -> Calc:
    return Calc("number")


def previous(column: str) -> Calc:
    return Calc("previous", column)


def following(column: str) -> Calc:
    return Calc("following", column)


def _in_window(calc: Calc, ordered) -> Column:
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    if calc.kind == "number":
        return F.row_number().over(ordered).cast("long")
    value = F.col(calc.value)
    return {
        "sum": lambda: F.sum(value).over(upto),
        "product": lambda: F.product(value).over(upto),
        "max": lambda: F.max(value).over(upto),
        "total": lambda: F.sum(value).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "last": lambda: F.last(value, ignorenulls=True).over(upto),
        "previous": lambda: F.lag(value).over(ordered),
        "following": lambda: F.lead(value).over(ordered),
    }[calc.kind]()


def _scan(df: DataFrame, by: list[str], order: list[Column], calcs: dict[str, Calc]) -> DataFrame:
    ordered = W.partitionBy(*by).orderBy(*order)
    return df.select("*", *[_in_window(calc, ordered).alias(name) for name, calc in calcs.items()])


def ordered_scan(
    df: DataFrame,
    by: list[str],
    order: list,
    calcs: dict[str, Calc],
    limit: int | None = ROWS_PER_GROUP,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Adds one column per entry of ``calcs``; ``order`` must be unique inside a group.

    ``limit=None`` states that the group size has a fixed bound, such as one
    row per calendar day, and skips the count.  ``sized_by`` is a frame that is
    cheaper to count and holds at least the rows of every group.
    """
    order = columns(order)
    if limit is None:
        return _scan(df, by, order, calcs)
    sizes = (df if sized_by is None else sized_by).groupBy(*by).agg(F.count(F.lit(1)).alias("_scan_size"))
    large = freeze(sizes.filter(F.col("_scan_size") > limit)) if _any_over(sizes, limit) else None
    if large is None:
        return _scan(df, by, order, calcs)
    rows = large.agg(F.sum("_scan_size")).first()[0]
    parts = max(2, -(-2 * rows // limit))
    if by:
        small_rows = null_safe_join(df, large.drop("_scan_size"), by, "left_anti")
        large_rows = null_safe_join(df, large.drop("_scan_size"), by, "left_semi")
        return _scan(small_rows, by, order, calcs).unionByName(
            _scan_in_parts(large_rows, by, order, calcs, parts)
        )
    return _scan_in_parts(df, by, order, calcs, parts)


def _any_over(sizes: DataFrame, limit: int) -> bool:
    return (sizes.agg(F.max("_scan_size")).first()[0] or 0) > limit


def _scan_in_parts(
    df: DataFrame, by: list[str], order: list[Column], calcs: dict[str, Calc], parts: int
) -> DataFrame:
    keys = columns(by)
    placed = freeze(df.repartitionByRange(parts, *keys, *order).withColumn("_scan_part", F.spark_partition_id()))
    local = _scan(placed, by + ["_scan_part"], order, {**calcs, "_scan_row": row_number()})

    ends = [F.count(F.lit(1)).alias("_scan_n")]
    for name, calc in calcs.items():
        value = F.col(calc.value) if calc.value else None
        end = {
            "sum": lambda: F.sum(value),
            "product": lambda: F.product(value),
            "max": lambda: F.max(value),
            "total": lambda: F.sum(value),
            "last": lambda: F.max_by(value, F.when(value.isNotNull(), F.col("_scan_row"))),
            "previous": lambda: F.max_by(value, F.col("_scan_row")),
            "following": lambda: F.min_by(value, F.col("_scan_row")),
            "number": lambda: F.count(F.lit(1)),
        }[calc.kind]()
        ends.append(end.alias(f"_scan_end_{name}"))
    table = local.groupBy(*keys, "_scan_part").agg(*ends)

    # at most one row per part and group boundary
    between = W.partitionBy(*by).orderBy("_scan_part")
    before = between.rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for name, calc in calcs.items():
        end = F.col(f"_scan_end_{name}")
        carry = {
            "sum": lambda: F.sum(end).over(before),
            "number": lambda: F.sum(end).over(before),
            "product": lambda: F.product(end).over(before),
            "max": lambda: F.max(end).over(before),
            "total": lambda: F.sum(end).over(between.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "last": lambda: F.last(end, ignorenulls=True).over(before),
            "previous": lambda: F.lag(end).over(between),
            "following": lambda: F.lead(end).over(between),
        }[calc.kind]()
        carried.append(carry.alias(f"_scan_carry_{name}"))
    carry = table.select(*by, "_scan_part", "_scan_n", *carried)
    joined = null_safe_join(local, carry, by + ["_scan_part"])

    out = []
    for name, calc in calcs.items():
        here, came = F.col(name), F.col(f"_scan_carry_{name}")
        out.append(
            {
                "sum": lambda: F.coalesce(here + came, here, came),
                "number": lambda: here + F.coalesce(came, F.lit(0)),
                "product": lambda: F.coalesce(here * came, here, came),
                "max": lambda: F.greatest(here, came),
                "total": lambda: came,
                "last": lambda: F.coalesce(here, came),
                "previous": lambda: F.when(F.col("_scan_row") == 1, came).otherwise(here),
                "following": lambda: F.when(F.col("_scan_row") == F.col("_scan_n"), came).otherwise(here),
            }[calc.kind]().alias(name)
        )
    return joined.select(*df.columns, *out)
