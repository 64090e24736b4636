"""Key handling shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which a NULL key meets a NULL key; the key appears once."""
    if not on:
        # one summary row on the right
        return left.join(F.broadcast(right))
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])


def columns(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]
