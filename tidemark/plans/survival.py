"""Survival datasets and cross-validated hazard models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import days_between
from ..operators.features import impute
from ..operators.sampling import folds
from ..operators.scan import ROWS_PER_GROUP
from ..operators.survival import (
    add_covariates,
    clean_intervals,
    concordance,
    cox_fit_folds,
    kaplan_meier,
    last_intervals,
    long_format,
)
from ..session import freeze
from .entity import founded_companies


def survival_input(
    static: DataFrame, objects: DataFrame, funding_rounds: DataFrame, limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Funded companies as (start, stop] intervals with the latest and the summed funding amount.

    A company lasts to its age at exit, or to its present age if it has none;
    only companies with a dated round of known amount enter.
    """
    companies = founded_companies(objects)
    amounts = (
        funding_rounds.filter(F.col("raised_amount_usd").isNotNull())
        .select(F.col("object_id").alias("id"), "funded_at", "raised_amount_usd")
        .join(companies.select("id", "founded_at"), "id")
        .select("id", days_between("founded_at", "funded_at").alias("t"), "raised_amount_usd")
        .filter(F.col("t").isNotNull())
    )
    # amounts of one day are added up before anything is ordered
    daily = freeze(amounts.groupBy("id", "t").agg(F.sum("raised_amount_usd").alias("raised_amount_usd")))
    subjects = static.select(
        "id", "category_code", F.col("status").isin("acquired", "ipo").alias("success"), "age_at_exit"
    ).join(daily.select("id"), "id", "left_semi")
    base = freeze(long_format(subjects, "age_at_exit"))
    summed = freeze(add_covariates(base, daily, "id", "t", "success", cumulative=True, limit=limit))
    return add_covariates(summed, daily, "id", "t", "success", limit=limit)


def fill_intervals(df: DataFrame, numeric: list[str], limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Clean intervals with missing numbers at the exact median of their column.

    They are read four times, so they are written once instead of being joined and cleaned for each reading.
    """
    return impute(freeze(clean_intervals(df)), numeric, limit=limit)


def exit_curve(
    intervals: DataFrame, key: str, event: str, per_subject: bool = True, limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Survival of entities given as intervals.

    By default an entity counts once, with its last stop; otherwise every
    interval counts as a subject of its own that ends at its stop.
    """
    subjects = last_intervals(intervals, key, event) if per_subject else intervals
    return kaplan_meier(subjects, "stop", event, limit=limit)


def event_times(objects: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Per company the days to its last funding, its closing and its sale."""
    sold = acquisitions.groupBy(F.col("acquired_object_id").alias("id")).agg(F.min("acquired_at").alias("acquired_at"))
    return objects.filter(F.col("founded_at").isNotNull()).join(sold, "id", "left").select(
        "id",
        days_between("founded_at", "last_funding_at").alias("funded"),
        days_between("founded_at", "closed_at").alias("closed"),
        days_between("founded_at", "acquired_at").alias("acquired"),
    )


def kfold_concordance(
    df: DataFrame, covariates: list[str], duration: str, event: str, key: str, k: int = 10
) -> DataFrame:
    """Fits on all folds but one and scores the one left out; the folds are fitted and scored in the same jobs."""
    folded = freeze(folds(df, event, key, k))
    fits = cox_fit_folds(folded, covariates, duration, event, "fold", k)
    score = F.coalesce(*[F.when(F.col("fold") == fold, -fit.risk()) for fold, fit in enumerate(fits)])
    scored = concordance(folded.withColumn("score", score), duration, event, "score", by=["fold"])
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    return every.join(scored, "fold", "left").select("comparable", "concordant", "tied", "concordance", "fold")
