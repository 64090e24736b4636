"""Outcome labels against the median exit age of the category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.quantiles import day_quantile
from ..session import freeze

TIMELY, LATE, SLOW, YOUNG = 0, 1, 2, 3
CLASS_NAMES = {TIMELY: "Timely Exit", LATE: "Late Exit", SLOW: "Slow Growth"}
EXIT_EVENTS = ("public", "acquired")


def without_closed(entity: DataFrame, timeline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops companies that were closed, and their events."""
    closed = entity.filter(F.col("status") == "closed").select("id")
    return entity.join(closed, "id", "left_anti"), timeline.join(closed, "id", "left_anti")


def exit_thresholds(timeline: DataFrame, entity: DataFrame) -> DataFrame:
    """Median exit age in days per category."""
    exits = timeline.filter(F.col("event_id").isin(*EXIT_EVENTS)).select("id", "time_to_event")
    days = (
        exits.join(entity.filter(F.col("category_code").isNotNull()).select("id", "category_code"), "id")
        .groupBy("category_code", "time_to_event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return days.groupBy("category_code").agg(day_quantile("time_to_event", 0.5, "n").alias("threshold"))


def outcome_labels(timeline: DataFrame, entity: DataFrame) -> DataFrame:
    """Label per company; a late exit outweighs an early one of the same company.

    Without a category, or in a category without exits, the label is young.
    """
    is_exit = F.col("event_id").isin(*EXIT_EVENTS)
    spans = timeline.groupBy("id").agg(
        F.min(F.when(is_exit, F.col("time_to_event"))).alias("first_exit"),
        F.max(F.when(is_exit, F.col("time_to_event"))).alias("last_exit"),
        F.max("time_to_event").alias("age"),
    )
    threshold = F.col("threshold")
    return (
        entity.select("id", "category_code")
        .join(spans, "id", "left")
        .join(freeze(exit_thresholds(timeline, entity)), "category_code", "left")
        .select(
            "id",
            F.when(F.col("last_exit") >= threshold, LATE)
            .when(F.col("first_exit") < threshold, TIMELY)
            .when(F.col("first_exit").isNull() & (F.col("age") >= threshold), SLOW)
            .otherwise(YOUNG)
            .alias("label"),
        )
    )


def ages(timeline: DataFrame) -> DataFrame:
    """Age of every company at its latest event."""
    return timeline.groupBy("id").agg(F.max("time_to_event").alias("age"))


def label_split(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled companies."""
    return labels.filter(F.col("label") != YOUNG), labels.filter(F.col("label") == YOUNG)
