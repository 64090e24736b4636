"""Event timeline: one row per company event with gap, count and running amount."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import days_between, years
from ..operators.scan import ROWS_PER_GROUP, ordered_scan, previous, row_number, running_sum


def append_events(frame: DataFrame, *others: DataFrame) -> DataFrame:
    """Stacks frames with different columns; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, frame)


def _kind(df: DataFrame, event_id: str, id_column: str, date: str, seq, **amounts: str) -> DataFrame:
    return df.filter(F.col(id_column).isNotNull() & F.col(date).isNotNull()).select(
        F.col(id_column).alias("id"),
        F.col(date).alias("dates"),
        F.lit(event_id).alias("event_id"),
        (F.col(seq) if isinstance(seq, str) else F.lit(0)).cast("long").alias("seq"),
        *[F.col(source).alias(name) for name, source in amounts.items()],
    )


def all_events(sources: dict) -> DataFrame:
    """The seven kinds of dated events in one frame."""
    companies = sources["objects"].filter(F.col("entity_type") == "company")
    acquisitions = sources["acquisitions"]
    first_sale = acquisitions.groupBy("acquired_object_id").agg(F.min("acquired_at").alias("acquired_at"))
    rounds = sources["funding_rounds"].select("funding_round_id", "funded_at", "raised_amount_usd", "participants")
    # only companies invest on the timeline, so organisations drop out before the join
    made = sources["investments"].join(
        companies.select(F.col("id").alias("investor_object_id")), "investor_object_id", "left_semi"
    ).join(rounds, "funding_round_id")
    return append_events(
        _kind(sources["funding_rounds"], "funded", "object_id", "funded_at", "funding_round_id",
              famt="raised_amount_usd", investors="participants"),
        _kind(first_sale, "acquired", "acquired_object_id", "acquired_at", None),
        _kind(sources["ipos"], "public", "object_id", "public_at", "ipo_id"),
        _kind(companies, "closed", "id", "closed_at", None),
        _kind(sources["milestones"], "milestone", "object_id", "milestone_at", "milestone_id"),
        _kind(made, "investment", "investor_object_id", "funded_at", "funding_round_id",
              iamt="raised_amount_usd", iparts="participants"),
        _kind(acquisitions, "acquisition", "acquiring_object_id", "acquired_at", "acquisition_id",
              aamt="price_amount"),
    )


def timeline_starts(entity: DataFrame, funding_rounds: DataFrame) -> DataFrame:
    """Founding date of the companies that have at least one funding round."""
    funded = funding_rounds.filter(F.col("funded_at").isNotNull()).select(F.col("object_id").alias("id"))
    return entity.select("id", "dates").join(funded.distinct(), "id", "left_semi")


def time_events(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds the founding events and days since founding; companies without a start drop out.

    Founding events are stacked before the join, so that the join on the id
    already places the rows for the numbering that follows.
    """
    own = starts.select("id", "dates", F.lit("founded").alias("event_id"), F.lit(0).cast("long").alias("seq"))
    founded = starts.select("id", F.col("dates").alias("founded_on"))
    return (
        append_events(events, own)
        .join(founded, "id")
        .withColumn("time_to_event", days_between("founded_on", "dates"))
        .drop("founded_on")
    )


def number_events(
    timed: DataFrame, limit: int | None = ROWS_PER_GROUP, sized_by: DataFrame | None = None
) -> DataFrame:
    """Running amount, event number and gap to the previous event of the same kind.

    All three use one grouping and one order, hence one shuffle and one sort.
    """
    scanned = ordered_scan(
        timed,
        by=["id", "event_id"],
        order=["dates", "seq"],
        calcs={
            "_sum": running_sum("famt"),
            "event_count": row_number(),
            "_before": previous("time_to_event"),
        },
        limit=limit,
        sized_by=sized_by,
    )
    return scanned.withColumn("famt_cumsum", F.when(F.col("famt").isNotNull(), F.col("_sum"))).withColumn(
        "time_diff", F.coalesce(F.col("time_to_event") - F.col("_before"), "time_to_event")
    ).drop("_sum", "_before")


def event_timeline(sources: dict, entity: DataFrame, limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """The timeline; rows before the founding date go after numbering, not before."""
    starts = timeline_starts(entity, sources["funding_rounds"])
    events = all_events(sources)
    numbered = number_events(time_events(events, starts), limit, events)
    return numbered.filter((F.col("time_diff") >= 0) & (F.col("time_to_event") >= 0)).select(
        "id", "dates", "event_id", "seq", "famt", "investors", "famt_cumsum", "iamt", "iparts", "aamt",
        "time_to_event", "event_count", "time_diff",
    )


def on_timeline(entity: DataFrame, timeline: DataFrame) -> DataFrame:
    """Companies that have at least one timeline row."""
    return entity.join(timeline.select("id").distinct(), "id", "left_semi")


def funding_trajectory(objects: DataFrame, funding_rounds: DataFrame, limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Rounds with a known amount, days since founding and a running index from zero."""
    rounds = funding_rounds.filter(F.col("raised_amount_usd").isNotNull()).withColumnRenamed("object_id", "id")
    # rounds stand on the left so that a hot company is split at run time
    dated = (
        rounds.join(objects.filter(F.col("founded_at").isNotNull()).select("id", "name", "founded_at"), "id")
        .withColumn("time_to_funding", days_between("founded_at", "funded_at"))
        .filter(F.col("time_to_funding").isNotNull())
    )
    numbered = ordered_scan(dated, ["id"], ["funded_at", "funding_round_id"], {"n": row_number()}, limit, rounds)
    return numbered.select(
        "id", "name", "funding_round_id", "funding_round_code", "funded_at", "raised_amount_usd",
        "time_to_funding", (F.col("n") - 1).alias("fund_idx"),
    )


def trajectory_points(timeline: DataFrame) -> DataFrame:
    """Plot data: years and running amount per funded event, and a zero point per company."""
    funded = timeline.filter(F.col("event_id") == "funded").select(
        "id", "seq", years("time_to_event").alias("years"), F.col("famt_cumsum").alias("amount")
    )
    origin = funded.select("id").distinct().select(
        "id", F.lit(-1).cast("long").alias("seq"), F.lit(0.0).alias("years"), F.lit(0.0).alias("amount")
    )
    return origin.unionByName(funded)
