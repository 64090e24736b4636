"""Feature matrix, whole and as of many age cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.features import fill_and_scale, indicators
from ..operators.scan import ROWS_PER_GROUP, following, ordered_scan, running_max, running_sum
from ..session import freeze
from .labels import YOUNG, ages

STATIC = ["latitude", "longitude", "offices", "products", "experience"]
KINDS = ["funded", "milestone", "investment", "acquisition"]
DYNAMIC = ["mean_famt", "famt_cumsum"] + [c for k in KINDS for c in (f"mean_{k}_time", f"{k}_events")]
NUMERIC = STATIC + DYNAMIC


def category_columns(categories: list[str]) -> list[str]:
    """Indicator names; the prefix keeps a category such as ``offices`` apart from the feature of that name."""
    return [f"category_{c}" for c in categories]


def _is(kind: str) -> Column:
    return F.col("event_id") == kind


def event_features(timeline: DataFrame) -> DataFrame:
    """Mean gap and count per kind of event, mean and total amount; one aggregate."""
    per_kind = []
    for k in KINDS:
        per_kind.append(F.avg(F.when(_is(k), F.col("time_diff"))).alias(f"mean_{k}_time"))
        per_kind.append(F.max(F.when(_is(k), F.col("event_count"))).alias(f"{k}_events"))
    return timeline.groupBy("id").agg(
        F.avg(F.when(_is("funded"), F.col("famt"))).alias("mean_famt"),
        F.max(F.when(_is("funded"), F.col("famt_cumsum"))).alias("famt_cumsum"),
        *per_kind,
    )


def raw_matrix(timeline: DataFrame, entity: DataFrame, categories: list[str]) -> DataFrame:
    """Features with gaps: numeric columns and one 0/1 column per category."""
    return entity.join(event_features(timeline), "id", "left").select(
        "id", *NUMERIC, *indicators("category_code", categories, "category_")
    )


def feature_matrix(
    timeline: DataFrame, entity: DataFrame, categories: list[str], limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Median-filled, standardised numeric features and plain category columns."""
    return fill_and_scale(freeze(raw_matrix(timeline, entity, categories)), NUMERIC, limit=limit)


def cut_ages(timeline: DataFrame, labels: DataFrame, step: int = 1) -> DataFrame:
    """Cut of every unlabelled company: its own age, rounded up to a multiple of ``step`` days.

    ``age`` stays beside it, since a company's own events count only up to its own age.
    """
    young = labels.filter(F.col("label") == YOUNG).select("id")
    return ages(timeline).join(young, "id", "left_semi").select(
        "id", (F.ceil(F.col("age") / step) * step).cast("int").alias("cut"), F.col("age").cast("int").alias("age")
    )


def _day_totals(timeline: DataFrame) -> DataFrame:
    """Addable parts of the event features per company and day."""
    parts = [
        F.sum(F.when(_is("funded"), F.col("famt"))).alias("famt_sum"),
        F.count(F.when(_is("funded"), F.col("famt"))).alias("famt_n"),
        F.max(F.when(_is("funded"), F.col("famt_cumsum"))).alias("famt_cumsum"),
    ]
    for k in KINDS:
        parts.append(F.sum(F.when(_is(k), F.col("time_diff"))).alias(f"{k}_sum"))
        parts.append(F.count(F.when(_is(k), F.col("time_diff"))).alias(f"{k}_n"))
        parts.append(F.max(F.when(_is(k), F.col("event_count"))).alias(f"{k}_events"))
    return timeline.groupBy("id", F.col("time_to_event").alias("day")).agg(*parts)


def states(timeline: DataFrame, entity: DataFrame | None = None, limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Event features after each event day, valid from ``day`` until ``next_day``.

    Running totals give every later cut its features without joining events to
    cuts.  With ``entity`` every company also has its state before any event,
    at day -1.
    """
    days = _day_totals(timeline)
    if entity is not None:
        days = days.unionByName(
            entity.select("id", F.lit(-1).alias("day")), allowMissingColumns=True
        )
    sums = ["famt_sum", "famt_n"] + [f"{k}_{p}" for k in KINDS for p in ("sum", "n")]
    tops = ["famt_cumsum"] + [f"{k}_events" for k in KINDS]
    calcs = {f"run_{c}": running_sum(c) for c in sums}
    calcs.update({f"run_{c}": running_max(c) for c in tops})
    calcs["next_day"] = following("day")
    run = ordered_scan(freeze(days), ["id"], ["day"], calcs, limit)

    def mean(total: str, count: str) -> Column:
        return F.try_divide(F.col(f"run_{total}").cast("double"), F.col(f"run_{count}").cast("double"))

    columns = [mean("famt_sum", "famt_n").alias("mean_famt"), F.col("run_famt_cumsum").alias("famt_cumsum")]
    for k in KINDS:
        columns.append(mean(f"{k}_sum", f"{k}_n").alias(f"mean_{k}_time"))
        columns.append(F.col(f"run_{k}_events").alias(f"{k}_events"))
    return run.select("id", "day", "next_day", *columns)


def asof_matrix(
    timeline: DataFrame,
    entity: DataFrame,
    labels: DataFrame,
    cuts: DataFrame,
    categories: list[str],
    limit: int | None = ROWS_PER_GROUP,
) -> DataFrame:
    """Feature matrix per cut, from events strictly younger than the cut.

    A cut holds every labelled company, and the unlabelled ones whose own cut
    it is; those are seen as of their own age, which a rounded cut may exceed.
    Companies and their states meet on the id; only then does each state write
    out the cuts it is valid for, so nothing but result rows is made and none
    of them is shuffled by company.  Filling and scaling happen inside the cut.
    """
    # cuts are whole days of age: one row, as long as the oldest company has days
    calendar = freeze(
        cuts.agg(F.array_sort(F.collect_set("cut")).alias("_cuts"), F.coalesce(F.max("cut"), F.lit(-1)).alias("_end"))
    )
    roles = labels.join(cuts, "id", "left").select("id", (F.col("label") == YOUNG).alias("is_query"), "cut", "age")
    companies = entity.join(roles, "id").select(
        "id", "category_code", "is_query", F.col("cut").alias("_own"), F.col("age").alias("_age"), *STATIC
    )
    last = F.coalesce("next_day", "_end")
    own = (F.col("_age") > F.col("day")) & (F.col("_age") <= F.coalesce("next_day", "_age"))
    valid = F.when(F.col("is_query"), F.when(own, F.array("_own"))).otherwise(
        F.filter("_cuts", lambda c: (c > F.col("day")) & (c <= last))
    )
    raw = (
        states(timeline, entity, limit)
        .join(F.broadcast(calendar))
        .filter(F.col("day") < F.col("_end"))
        .join(companies, "id")
        .withColumn("cut", F.explode(valid))
        .select("cut", "id", "is_query", *NUMERIC, *indicators("category_code", categories, "category_"))
    )
    return fill_and_scale(freeze(raw), NUMERIC, ["cut"], limit)


def asof_totals(timeline: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per distinct cut the number of events and companies' amounts before it.

    Events are totalled per day first; the rest works on one row per day.
    """
    daily = timeline.groupBy(F.col("time_to_event").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("famt", F.lit(0.0))).alias("amount")
    )
    marks = cuts.select(F.col("cut").alias("day")).filter(F.col("day").isNotNull()).distinct().withColumn("is_cut", F.lit(0))
    merged = daily.withColumn("is_cut", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    # a cut sorts before the events of its own day, which it excludes; one row per day and mark
    run = ordered_scan(
        merged, [], ["day", "is_cut"], {"n": running_sum("events"), "total": running_sum("amount")}, limit=None
    )
    return run.filter(F.col("is_cut") == 0).select(
        F.col("day").alias("cut"),
        F.coalesce("n", F.lit(0)).alias("events"),
        F.coalesce("total", F.lit(0.0)).alias("amount"),
    )
