"""Tables behind the result pages: ranking, messages, comparable companies, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import date_text, display_names, money_text, percent_text, spaced, starts_with
from ..operators.scan import ROWS_PER_GROUP, ordered_scan, row_number
from ..operators.similar import nearest
from .labels import LATE, SLOW, TIMELY
from .matrix import NUMERIC, category_columns

# Display names of categories and features.
CATEGORY_NAMES = {
    "games_video": "video games",
    "network_hosting": "network hosting",
    "photo_video": "photo/video",
    "public_relations": "public relations",
    "real_estate": "real estate",
}
FEATURE_NAMES = {
    "acquisition_events": "Acquisitions Made",
    "mean_acquisition_time": "Mean Time To Acquistions Made",
    "latitude": "Company Location: Latitude",
    "longitude": "Company Location: Longitude",
    "mean_famt": "Mean Funding Amount",
    "mean_funded_time": "Mean Time Between Funding Rounds",
    "offices": "Number of Offices",
    "funded_events": "Number of Funding Rounds",
    "mean_milestone_time": "Mean Time Between Milestones",
    "experience": "Years of Founder Experience",
    "investment_events": "Investments Made",
    "milestone_events": "Milestones",
    "products": "Products",
    "famt_cumsum": "Cumulative Funding Received",
    "mean_investment_time": "Mean Time Between Investments",
}
# Sentences of the result page.
PREDICTED = {
    TIMELY: " will exit in a timely fashion!",
    LATE: " will exit, but in a long time.",
    SLOW: " will continue operating without exit.",
}
NO_PREDICTION = ": Oops! It doesn't look like we have a prediction for that company."
NO_INFORMATION = ": Oops! It doesn't look like we have any information on that company."
OPERATES = " continues to operate."
WENT_PUBLIC = " went public on "
WAS_ACQUIRED = " was acquired on "
BEFORE_MEDIAN = " exited before the median age for its industry."
AFTER_MEDIAN = " exited after the median age for its industry."


def last_funding(timeline: DataFrame) -> DataFrame:
    """Largest date, amount and age over the funding events of each company."""
    names = ("dates", "famt_cumsum", "time_to_event")
    return timeline.filter(F.col("event_id") == "funded").groupBy("id").agg(*[F.max(c).alias(c) for c in names])


def exit_candidates(predictions: DataFrame, entity: DataFrame, timeline: DataFrame) -> DataFrame:
    """Companies predicted to exit in time, most probable first, with display columns."""
    chosen = predictions.filter(F.col("pred") == TIMELY).select("id", "proba0")
    funding = last_funding(timeline).select("id", F.col("dates").alias("last_funding_date"), "famt_cumsum")
    general = entity.select(
        "id", "name", display_names("category_code", CATEGORY_NAMES).alias("category"),
        F.col("dates").alias("founding_date"),
    )
    return (
        chosen.join(general, "id")
        .join(funding, "id")
        .filter(F.col("founding_date") != F.col("last_funding_date"))
        .select(
            "id", "name", "category", "proba0",
            date_text("founding_date").alias("founded"),
            date_text("last_funding_date").alias("last_funded"),
            money_text("famt_cumsum").alias("famt_str"),
        )
        .orderBy(F.col("proba0").desc(), "id")
    )


def page(ordered: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page of an ordered result, counted from zero."""
    return ordered.offset(number * size).limit(size)


def _exit_message(prefix: str, date: Column, label: Column) -> Column:
    verdict = F.when(label == TIMELY, F.concat(F.lit(" "), "name", F.lit(BEFORE_MEDIAN))).when(
        label == LATE, F.concat(F.lit(" "), "name", F.lit(AFTER_MEDIAN))
    )
    return F.concat(F.lit(prefix), date_text(date), F.lit("!"), F.coalesce(verdict, F.lit("")))


def outcome_messages(entity: DataFrame, timeline: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """One sentence per company: the prediction of a start-up, or what became of the company.

    A status without its dated event has no date to print and gives no message.
    """
    dates = timeline.groupBy("id").agg(
        F.min(F.when(F.col("event_id") == "public", F.col("dates"))).alias("public_on"),
        F.min(F.when(F.col("event_id") == "acquired", F.col("dates"))).alias("acquired_on"),
    )
    known = predictions.select("id", "pred", F.lit(True).alias("is_startup"))
    predicted = reduce(
        lambda chain, item: chain.when(F.col("pred") == item[0], item[1]),
        PREDICTED.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    ).otherwise(NO_PREDICTION)
    label, status = F.col("label"), F.col("status")
    message = (
        F.when(F.col("is_startup"), predicted)
        .when(status == "operating", OPERATES)
        .when(status == "ipo", _exit_message(WENT_PUBLIC, F.col("public_on"), label))
        .when(status == "acquired", _exit_message(WAS_ACQUIRED, F.col("acquired_on"), label))
        .otherwise(NO_INFORMATION)
    )
    return (
        entity.select("id", "name", "status")
        .join(known, "id", "left")
        .join(labels, "id", "left")
        .join(dates, "id", "left")
        .select("id", F.coalesce("is_startup", F.lit(False)).alias("is_startup"), F.concat("name", message).alias("message"))
    )


def success_messages(static: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sentence per company from a yes/no prediction."""
    likely = F.format_string("The company %s will likely exit successfully!", "name")
    unlikely = F.format_string("The company %s will probably not exit successfully!", "name")
    return static.select("id", "name", "permalink").join(predictions.select("id", "success"), "id").select(
        "id", "permalink", F.when(F.col("success"), likely).otherwise(unlikely).alias("message")
    )


def comparable_companies(
    asof: DataFrame, categories: list[str], k: int = 6, block_rows: int | None = None
) -> DataFrame:
    """The labelled companies most similar to each unlabelled one, as of its own age."""
    vector = F.array(*[F.col(c).cast("double") for c in [*NUMERIC, *category_columns(categories)]])
    rows = asof.select("cut", "id", "is_query", vector.alias("vector"))
    return nearest(
        rows.filter("is_query"), rows.filter("NOT is_query"), k, by=["cut"], block_rows=block_rows
    )


def company_ids(entity: DataFrame, name: str) -> DataFrame:
    """Id of the company with exactly this name; no row if there is none."""
    return entity.filter(F.col("name") == name).groupBy("name").agg(F.min("id").alias("id"))


def name_suggestions(entity: DataFrame, prefix: str) -> DataFrame:
    return entity.filter(starts_with("name", prefix)).select("id", "name")


def names_json(entity: DataFrame, size: int = 1000, limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Names in order as JSON lists of at most ``size`` names, one list per row."""
    ordered = ordered_scan(entity.select("id", "name"), [], ["name", "id"], {"n": row_number()}, limit)
    return ordered.groupBy(F.floor((F.col("n") - 1) / size).alias("list_no")).agg(
        F.to_json(F.sort_array(F.collect_list("name"))).alias("names")
    )


def named_importances(importances: DataFrame, top: int = 6) -> DataFrame:
    """The highest importances per model under their display names.

    Features without a display name are left out before the ranking.
    """
    pairs = [F.lit(x) for item in FEATURE_NAMES.items() for x in item]
    named = importances.withColumn("name", F.try_element_at(F.create_map(*pairs), "feature")).filter(
        F.col("name").isNotNull()
    )
    # a model has at most as many rows as there are display names
    ranked = ordered_scan(named, ["model_key"], [F.col("importance").desc(), "feature"], {"rank": row_number()}, None)
    return ranked.filter(F.col("rank") <= top).select(
        "model_key", "rank", spaced("name").alias("name"), percent_text("importance").alias("share")
    )


def count_answer(rows: DataFrame, asked: bool = True) -> DataFrame:
    """Number of rows as text, or a note when nothing was asked for."""
    count = F.count(F.lit(1)).cast("string")
    return rows.agg((count if asked else F.lit("check your input")).alias("answer"))


def founded_per_year(entity: DataFrame) -> DataFrame:
    return entity.groupBy(F.year("dates").alias("year")).agg(F.count(F.lit(1)).alias("founded"))


def latest_date(timeline: DataFrame) -> DataFrame:
    return timeline.agg(F.max("dates").alias("today"))


def oldest_cut(cuts: DataFrame) -> DataFrame:
    """Company with the largest cut age; the smallest id on a tie."""
    best = cuts.groupBy("cut").agg(F.min("id").alias("id"))
    return best.agg(F.max_by("id", "cut").alias("id"), F.max("cut").alias("cut"))
