"""Static feature table: one row per founded company, and its age label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import count_true, days_between, ratio, smallest
from ..operators.features import one_hot
from ..operators.scan import ROWS_PER_GROUP, ordered_scan, previous
from ..session import freeze
from .entity import children, experience, first_place, founded_companies

# a row with none of these says nothing about its company
INFORMATION = [
    "acquired_at", "age_at_acq", "public_at", "age_at_ipo", "closed_at", "age_at_close", "milestones",
    "latitude", "longitude", "offices", "products", "funding_rounds", "investment_rounds",
    "invested_companies", "acq_before_acq", "acq_before_ipo", "acq_before_exit", "investors",
    "investors_per_round", "funding_total_usd", "funding_per_round", "experience",
]


def _companies(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("entity_type") == "company")


def first_acquisition(acquisitions: DataFrame) -> DataFrame:
    return acquisitions.groupBy(F.col("acquired_object_id").alias("id")).agg(F.min("acquired_at").alias("acquired_at"))


def first_listing(ipos: DataFrame) -> DataFrame:
    return ipos.groupBy(F.col("object_id").alias("id")).agg(F.min("public_at").alias("public_at"))


def milestones_before_sale(milestones: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Distinct milestone dates before the first sale, for companies that have both."""
    days = milestones.select(F.col("object_id").alias("id"), "milestone_at").distinct()
    return days.join(first_acquisition(acquisitions), "id").groupBy("id").agg(
        F.count_if(F.col("milestone_at") < F.col("acquired_at")).alias("milestones")
    )


def acquisitions_before_sale(acquisitions: DataFrame) -> DataFrame:
    """Distinct purchase dates before the buyer's own sale; NULL if no date is known."""
    bought = acquisitions.filter(F.col("acquiring_object_id").isNotNull()).select(
        F.col("acquiring_object_id").alias("id"), F.col("acquired_at").alias("bought_at")
    ).distinct()
    return bought.join(first_acquisition(acquisitions), "id").groupBy("id").agg(
        count_true(F.col("bought_at") < F.col("acquired_at")).alias("acq_before_acq")
    )


def acquisitions_before_listing(acquisitions: DataFrame, ipos: DataFrame) -> DataFrame:
    bought = acquisitions.select(F.col("acquiring_object_id").alias("id"), F.col("acquired_at").alias("bought_at"))
    return bought.join(first_listing(ipos), "id").groupBy("id").agg(
        count_true(F.col("bought_at") < F.col("public_at")).alias("acq_before_ipo")
    )


def investor_counts(
    objects: DataFrame, funding_rounds: DataFrame, investments: DataFrame, investor_type: str = "FinancialOrg"
) -> DataFrame:
    """Investments by organisations of one type, per funded object.

    Investments are counted per round before they meet the rounds.
    """
    organisations = objects.filter(F.col("entity_type") == investor_type).select(
        F.col("id").alias("investor_object_id")
    )
    per_round = (
        investments.join(organisations, "investor_object_id", "left_semi")
        .groupBy("funding_round_id")
        .agg(F.count("investor_object_id").alias("n"))
    )
    rounds = funding_rounds.select("funding_round_id", F.col("object_id").alias("id"))
    return (
        rounds.join(per_round, "funding_round_id")
        .groupBy("id")
        .agg(F.sum("n").alias("investors"))
        .join(objects.select("id"), "id", "left_semi")
    )


def mean_round_gap(objects: DataFrame, funding_rounds: DataFrame, limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Mean days between funding rounds; the first gap counts from the founding, negative gaps drop out."""
    rounds = funding_rounds.filter(F.col("raised_amount_usd").isNotNull()).select(
        F.col("object_id").alias("id"), "funding_round_id", "funded_at"
    )
    timed = (
        rounds.join(objects.select("id", "founded_at"), "id")
        .withColumn("time_to_funding", days_between("founded_at", "funded_at"))
        .filter(F.col("time_to_funding").isNotNull())
    )
    scanned = ordered_scan(timed, ["id"], ["funded_at", "funding_round_id"], {"_before": previous("time_to_funding")}, limit, rounds)
    gap = F.coalesce(F.col("time_to_funding") - F.col("_before"), "time_to_funding")
    return scanned.select("id", gap.alias("gap")).filter(F.col("gap") >= 0).groupBy("id").agg(
        F.avg("gap").alias("mean_round_gap")
    )


def last_round_code(objects: DataFrame, funding_rounds: DataFrame) -> DataFrame:
    """Code of the round on the last funding date, the highest round number among several."""
    latest = objects.filter(F.col("founded_at").isNotNull()).select("id", F.col("last_funding_at").alias("funded_at"))
    rounds = funding_rounds.select(F.col("object_id").alias("id"), "funded_at", "funding_round_id", "funding_round_code")
    return rounds.join(latest, ["id", "funded_at"]).groupBy("id").agg(
        F.max_by("funding_round_code", "funding_round_id").alias("last_funding_round_code")
    )


def static_features(
    sources: dict, title_pattern: str, today: str, round_codes: list[str], limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """All static features; every source is reduced to one row per company before it is joined."""
    objects, rounds = sources["objects"], sources["funding_rounds"]
    acquisitions, ipos = sources["acquisitions"], sources["ipos"]
    # rows are made unique while they are narrow; the joins go on with the same partitioning
    companies = founded_companies(objects).select(
        "id", "name", "permalink", "category_code", "status", "founded_at", "closed_at",
        "funding_rounds", "investment_rounds", "invested_companies", "funding_total_usd",
    ).dropDuplicates(["id"])
    parts = [
        first_acquisition(acquisitions),
        first_listing(ipos),
        milestones_before_sale(sources["milestones"], acquisitions),
        first_place(sources["offices"]),
        children(objects),
        acquisitions_before_sale(acquisitions),
        acquisitions_before_listing(acquisitions, ipos),
        investor_counts(objects, rounds, sources["investments"]),
        mean_round_gap(objects, rounds, limit),
        last_round_code(objects, rounds),
        experience(companies, sources["relationships"], title_pattern),
    ]
    frame = companies
    for part in parts:
        frame = frame.join(part, "id", "left")
    frame = frame.withColumns(
        {
            "age_at_acq": days_between("founded_at", "acquired_at"),
            "age_at_ipo": days_between("founded_at", "public_at"),
            "age_at_close": days_between("founded_at", "closed_at"),
            "acq_before_exit": smallest("acq_before_acq", "acq_before_ipo"),
            "investors_per_round": ratio("investors", "funding_rounds"),
            "funding_per_round": ratio("funding_total_usd", "funding_rounds"),
        }
    )
    frame = frame.withColumn("age_at_exit", smallest("age_at_acq", "age_at_ipo", "age_at_close"))
    frame = frame.na.drop(how="all", subset=INFORMATION).withColumns(
        {
            "category_code": F.coalesce("category_code", F.lit("other")),
            "age_at_exit": F.coalesce("age_at_exit", days_between("founded_at", F.lit(today).cast("date"))),
        }
    )
    return one_hot(frame, "last_funding_round_code", round_codes, "code_")


def age_thresholds(static: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Per category mean age plus a number of sample deviations; NULL for a category of one."""
    return static.groupBy("category_code").agg(
        (F.avg("age_at_exit") + deviations * F.stddev_samp("age_at_exit")).alias("threshold")
    )


def static_labels(static: DataFrame, deviations: float = 2.0) -> DataFrame:
    """0 closed, 1 sold or listed, 2 operating beyond the threshold, 3 operating below it."""
    age, threshold, status = F.col("age_at_exit"), F.col("threshold"), F.col("status")
    # the table is read twice, and the join then knows how small the thresholds are
    static = freeze(static)
    return static.join(freeze(age_thresholds(static, deviations)), "category_code", "left").withColumn(
        "label",
        F.when(status == "closed", 0)
        .when(status.isin("acquired", "ipo"), 1)
        .when((status == "operating") & (age >= threshold), 2)
        .when((status == "operating") & (age < threshold), 3),
    )
