"""Entity frame: one row per company with its unchanging features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import days_between, matches, not_negative


def founded_companies(objects: DataFrame) -> DataFrame:
    return objects.filter((F.col("entity_type") == "company") & F.col("founded_at").isNotNull())


def first_place(offices: DataFrame) -> DataFrame:
    """Per company the first known latitude and longitude by office number, and the office count."""
    return offices.groupBy(F.col("object_id").alias("id")).agg(
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("office_id"))).alias(c)
            for c in ("latitude", "longitude")
        ],
        F.count("object_id").alias("offices"),
    )


def children(objects: DataFrame) -> DataFrame:
    """Number of objects that name a company as their parent."""
    return objects.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(
        F.count("id").alias("products")
    )


def earliest_starts(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("person_object_id").agg(F.min("start_at").alias("earliest_start"))


def leadership(relationships: DataFrame, title_pattern: str) -> DataFrame:
    """Distinct (company, person) pairs whose title matches the pattern."""
    return (
        relationships.filter(matches("title", title_pattern))
        .select(F.col("relationship_object_id").alias("id"), "person_object_id")
        .distinct()
    )


def experience(
    companies: DataFrame, relationships: DataFrame, title_pattern: str, founded: str = "founded_at"
) -> DataFrame:
    """Days the leaders of a company worked before its founding, summed.

    The earliest start is taken once per person before the join, so no row
    carries more than one start date.
    """
    pairs = leadership(relationships, title_pattern).join(companies.select("id", founded), "id")
    return (
        pairs.join(earliest_starts(relationships), "person_object_id")
        .select("id", not_negative(days_between("earliest_start", founded)).alias("days"))
        .groupBy("id")
        .agg(F.sum("days").alias("experience"))
    )


def entity_frame(
    objects: DataFrame,
    offices: DataFrame,
    relationships: DataFrame,
    title_pattern: str,
    experience_join: str = "inner",
) -> DataFrame:
    """Companies with place, offices, products and experience.

    The inner join keeps only companies that have leaders; an experience without
    any known value counts as zero days.
    """
    companies = founded_companies(objects).select(
        "id", "name", "category_code", "status", F.col("founded_at").alias("dates")
    )
    known = experience(companies, relationships, title_pattern, "dates").select(
        "id", F.coalesce("experience", F.lit(0)).alias("experience")
    )
    return (
        companies.join(known, "id", experience_join)
        .join(first_place(offices), "id", "left")
        .join(children(objects), "id", "left")
        .select(
            "id", "name", "category_code", "status", "dates", "latitude", "longitude",
            "offices", "products", "experience",
        )
    )
