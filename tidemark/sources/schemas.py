"""Declared schemas of the source tables and derived frames."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES = {
    "string": StringType(),
    "date": DateType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "long": LongType(),
}


def _schema(**fields: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields.items()])


SOURCE_SCHEMAS = {
    "objects": _schema(
        id="string", name="string", permalink="string", category_code="string", status="string",
        founded_at="date", entity_type="string", closed_at="date", parent_id="string",
        funding_rounds="long", investment_rounds="long", invested_companies="long",
        funding_total_usd="double", last_funding_at="date",
    ),
    "acquisitions": _schema(
        acquisition_id="long", acquiring_object_id="string", acquired_object_id="string",
        acquired_at="date", term_code="string", price_amount="double",
    ),
    "ipos": _schema(ipo_id="long", object_id="string", public_at="date"),
    "milestones": _schema(milestone_id="long", object_id="string", milestone_at="date"),
    "offices": _schema(
        office_id="long", object_id="string", latitude="double", longitude="double", description="string"
    ),
    "funding_rounds": _schema(
        funding_round_id="long", object_id="string", funding_round_type="string",
        funding_round_code="string", funded_at="date", raised_amount_usd="double", participants="int",
    ),
    "investments": _schema(funding_round_id="long", investor_object_id="string"),
    "relationships": _schema(
        person_object_id="string", relationship_object_id="string", start_at="date", title="string"
    ),
}

TIMELINE = _schema(
    id="string", dates="date", event_id="string", seq="long", famt="double", investors="int",
    famt_cumsum="double", iamt="double", iparts="int", aamt="double",
    time_to_event="int", event_count="long", time_diff="int",
)
