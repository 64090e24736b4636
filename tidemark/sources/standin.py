"""Source tables derived from the given parquet tables.

The company database of the original problem is not available.  ``events`` plays
the history of a company, ``customer`` the company itself, ``orders`` its offices
and products, ``supplier`` the financial organisations and ``part`` the people.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Read = Callable[[str], DataFrame]

SOLD_VALUE = 150
LISTED_VALUE = 250
FOUNDED_VALUE = 100


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def objects(read: Read) -> DataFrame:
    kind, value, day = F.col("event_type"), F.col("value"), F.to_date("ts")
    activity = read("events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.min(F.when((kind == "signup") & (value > FOUNDED_VALUE), day)).alias("founded_at"),
        F.max(day).alias("last_seen"),
        F.count_if(kind == "purchase").alias("funding_rounds"),
        F.count_if(kind == "view").alias("investment_rounds"),
        F.count_if(kind == "error").alias("invested_companies"),
        F.sum(F.when(kind == "purchase", value * 1000)).alias("funding_total_usd"),
        F.max(F.when(kind == "purchase", day)).alias("last_funding_at"),
        F.count_if((kind == "error") & (value > SOLD_VALUE)).alias("n_sold"),
        F.count_if((kind == "view") & (value > LISTED_VALUE)).alias("n_listed"),
    )
    closed = F.col("c_acctbal") < 0
    companies = (
        read("customer")
        .join(activity, "c_custkey", "left")
        .select(
            _key("c:", "c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("/company/"), "c_name").alias("permalink"),
            F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("category_code"),
            F.when(closed, "closed").when(F.col("n_sold") > 0, "acquired")
            .when(F.col("n_listed") > 0, "ipo").otherwise("operating").alias("status"),
            "founded_at",
            F.lit("company").alias("entity_type"),
            F.when(closed, F.col("last_seen")).alias("closed_at"),
            F.lit(None).cast("string").alias("parent_id"),
            "funding_rounds", "investment_rounds", "invested_companies", "funding_total_usd", "last_funding_at",
        )
    )
    products = read("orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        _key("r:", "o_orderkey").alias("id"), _key("Product ", "o_orderkey").alias("name"),
        F.lit("live").alias("status"), F.lit("Product").alias("entity_type"),
        _key("c:", "o_custkey").alias("parent_id"),
    )
    investors = read("supplier").select(
        _key("f:", "s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.lit("operating").alias("status"), F.lit("FinancialOrg").alias("entity_type"),
    )
    people = read("part").select(
        _key("p:", "p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.lit("live").alias("status"), F.lit("Person").alias("entity_type"),
    )
    frame = companies
    for other in (products, investors, people):
        frame = frame.unionByName(other, allowMissingColumns=True)
    return frame


def funding_rounds(read: Read) -> DataFrame:
    value = F.col("value")
    return read("events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("funding_round_id"),
        _key("c:", "user_id").alias("object_id"),
        F.when(value < 20, "angel").otherwise("venture").alias("funding_round_type"),
        F.when(value < 20, "seed").when(value < 60, "a").when(value < 120, "b").alias("funding_round_code"),
        F.to_date("ts").alias("funded_at"),
        F.when(value >= 5, value * 1000).alias("raised_amount_usd"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("participants"),
    )


def investments(read: Read) -> DataFrame:
    organisations = read("lineitem").select(
        F.col("l_orderkey").alias("funding_round_id"), _key("f:", "l_suppkey").alias("investor_object_id")
    )
    companies = read("orders").select(
        F.col("o_orderkey").alias("funding_round_id"), _key("c:", "o_custkey").alias("investor_object_id")
    )
    return organisations.unionByName(companies)


def acquisitions(read: Read) -> DataFrame:
    sold = read("events").filter(
        (F.col("event_type") == "error") & (F.col("value") > SOLD_VALUE)
    )
    buyers = read("orders").select(
        F.col("o_orderkey").alias("event_id"), "o_custkey", "o_orderstatus"
    )
    return sold.join(buyers, "event_id", "left").select(
        F.col("event_id").alias("acquisition_id"),
        _key("c:", "o_custkey").alias("acquiring_object_id"),
        _key("c:", "user_id").alias("acquired_object_id"),
        F.to_date("ts").alias("acquired_at"),
        F.col("o_orderstatus").alias("term_code"),
        F.when(F.col("value") > 200, F.col("value") * 1000).alias("price_amount"),
    )


def ipos(read: Read) -> DataFrame:
    return read("events").filter(
        (F.col("event_type") == "view") & (F.col("value") > LISTED_VALUE)
    ).select(
        F.col("event_id").alias("ipo_id"), _key("c:", "user_id").alias("object_id"),
        F.to_date("ts").alias("public_at"),
    )


def milestones(read: Read) -> DataFrame:
    return read("events").filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("milestone_id"), _key("c:", "user_id").alias("object_id"),
        F.to_date("ts").alias("milestone_at"),
    )


def offices(read: Read) -> DataFrame:
    price = F.col("o_totalprice")
    return read("orders").select(
        F.col("o_orderkey").alias("office_id"),
        _key("c:", "o_custkey").alias("object_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", price / 10000).alias("latitude"),
        F.when(F.col("o_orderstatus") != "P", price / 5000).alias("longitude"),
        F.col("o_orderpriority").alias("description"),
    )


def relationships(read: Read) -> DataFrame:
    orders = read("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    return read("lineitem").join(orders, "l_orderkey").select(
        _key("p:", "l_partkey").alias("person_object_id"),
        _key("c:", "o_custkey").alias("relationship_object_id"),
        F.add_months(F.to_date("l_shipdate"), 300).alias("start_at"),
        F.col("o_orderpriority").alias("title"),
    )


TABLES = {
    "objects": objects,
    "funding_rounds": funding_rounds,
    "investments": investments,
    "acquisitions": acquisitions,
    "ipos": ipos,
    "milestones": milestones,
    "offices": offices,
    "relationships": relationships,
}


class Sources(dict):
    """Source tables by name, derived on first use; each file is opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self._spark, self._folder, self._files = spark, folder, {}

    def read(self, name: str) -> DataFrame:
        if name not in self._files:
            self._files[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._files[name]

    def __missing__(self, name: str) -> DataFrame:
        self[name] = TABLES[name](self.read)
        return self[name]
