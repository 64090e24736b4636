"""Joins, filters and counts over the source tables."""

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators.features import minus_minimum
from ..plans import entity as entity_plan
from ..plans import static as static_plan
from . import check
from .frames import TITLES, sources
from .standin_sql import SOURCES


@check("""
SELECT c.c_mktsegment AS category, COUNT(o.o_orderkey) AS n
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice IS NOT NULL AND o.o_orderdate IS NOT NULL
GROUP BY c.c_mktsegment ORDER BY n DESC, category""")
def category_counts(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    # orders are counted per customer before they meet the customers
    per_customer = orders.filter(F.col("o_totalprice").isNotNull() & F.col("o_orderdate").isNotNull()).groupBy(
        F.col("o_custkey").alias("c_custkey")
    ).agg(F.count("o_orderkey").alias("n"))
    return (
        spark.read.parquet(f"{folder}/customer.parquet")
        .join(per_customer, "c_custkey")
        .groupBy(F.col("c_mktsegment").alias("category"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "category")
    )


@check(SOURCES + """
SELECT o.category_code, COUNT(o.category_code) AS n
FROM objects o JOIN funding_rounds f ON o.id = f.object_id
WHERE f.raised_amount_usd IS NOT NULL AND date_diff('day', o.founded_at, f.funded_at) IS NOT NULL
GROUP BY o.category_code""")
def null_group_count(spark, folder):
    s = sources(spark, folder)
    founded = s["objects"].filter(F.col("founded_at").isNotNull()).select("id", "category_code")
    rounds = s["funding_rounds"].filter(F.col("raised_amount_usd").isNotNull() & F.col("funded_at").isNotNull())
    per_object = rounds.groupBy(F.col("object_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # a NULL category keeps its row and counts zero
    return founded.join(per_object, "id").groupBy("category_code").agg(
        F.sum(F.when(F.col("category_code").isNotNull(), F.col("n")).otherwise(0)).alias("n")
    )


@check(SOURCES + """
SELECT funding_round_code, COUNT(funding_round_code) AS n
FROM objects o JOIN funding_rounds f ON o.id = f.object_id GROUP BY funding_round_code""")
def round_code_counts(spark, folder):
    s = sources(spark, folder)
    known = s["funding_rounds"].join(s["objects"].select(F.col("id").alias("object_id")), "object_id", "left_semi")
    return known.groupBy("funding_round_code").agg(F.count("funding_round_code").alias("n"))


@check(SOURCES + """
SELECT o.id, o.name, a.acquired_at, a.term_code, a.price_amount
FROM objects o JOIN acquisitions a ON o.id = a.acquiring_object_id""")
def inner_join_projection(spark, folder):
    s = sources(spark, folder)
    bought = s["acquisitions"].withColumnRenamed("acquiring_object_id", "id")
    return bought.join(s["objects"].select("id", "name"), "id").select(
        "id", "name", "acquired_at", "term_code", "price_amount"
    )


@check(SOURCES + """
SELECT o.id, o.name, o.status, f.funding_round_type, f.funding_round_code, f.funded_at, f.raised_amount_usd,
       CAST(date_diff('day', o.founded_at, f.funded_at) AS BIGINT) AS time_to_funding
FROM objects o JOIN funding_rounds f ON o.id = f.object_id WHERE o.founded_at IS NOT NULL""")
def rounds_with_age(spark, folder):
    s = sources(spark, folder)
    founded = s["objects"].filter(F.col("founded_at").isNotNull()).select("id", "name", "status", "founded_at")
    return s["funding_rounds"].withColumnRenamed("object_id", "id").join(founded, "id").select(
        "id", "name", "status", "funding_round_type", "funding_round_code", "funded_at", "raised_amount_usd",
        c.days_between("founded_at", "funded_at").cast("long").alias("time_to_funding"),
    )


@check(SOURCES + """
SELECT o.name, l.office_id, l.latitude, l.longitude, l.description
FROM objects o JOIN offices l ON o.id = l.object_id
WHERE lower(o.name) = 'customer#000000012' AND o.entity_type = 'company'
ORDER BY l.office_id LIMIT 50""")
def offices_of_company(spark, folder):
    s = sources(spark, folder)
    wanted = s["objects"].filter(c.equals_text("name", "customer#000000012") & (F.col("entity_type") == "company"))
    return (
        s["offices"].join(wanted.select(F.col("id").alias("object_id"), "name"), "object_id")
        .select("name", "office_id", "latitude", "longitude", "description")
        .orderBy("office_id")
        .limit(50)
    )


@check(SOURCES + """
SELECT o.name, m.milestone_at FROM objects o JOIN milestones m ON o.id = m.object_id""")
def milestone_dates(spark, folder):
    s = sources(spark, folder)
    return s["milestones"].withColumnRenamed("object_id", "id").join(
        s["objects"].select("id", "name"), "id"
    ).select("name", "milestone_at")


@check(SOURCES + """
SELECT o.id, o.name, o.last_funding_at, f.funding_round_id, f.funding_round_code, f.raised_amount_usd
FROM objects o JOIN funding_rounds f ON o.id = f.object_id AND o.last_funding_at = f.funded_at
WHERE o.founded_at IS NOT NULL""")
def last_funding_rounds(spark, folder):
    s = sources(spark, folder)
    latest = s["objects"].filter(F.col("founded_at").isNotNull()).select("id", "name", "last_funding_at")
    rounds = s["funding_rounds"].select(
        F.col("object_id").alias("id"), F.col("funded_at").alias("last_funding_at"),
        "funding_round_id", "funding_round_code", "raised_amount_usd",
    )
    return rounds.join(latest, ["id", "last_funding_at"]).select(
        "id", "name", "last_funding_at", "funding_round_id", "funding_round_code", "raised_amount_usd"
    )


@check(SOURCES + """
SELECT b.name AS acquired, MIN(a.acquired_at) AS acquired_at
FROM objects b JOIN acquisitions a ON b.id = a.acquired_object_id GROUP BY b.id, b.name""")
def first_event_per_entity(spark, folder):
    s = sources(spark, folder)
    return static_plan.first_acquisition(s["acquisitions"]).join(s["objects"].select("id", "name"), "id").select(
        F.col("name").alias("acquired"), "acquired_at"
    )


@check(SOURCES + """
SELECT COUNT(*) AS pairs, COUNT(DISTINCT person_object_id) AS people FROM (
  SELECT DISTINCT relationship_object_id, person_object_id FROM relationships
  WHERE regexp_matches(title, 'URGENT|High', 'i'))""")
def regex_role_filter(spark, folder):
    pairs = entity_plan.leadership(sources(spark, folder)["relationships"], "URGENT|High")
    return pairs.groupBy("person_object_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("people")
    )


@check(SOURCES + """,
first_start AS (SELECT person_object_id, MIN(start_at) AS start_at FROM relationships GROUP BY 1)
SELECT c.name, p.name AS employee, CAST(datesub('month', f.start_at, DATE '2026-12-12') AS BIGINT) AS exp_months
FROM (SELECT DISTINCT relationship_object_id AS id, person_object_id FROM relationships
      WHERE regexp_matches(title, 'urgent|high', 'i')) r
JOIN objects c USING (id) JOIN first_start f USING (person_object_id)
JOIN objects p ON p.id = r.person_object_id""")
def months_since_first(spark, folder):
    s = sources(spark, folder)
    names = s["objects"].select("id", "name")
    people = entity_plan.earliest_starts(s["relationships"]).join(
        names.select(F.col("id").alias("person_object_id"), F.col("name").alias("employee")), "person_object_id"
    )
    pairs = entity_plan.leadership(s["relationships"], TITLES)
    return pairs.join(people, "person_object_id").join(names, "id").select(
        "name", "employee",
        c.whole_months("earliest_start", c.slash_date(F.lit("2026/12/12"))).alias("exp_months"),
    )


@check("""
SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def two_key_count(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.groupBy("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(
        F.count(F.lit(1)).alias("n")
    )


@check("SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity IS NOT NULL")
def filter_count(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.filter((F.col("l_returnflag") == "R") & F.col("l_quantity").isNotNull()).agg(
        F.count(F.lit(1)).alias("n")
    )


@check("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def filter_rows(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    )


@check("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'")
def bound_parameter(spark, folder):
    spark.read.parquet(f"{folder}/orders.parquet").createOrReplaceTempView("bound_orders")
    return spark.sql(
        "SELECT o_orderkey, o_totalprice, o_orderdate FROM bound_orders WHERE o_orderpriority = :priority",
        args={"priority": "1-URGENT"},
    )


@check("""
SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS BIGINT) AS returned,
       CAST(l_linenumber - MIN(l_linenumber) OVER () AS BIGINT) AS shifted, ROUND(SQRT(l_quantity), 6) AS root
FROM lineitem""")
def derived_numbers(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return minus_minimum(lines, "l_linenumber", "shifted").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("long").alias("returned"),
        F.col("shifted").cast("long").alias("shifted"),
        F.round(F.sqrt("l_quantity"), 6).alias("root"),
    )
