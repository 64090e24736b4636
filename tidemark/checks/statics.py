"""Static features, their parts and the age label."""

from pyspark.sql import functions as F

from ..plans import entity as entity_plan
from ..plans import static as plan
from . import check
from .frames import TITLES, sources
from .standin_sql import BASE, EXPERIENCE, SOURCES, COMPANIES

TODAY = "2024-01-31"
CODES = ["a", "b", "seed"]

STATIC_SQL = BASE + """,
sale AS (SELECT acquired_object_id AS id, MIN(acquired_at) AS acquired_at FROM acquisitions GROUP BY 1),
listing AS (SELECT object_id AS id, MIN(public_at) AS public_at FROM ipos GROUP BY 1),
marks AS (
  SELECT id, COUNT(*) FILTER (WHERE milestone_at < acquired_at) AS milestones
  FROM (SELECT DISTINCT object_id AS id, milestone_at FROM milestones) JOIN sale USING (id) GROUP BY id
),
bought AS (
  SELECT id, SUM(CAST(b.bought_at < s.acquired_at AS INTEGER)) AS acq_before_acq
  FROM (SELECT DISTINCT acquiring_object_id AS id, acquired_at AS bought_at FROM acquisitions) b JOIN sale s USING (id)
  GROUP BY id
),
bought_ipo AS (
  SELECT l.id, SUM(CAST(a.acquired_at < l.public_at AS INTEGER)) AS acq_before_ipo
  FROM acquisitions a JOIN listing l ON l.id = a.acquiring_object_id GROUP BY l.id
),
backers AS (
  SELECT f.object_id AS id, COUNT(i.investor_object_id) AS investors
  FROM objects o JOIN funding_rounds f ON o.id = f.object_id JOIN investments i USING (funding_round_id)
       JOIN objects b ON b.id = i.investor_object_id
  WHERE b.entity_type = 'FinancialOrg' GROUP BY f.object_id
),
timed_rounds AS (
  SELECT o.id, f.funded_at, f.funding_round_id, date_diff('day', o.founded_at, f.funded_at) AS t
  FROM objects o JOIN funding_rounds f ON o.id = f.object_id
  WHERE f.raised_amount_usd IS NOT NULL AND date_diff('day', o.founded_at, f.funded_at) IS NOT NULL
),
gaps AS (
  SELECT id, COALESCE(t - LAG(t) OVER (PARTITION BY id ORDER BY funded_at, funding_round_id), t) AS gap
  FROM timed_rounds
),
mean_gap AS (SELECT id, AVG(gap) AS mean_round_gap FROM gaps WHERE gap >= 0 GROUP BY id),
last_code AS (
  SELECT id, code AS last_funding_round_code FROM (
    SELECT o.id, f.funding_round_code AS code,
           ROW_NUMBER() OVER (PARTITION BY o.id ORDER BY f.funding_round_id DESC) AS rn
    FROM objects o JOIN funding_rounds f ON o.id = f.object_id AND o.last_funding_at = f.funded_at
    WHERE o.founded_at IS NOT NULL) WHERE rn = 1
),
joined AS (
  SELECT c.*, o.closed_at, o.funding_rounds, o.investment_rounds, o.invested_companies, o.funding_total_usd,
         sale.acquired_at, listing.public_at, marks.milestones, place.latitude, place.longitude, place.offices,
         children.products, bought.acq_before_acq, bought_ipo.acq_before_ipo, backers.investors,
         mean_gap.mean_round_gap, last_code.last_funding_round_code, experience.experience,
         date_diff('day', c.founded_at, sale.acquired_at) AS age_at_acq,
         date_diff('day', c.founded_at, listing.public_at) AS age_at_ipo,
         date_diff('day', c.founded_at, o.closed_at) AS age_at_close,
         LEAST(bought.acq_before_acq, bought_ipo.acq_before_ipo) AS acq_before_exit,
         backers.investors / NULLIF(CAST(o.funding_rounds AS DOUBLE), 0) AS investors_per_round,
         o.funding_total_usd / NULLIF(o.funding_rounds, 0) AS funding_per_round
  FROM companies c JOIN objects o USING (id)
       LEFT JOIN sale USING (id) LEFT JOIN listing USING (id) LEFT JOIN marks USING (id) LEFT JOIN place USING (id)
       LEFT JOIN children USING (id) LEFT JOIN bought USING (id) LEFT JOIN bought_ipo USING (id)
       LEFT JOIN backers USING (id) LEFT JOIN mean_gap USING (id) LEFT JOIN last_code USING (id)
       LEFT JOIN experience USING (id)
),
static AS (
  SELECT * REPLACE (COALESCE(category_code, 'other') AS category_code),
         COALESCE(LEAST(age_at_acq, age_at_ipo, age_at_close),
                  date_diff('day', founded_at, DATE '2024-01-31')) AS age_at_exit
  FROM joined
  WHERE COALESCE(CAST(acquired_at AS VARCHAR), CAST(public_at AS VARCHAR), CAST(closed_at AS VARCHAR),
                 CAST(milestones AS VARCHAR), CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR),
                 CAST(offices AS VARCHAR), CAST(products AS VARCHAR), CAST(funding_rounds AS VARCHAR),
                 CAST(investment_rounds AS VARCHAR), CAST(invested_companies AS VARCHAR),
                 CAST(investors AS VARCHAR), CAST(acq_before_acq AS VARCHAR), CAST(acq_before_ipo AS VARCHAR),
                 CAST(funding_total_usd AS VARCHAR), CAST(experience AS VARCHAR)) IS NOT NULL
),
age_threshold AS (
  SELECT category_code, AVG(age_at_exit) + 2 * STDDEV_SAMP(age_at_exit) AS threshold FROM static GROUP BY 1
)
"""

INTS = ["milestones", "offices", "products", "funding_rounds", "investment_rounds", "invested_companies",
        "acq_before_acq", "acq_before_ipo", "acq_before_exit", "investors", "experience",
        "age_at_acq", "age_at_ipo", "age_at_close", "age_at_exit"]
REALS = ["latitude", "longitude", "investors_per_round", "funding_per_round", "funding_total_usd", "mean_round_gap"]
PLAIN = ["id", "name", "permalink", "category_code", "status", "founded_at", "acquired_at", "public_at",
         "closed_at", "last_funding_round_code"]


def _static(spark, folder):
    return plan.static_features(sources(spark, folder), TITLES, TODAY, CODES)


@check(STATIC_SQL + "SELECT " + ", ".join(
    PLAIN + [f"CAST({c} AS BIGINT) AS {c}" for c in INTS] + [f"ROUND({c}, 6) AS {c}" for c in REALS]
    + [f"CAST(COALESCE(last_funding_round_code = '{k}', FALSE) AS BIGINT) AS code_{k}" for k in CODES]
) + " FROM static")
def static_features(spark, folder):
    return _static(spark, folder).select(
        *PLAIN, *[F.col(c).cast("long").alias(c) for c in INTS], *[F.round(c, 6).alias(c) for c in REALS],
        *[F.col(f"code_{k}").cast("long").alias(f"code_{k}") for k in CODES],
    )


@check(STATIC_SQL + """
SELECT s.id, s.status, ROUND(t.threshold, 6) AS threshold, CAST(s.age_at_exit AS BIGINT) AS age_at_exit,
       CAST(CASE WHEN status = 'closed' THEN 0 WHEN status IN ('acquired', 'ipo') THEN 1
            WHEN status = 'operating' AND age_at_exit >= threshold THEN 2
            WHEN status = 'operating' AND age_at_exit < threshold THEN 3 END AS BIGINT) AS label
FROM static s LEFT JOIN age_threshold t USING (category_code)""")
def static_label(spark, folder):
    return plan.static_labels(_static(spark, folder)).select(
        "id", "status", F.round("threshold", 6).alias("threshold"),
        F.col("age_at_exit").cast("long").alias("age_at_exit"), F.col("label").cast("long").alias("label"),
    )


@check(SOURCES + """
SELECT parent_id AS id, COUNT(id) AS products FROM objects WHERE parent_id IS NOT NULL GROUP BY parent_id""")
def children_count(spark, folder):
    return entity_plan.children(sources(spark, folder)["objects"])


@check(STATIC_SQL + "SELECT id, investors FROM backers")
def investor_count(spark, folder):
    s = sources(spark, folder)
    return plan.investor_counts(s["objects"], s["funding_rounds"], s["investments"])


@check(STATIC_SQL + "SELECT id, milestones FROM marks")
def events_before_exit(spark, folder):
    s = sources(spark, folder)
    return plan.milestones_before_sale(s["milestones"], s["acquisitions"])


@check(STATIC_SQL + """
SELECT id, CAST(b.acq_before_acq AS BIGINT) AS acq_before_acq, CAST(i.acq_before_ipo AS BIGINT) AS acq_before_ipo,
       CAST(LEAST(b.acq_before_acq, i.acq_before_ipo) AS BIGINT) AS acq_before_exit
FROM bought b FULL JOIN bought_ipo i USING (id)""")
def acq_before_exit(spark, folder):
    s = sources(spark, folder)
    sold = plan.acquisitions_before_sale(s["acquisitions"])
    listed = plan.acquisitions_before_listing(s["acquisitions"], s["ipos"])
    return sold.join(listed, "id", "full").withColumn(
        "acq_before_exit", plan.smallest("acq_before_acq", "acq_before_ipo")
    )


@check(STATIC_SQL + """
SELECT id, ROUND(investors_per_round, 6) AS investors_per_round, ROUND(funding_per_round, 4) AS funding_per_round
FROM static""")
def ratio_per_round(spark, folder):
    return _static(spark, folder).select(
        "id", F.round("investors_per_round", 6).alias("investors_per_round"),
        F.round("funding_per_round", 4).alias("funding_per_round"),
    )


@check(SOURCES + COMPANIES + EXPERIENCE + "SELECT id, CAST(experience AS BIGINT) AS experience FROM experience")
def experience_days(spark, folder):
    s = sources(spark, folder)
    companies = entity_plan.founded_companies(s["objects"])
    return entity_plan.experience(companies, s["relationships"], TITLES).select(
        "id", F.col("experience").cast("long").alias("experience")
    )


@check(STATIC_SQL + "SELECT id, ROUND(mean_round_gap, 6) AS mean_round_gap FROM mean_gap")
def mean_round_gap(spark, folder):
    s = sources(spark, folder)
    return plan.mean_round_gap(s["objects"], s["funding_rounds"]).withColumn(
        "mean_round_gap", F.round("mean_round_gap", 6)
    )


@check(STATIC_SQL + "SELECT id, last_funding_round_code FROM last_code")
def last_round_code(spark, folder):
    s = sources(spark, folder)
    return plan.last_round_code(s["objects"], s["funding_rounds"])


@check(SOURCES + """
SELECT office_id, latitude, longitude FROM offices WHERE latitude IS NOT NULL OR longitude IS NOT NULL""")
def drop_all_null(spark, folder):
    offices = sources(spark, folder)["offices"].select("office_id", "latitude", "longitude")
    return offices.na.drop(how="all", subset=["latitude", "longitude"])


@check(SOURCES + """
SELECT office_id, latitude, longitude FROM offices WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def drop_any_null(spark, folder):
    return sources(spark, folder)["offices"].select("office_id", "latitude", "longitude").na.drop()


@check(BASE + "SELECT id, ROUND(latitude, 6) AS latitude, ROUND(longitude, 6) AS longitude, offices FROM place")
def dedupe_first(spark, folder):
    return entity_plan.first_place(sources(spark, folder)["offices"]).withColumns(
        {"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)}
    )


@check(SOURCES + "SELECT DISTINCT status, entity_type FROM objects")
def distinct_rows(spark, folder):
    return sources(spark, folder)["objects"].select("status", "entity_type").dropDuplicates()
