"""Exploration and result tables."""

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import features as feature_op
from ..operators.quantiles import box_statistics
from ..plans import bulk, matrix, predict, report, static, timeline as timeline_plan
from ..session import freeze
from . import check
from .frames import TITLES, entity, labelled, single_timeline, sources
from .labelling import ASOF_SQL, CATEGORIES, CUTS_SQL, FLAGS, FLAGS_SQL, _asof, _scaled
from .modelling import STEP
from .standin_sql import BASE, COMPANIES, EVENTS, OUTCOMES, SOURCES
from .statics import CODES, STATIC_SQL, TODAY


@check(BASE + "SELECT CAST(YEAR(dates) AS BIGINT) AS year, COUNT(*) AS founded FROM entity GROUP BY 1")
def founded_per_year(spark, folder):
    s = sources(spark, folder)
    return report.founded_per_year(entity(s)).withColumn("year", F.col("year").cast("long"))


@check("SELECT CAST(COUNT(*) AS VARCHAR) AS answer FROM orders WHERE MONTH(o_orderdate) = 3 AND o_orderpriority = '2-HIGH'")
def count_answer(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return report.count_answer(orders.filter((F.month("o_orderdate") == 3) & (F.col("o_orderpriority") == "2-HIGH")))


@check("SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS year, COUNT(*) AS n FROM orders GROUP BY 1")
def orders_per_year(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet").groupBy(
        F.year("o_orderdate").cast("long").alias("year")
    ).agg(F.count(F.lit(1)).alias("n"))


@check(STATIC_SQL + """,
quarters AS (
  SELECT category_code, COUNT(*) AS n, quantile_cont(age_at_exit, 0.25) AS q1, quantile_cont(age_at_exit, 0.5) AS median,
         quantile_cont(age_at_exit, 0.75) AS q3
  FROM static GROUP BY category_code
)
SELECT q.*, ROUND(MIN(age_at_exit) FILTER (WHERE inside) / 365.0::DOUBLE, 6) AS low_years,
       ROUND(MAX(age_at_exit) FILTER (WHERE inside) / 365.0::DOUBLE, 6) AS high_years,
       COUNT(*) FILTER (WHERE NOT inside) AS outliers
FROM (SELECT s.category_code, s.age_at_exit, age_at_exit BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM static s JOIN quarters USING (category_code)) JOIN quarters q USING (category_code) GROUP BY ALL""")
def box_stats(spark, folder):
    frame = static.static_features(sources(spark, folder), TITLES, TODAY, CODES)
    return box_statistics(frame, "category_code", "age_at_exit").select(
        "category_code", "n", "q1", "median", "q3",
        F.round(c.years("low_whisker"), 6).alias("low_years"), F.round(c.years("high_whisker"), 6).alias("high_years"),
        "outliers",
    )


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@check(" UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS other, ROUND(CORR({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[:i]
))
def corr_pairs(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return feature_op.correlations(lines, LINE_NUMBERS).withColumn("corr", F.round("corr", 6))


@check(SOURCES + COMPANIES + """
SELECT o.id, o.name, f.funding_round_id, f.funding_round_code, f.funded_at, f.raised_amount_usd,
       CAST(date_diff('day', o.founded_at, f.funded_at) AS BIGINT) AS time_to_funding,
       ROW_NUMBER() OVER (PARTITION BY o.id ORDER BY f.funded_at, f.funding_round_id) - 1 AS fund_idx
FROM objects o JOIN funding_rounds f ON o.id = f.object_id
WHERE f.raised_amount_usd IS NOT NULL AND date_diff('day', o.founded_at, f.funded_at) IS NOT NULL""")
def funding_trajectory(spark, folder):
    s = sources(spark, folder)
    return timeline_plan.funding_trajectory(s["objects"], s["funding_rounds"]).withColumn(
        "time_to_funding", F.col("time_to_funding").cast("long")
    )


@check(EVENTS + """
SELECT id, MAX(dates) AS dates, ROUND(MAX(famt_cumsum), 4) AS famt_cumsum, CAST(MAX(time_to_event) AS BIGINT) AS time_to_event
FROM timeline WHERE event_id = 'funded' GROUP BY id""")
def max_by_key(spark, folder):
    return report.last_funding(single_timeline(sources(spark, folder))).withColumns(
        {"famt_cumsum": F.round("famt_cumsum", 4), "time_to_event": F.col("time_to_event").cast("long")}
    )


@check(EVENTS + """
SELECT id, CAST(seq AS BIGINT) AS seq, ROUND(time_to_event / 365.0::DOUBLE, 6) AS years, ROUND(famt_cumsum, 4) AS amount
FROM timeline WHERE event_id = 'funded'
UNION ALL SELECT DISTINCT id, -1, 0.0, 0.0 FROM timeline WHERE event_id = 'funded'""")
def trajectory_points(spark, folder):
    return timeline_plan.trajectory_points(single_timeline(sources(spark, folder))).withColumns(
        {"years": F.round("years", 6), "amount": F.round("amount", 4)}
    )


@check(EVENTS + "SELECT MAX(dates) AS today FROM timeline")
def latest_date(spark, folder):
    return report.latest_date(single_timeline(sources(spark, folder)))


@check(EVENTS + """
SELECT id, event_id, CAST(seq AS BIGINT) AS seq, ROUND(famt_cumsum, 4) AS famt_cumsum, CAST(event_count AS BIGINT) AS event_count,
       CAST(time_diff AS BIGINT) AS time_diff, CAST(time_to_event AS BIGINT) AS time_to_event FROM numbered""")
def numbered_events(spark, folder):
    """Running amount, event number, gap and age before negative times are dropped."""
    s = sources(spark, folder)
    starts = timeline_plan.timeline_starts(freeze(entity(s)), s["funding_rounds"])
    events = timeline_plan.all_events(s)
    numbered = timeline_plan.number_events(timeline_plan.time_events(events, starts), sized_by=events)
    return numbered.select(
        "id", "event_id", "seq", F.round("famt_cumsum", 4).alias("famt_cumsum"), "event_count",
        F.col("time_diff").cast("long").alias("time_diff"), F.col("time_to_event").cast("long").alias("time_to_event"),
    )


# a stated rule plays the model where the rows around it are checked
PREDICTIONS_SQL = CUTS_SQL + """,
predictions AS (
  SELECT id, CASE WHEN cut < 12 THEN 0 WHEN cut < 16 THEN 1 WHEN cut < 20 THEN 2 ELSE 4 END AS pred,
         ROUND(1 - cut / 100.0::DOUBLE, 6) AS proba0
  FROM cuts
)"""


def _predictions(frame, labels):
    cut = F.col("cut")
    return matrix.cut_ages(frame, labels).select(
        "id", F.when(cut < 12, 0).when(cut < 16, 1).when(cut < 20, 2).otherwise(4).alias("pred"),
        F.round(1 - cut / 100, 6).alias("proba0"),
    )


RANKING_SQL = OUTCOMES + PREDICTIONS_SQL + """,
last_fund AS (SELECT id, MAX(dates) AS last_date, MAX(famt_cumsum) AS famt_cumsum FROM timeline WHERE event_id = 'funded' GROUP BY id),
ranking AS (
  SELECT p.id, l.name, l.category_code AS category, p.proba0, strftime(l.dates, '%m/%d/%Y') AS founded,
         strftime(f.last_date, '%m/%d/%Y') AS last_funded,
         COALESCE('$' || format('{:,.2f}', f.famt_cumsum), '-') AS famt_str
  FROM predictions p JOIN live l USING (id) JOIN last_fund f USING (id)
  WHERE p.pred = 0 AND l.dates <> f.last_date
)
"""


def _ranking(spark, folder):
    frame, companies, labels = labelled(sources(spark, folder))
    return report.exit_candidates(_predictions(frame, labels), companies, frame)


@check(RANKING_SQL + "SELECT * FROM ranking")
def exit_ranking(spark, folder):
    return _ranking(spark, folder)


@check(RANKING_SQL + "SELECT * FROM ranking ORDER BY proba0 DESC, id LIMIT 10 OFFSET 10")
def page_of_results(spark, folder):
    return report.page(_ranking(spark, folder), 1, 10)


@check(OUTCOMES + PREDICTIONS_SQL + """,
marks AS (
  SELECT id, MIN(dates) FILTER (WHERE event_id = 'public') AS public_on,
         MIN(dates) FILTER (WHERE event_id = 'acquired') AS acquired_on
  FROM timeline GROUP BY id
),
verdict AS (
  SELECT l.id, CASE WHEN o.label = 0 THEN ' ' || l.name || ' exited before the median age for its industry.'
                    WHEN o.label = 1 THEN ' ' || l.name || ' exited after the median age for its industry.' ELSE '' END AS v
  FROM live l LEFT JOIN outcome o USING (id)
)
SELECT l.id, p.id IS NOT NULL AS is_startup, l.name || CASE
  WHEN p.id IS NOT NULL THEN CASE p.pred WHEN 0 THEN ' will exit in a timely fashion!' WHEN 1 THEN ' will exit, but in a long time.'
       WHEN 2 THEN ' will continue operating without exit.'
       ELSE ': Oops! It doesn''t look like we have a prediction for that company.' END
  WHEN l.status = 'operating' THEN ' continues to operate.'
  WHEN l.status = 'ipo' THEN ' went public on ' || strftime(m.public_on, '%m/%d/%Y') || '!' || v.v
  WHEN l.status = 'acquired' THEN ' was acquired on ' || strftime(m.acquired_on, '%m/%d/%Y') || '!' || v.v
  ELSE ': Oops! It doesn''t look like we have any information on that company.' END AS message
FROM live l LEFT JOIN predictions p USING (id) LEFT JOIN marks m USING (id) LEFT JOIN verdict v USING (id)""")
def outcome_message(spark, folder):
    frame, companies, labels = labelled(sources(spark, folder))
    return report.outcome_messages(companies, frame, labels, _predictions(frame, labels))


@check(STATIC_SQL + """
SELECT id, permalink, 'The company ' || name || CASE WHEN status IN ('acquired', 'ipo')
  THEN ' will likely exit successfully!' ELSE ' will probably not exit successfully!' END AS message FROM static""")
def success_message(spark, folder):
    frame = freeze(static.static_features(sources(spark, folder), TITLES, TODAY, CODES))
    flagged = static.static_labels(frame).select("id", (F.col("label") == 1).alias("success"))
    return report.success_messages(frame, flagged)


def _cosine_sql() -> str:
    names = [*matrix.NUMERIC, *FLAGS]
    dot = " + ".join(f"a.{n} * b.{n}" for n in names)
    left = " + ".join(f"a.{n} * a.{n}" for n in names)
    right = " + ".join(f"b.{n} * b.{n}" for n in names)
    return f"ABS(({dot}) / NULLIF(SQRT(({left}) * ({right})), 0))"


@check(ASOF_SQL + f""",
scaled AS (SELECT cut, id, is_query, {_scaled('cut').replace(', 5) + 0.0', ', 30)')}, {FLAGS_SQL} FROM filled_asof),
pairs AS (
  SELECT a.cut, a.id AS query_id, b.id AS item_id, {_cosine_sql()} AS score
  FROM scaled a JOIN scaled b USING (cut) WHERE a.is_query AND NOT b.is_query
)
SELECT CAST(cut AS BIGINT) AS cut, query_id, rank, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY cut, query_id ORDER BY score DESC, item_id) AS rank FROM pairs) WHERE rank <= 6""")
def comparable_companies(spark, folder):
    return report.comparable_companies(_asof(sources(spark, folder)), CATEGORIES).select(
        F.col("cut").cast("long").alias("cut"), "query_id", F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"),
    )


@check("SELECT 'c:' || c_custkey AS id, c_name AS name FROM customer WHERE upper(c_name) LIKE 'CUSTOMER#0000000%'")
def prefix_search(spark, folder):
    s = sources(spark, folder)
    return report.name_suggestions(s["objects"].filter(F.col("entity_type") == "company"), "customer#0000000")


@check("SELECT c_name AS name, MIN('c:' || c_custkey) AS id FROM customer WHERE c_name = 'Customer#000000012' GROUP BY c_name")
def exact_name_lookup(spark, folder):
    s = sources(spark, folder)
    return report.company_ids(s["objects"].filter(F.col("entity_type") == "company"), "Customer#000000012")


@check("""
SELECT CAST((n - 1) // 1000 AS BIGINT) AS list_no, '["' || string_agg(name, '","' ORDER BY name) || '"]' AS names
FROM (SELECT c_name AS name, ROW_NUMBER() OVER (ORDER BY c_name, 'c:' || c_custkey) AS n FROM customer) GROUP BY 1""")
def names_json(spark, folder):
    s = sources(spark, folder)
    return report.names_json(s["objects"].filter(F.col("entity_type") == "company"))


@check("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority,
       '$' || format('{:,.2f}', o_totalprice) AS price, strftime(o_orderdate, '%m/%d/%Y') AS ordered,
       printf('%.2f%%', 100 * (o_totalprice / 1000000)) AS share
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def display_columns(spark, folder):
    names = {"1-URGENT": "urgent", "5-LOW": "low"}
    return spark.read.parquet(f"{folder}/orders.parquet").filter(F.col("o_orderstatus").isin("F", "O")).select(
        "o_orderkey", c.display_names("o_orderpriority", names).alias("priority"),
        c.money_text("o_totalprice").alias("price"), c.date_text("o_orderdate").alias("ordered"),
        c.percent_text(F.col("o_totalprice") / 1000000).alias("share"),
    )


@check(OUTCOMES + CUTS_SQL + "SELECT MIN(id) AS id, CAST(cut AS BIGINT) AS cut FROM cuts WHERE cut = (SELECT MAX(cut) FROM cuts) GROUP BY cut")
def oldest_cut(spark, folder):
    frame, _, labels = labelled(sources(spark, folder))
    return report.oldest_cut(matrix.cut_ages(frame, labels)).withColumn("cut", F.col("cut").cast("long"))


def _model_predictions(spark, folder):
    """Frames of the labelled companies and, for the unlabelled ones, the output of the models of `rf_predictions`."""
    frame, companies, labels = labelled(sources(spark, folder))
    asof = matrix.asof_matrix(frame, companies, labels, matrix.cut_ages(frame, labels, STEP), CATEGORIES)
    return frame, companies, labels, predict.predict_unlabelled(asof, labels, CATEGORIES)["predictions"]


@check()
def exit_ranking_model(spark, folder):
    """Exit candidates by the predictions of the models by age cut."""
    frame, companies, _, predictions = _model_predictions(spark, folder)
    return report.exit_candidates(predictions, companies, frame)


@check()
def outcome_message_model(spark, folder):
    frame, companies, labels, predictions = _model_predictions(spark, folder)
    return report.outcome_messages(companies, frame, labels, predictions)


@check()
def success_message_model(spark, folder):
    """Messages from the two-class model over all companies."""
    frame = freeze(static.static_features(sources(spark, folder), TITLES, TODAY, CODES))
    found = bulk.bulk_model(bulk.bulk_matrix(frame, two_classes=True), majority=0, classes=2)["predictions"]
    return report.success_messages(frame, found.select("id", (F.col("pred") == 1).alias("success")))
