"""Outcome labels, feature matrix and as-of features."""

from pyspark.sql import functions as F

from ..operators import features as op
from ..plans import labels as label_plan
from ..plans import matrix as plan
from ..session import freeze
from . import check
from .frames import labelled, live, sources
from .standin_sql import OUTCOMES

# the four category values that remain after one was nulled
CATEGORIES = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]


@check(OUTCOMES + "SELECT id, CAST(label AS BIGINT) AS label FROM outcome")
def outcome_label(spark, folder):
    frame, companies = live(sources(spark, folder))
    return label_plan.outcome_labels(frame, companies).withColumn("label", F.col("label").cast("long"))


@check(OUTCOMES + "SELECT category_code, ROUND(threshold, 6) AS threshold FROM threshold")
def category_threshold(spark, folder):
    frame, companies = live(sources(spark, folder))
    return label_plan.exit_thresholds(frame, companies).withColumn("threshold", F.round("threshold", 6))


@check(OUTCOMES + "SELECT CAST(label AS BIGINT) AS label, COUNT(*) AS n FROM outcome GROUP BY label")
def label_counts(spark, folder):
    frame, companies = live(sources(spark, folder))
    return label_plan.outcome_labels(frame, companies).groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _features_sql(source: str) -> str:
    kinds = ",\n".join(
        f"AVG(CASE WHEN event_id = '{k}' THEN time_diff END) AS mean_{k}_time, "
        f"MAX(CASE WHEN event_id = '{k}' THEN event_count END) AS {k}_events"
        for k in plan.KINDS
    )
    return f"""SELECT id, AVG(CASE WHEN event_id = 'funded' THEN famt END) AS mean_famt,
       MAX(CASE WHEN event_id = 'funded' THEN famt_cumsum END) AS famt_cumsum, {kinds}
FROM {source} GROUP BY id"""


def _filled(source: str, by: str = "") -> str:
    over = f"(PARTITION BY {by})" if by else "()"
    return ", ".join(
        f"COALESCE({c}, MEDIAN({c}) OVER {over}, 0) AS {c}" for c in plan.NUMERIC
    )


def _scaled(by: str = "") -> str:
    over = f"(PARTITION BY {by})" if by else "()"
    return ", ".join(
        f"ROUND(CASE WHEN STDDEV_POP({c}) OVER {over} > 1e-12 THEN ({c} - AVG({c}) OVER {over}) / STDDEV_POP({c}) OVER {over} "
        f"ELSE 0 END, 5) + 0.0 AS {c}"
        for c in plan.NUMERIC
    )


FLAGS = plan.category_columns(CATEGORIES)
FLAGS_SQL = ", ".join(
    f"CAST(COALESCE(category_code = '{c}', FALSE) AS BIGINT) AS {flag}" for c, flag in zip(CATEGORIES, FLAGS)
)
MATRIX_SQL = OUTCOMES + f""",
kinds AS ({_features_sql('live_tl')}),
raw_matrix AS (SELECT l.*, k.* EXCLUDE (id) FROM live l LEFT JOIN kinds k USING (id)),
filled AS (SELECT id, category_code, {_filled('raw_matrix')} FROM raw_matrix)
"""


def _shown(df, *keys):
    return df.select(
        *keys, *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in plan.NUMERIC],
        *[F.col(c).cast("long").alias(c) for c in FLAGS],
    )


@check(MATRIX_SQL + f"SELECT id, {_scaled()}, {FLAGS_SQL} FROM filled")
def feature_matrix(spark, folder):
    return _shown(plan.feature_matrix(*live(sources(spark, folder)), CATEGORIES), "id")


@check(OUTCOMES + f"SELECT id, {FLAGS_SQL} FROM live")
def one_hot(spark, folder):
    s = sources(spark, folder)
    _, companies = live(s)
    values = op.category_values(s["objects"], "category_code")
    names = plan.category_columns(values)
    return op.one_hot(companies, "category_code", values, "category_").select(
        "id", *[F.col(c).cast("long").alias(c) for c in names]
    )


@check(MATRIX_SQL + "SELECT id, " + ", ".join(f"ROUND({c}, 8) AS {c}" for c in plan.NUMERIC) + " FROM filled")
def impute_median(spark, folder):
    raw = freeze(plan.raw_matrix(*live(sources(spark, folder)), []))
    return op.impute(raw, plan.NUMERIC).select("id", *[F.round(c, 8).alias(c) for c in plan.NUMERIC])


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check("SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 5) + 0.0 AS {c}" for c in LINE_NUMBERS
) + " FROM lineitem")
def standardise(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", *LINE_NUMBERS)
    return op.standardise(lines, LINE_NUMBERS).withColumns(
        {c: F.round(c, 5) + F.lit(0.0) for c in LINE_NUMBERS}
    )


@check(OUTCOMES + """
SELECT id, CAST(label AS BIGINT) AS label, CAST(label = 0 AS BIGINT) AS is_0, CAST(label = 1 AS BIGINT) AS is_1,
       CAST(label = 2 AS BIGINT) AS is_2 FROM outcome WHERE label <> 3""")
def label_indicators(spark, folder):
    frame, companies = live(sources(spark, folder))
    known = op.known_label_indicators(label_plan.outcome_labels(frame, companies), "label", [0, 1, 2], unknown=3)
    return known.select("id", *[F.col(c).cast("long").alias(c) for c in ("label", "is_0", "is_1", "is_2")])


@check("""
SELECT l_returnflag, ROUND(MEDIAN(l_quantity), 6) AS l_quantity, ROUND(MEDIAN(l_extendedprice), 6) AS l_extendedprice,
       ROUND(MEDIAN(l_tax), 6) AS l_tax
FROM lineitem GROUP BY l_returnflag""")
def grouped_median(spark, folder):
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    found = op.exact_quantiles(spark.read.parquet(f"{folder}/lineitem.parquet"), names, ["l_returnflag"])
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in names])


def _cuts_sql(step: int) -> str:
    return f""",
cuts AS (
  SELECT o.id, CAST(CEIL(MAX(t.time_to_event) / {step}.0) * {step} AS BIGINT) AS cut, MAX(t.time_to_event) AS age
  FROM outcome o JOIN live_tl t USING (id) WHERE o.label = 3 GROUP BY o.id
)"""


CUTS_SQL = _cuts_sql(1)


def _asof_sql(step: int) -> str:
    return OUTCOMES + _cuts_sql(step) + f""",
members AS (
  SELECT d.cut, l.*, FALSE AS is_query, d.cut AS until
  FROM live l JOIN outcome o USING (id), (SELECT DISTINCT cut FROM cuts) d WHERE o.label <> 3
  UNION ALL
  SELECT c.cut, l.*, TRUE, c.age FROM live l JOIN cuts c USING (id)
),
seen AS (
  SELECT m.cut, t.* FROM members m JOIN live_tl t USING (id) WHERE t.time_to_event < m.until
),
asof_kinds AS ({_features_sql('seen').replace('SELECT id,', 'SELECT cut, id,').replace('GROUP BY id', 'GROUP BY cut, id')}),
raw_asof AS (SELECT m.*, k.* EXCLUDE (cut, id) FROM members m LEFT JOIN asof_kinds k USING (cut, id)),
filled_asof AS (SELECT cut, id, is_query, category_code, {_filled('raw_asof', 'cut')} FROM raw_asof)
"""


ASOF_SQL = _asof_sql(1)


def _asof(s, step=1):
    frame, companies, labels = labelled(s)
    cuts = plan.cut_ages(frame, labels, step)
    return plan.asof_matrix(frame, companies, labels, cuts, CATEGORIES)


@check(ASOF_SQL + f"SELECT CAST(cut AS BIGINT) AS cut, id, is_query, {_scaled('cut')}, {FLAGS_SQL} FROM filled_asof")
def asof_features(spark, folder):
    return _shown(_asof(sources(spark, folder)), F.col("cut").cast("long").alias("cut"), "id", "is_query")


@check(_asof_sql(15) + f"SELECT CAST(cut AS BIGINT) AS cut, id, is_query, {_scaled('cut')}, {FLAGS_SQL} FROM filled_asof")
def asof_features_bucketed(spark, folder):
    """Cuts rounded up to 15 days; an unlabelled company is still seen as of its own age."""
    return _shown(_asof(sources(spark, folder), 15), F.col("cut").cast("long").alias("cut"), "id", "is_query")


@check(OUTCOMES + CUTS_SQL + """
SELECT CAST(d.cut AS BIGINT) AS cut, COUNT(t.id) AS events, ROUND(COALESCE(SUM(t.famt), 0), 4) AS amount
FROM (SELECT DISTINCT cut FROM cuts) d LEFT JOIN live_tl t ON t.time_to_event < d.cut
GROUP BY d.cut""")
def asof_event_count(spark, folder):
    frame, _, labels = labelled(sources(spark, folder))
    cuts = plan.cut_ages(frame, labels)
    return plan.asof_totals(frame, cuts).select(
        F.col("cut").cast("long").alias("cut"), "events", F.round("amount", 4).alias("amount")
    )


@check(OUTCOMES + """
SELECT CASE WHEN label = 3 THEN 'unlabelled' ELSE 'labelled' END AS part, COUNT(*) AS n
FROM outcome GROUP BY 1""")
def label_split(spark, folder):
    frame, companies = live(sources(spark, folder))
    labels = label_plan.outcome_labels(frame, companies)
    return labels.groupBy(
        F.when(F.col("label") == label_plan.YOUNG, "unlabelled").otherwise("labelled").alias("part")
    ).agg(F.count(F.lit(1)).alias("n"))
