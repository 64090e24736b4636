"""Sampling, forests and searches."""

from pyspark.sql import functions as F

from ..operators import evaluate, features, models, sampling
from ..plans import labels as label_plan
from ..plans import bulk, matrix, predict, report
from ..plans.labels import without_closed
from ..plans.static import static_features
from ..plans.timeline import on_timeline
from ..session import freeze
from . import check
from .evaluation import DRAW_SQL, HASH_SQL
from .frames import labelled, sources, timeline
from .labelling import CATEGORIES, CUTS_SQL, FLAGS
from .standin_sql import OUTCOMES
from .statics import CODES, STATIC_SQL, TITLES, TODAY

FEATURES = [*matrix.NUMERIC, *FLAGS]
# order status plays the class; F is the class that sets the size
NUMBERED_SQL = f"""
WITH classed AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE 1 END AS label FROM orders
),
numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {HASH_SQL.format(key='o_orderkey')}, o_orderkey) AS number,
         COUNT(*) OVER (PARTITION BY label) AS size
  FROM classed
)
"""


def _classed(spark, folder):
    status = F.col("o_orderstatus")
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", F.when(status == "F", 2).when(status == "O", 0).otherwise(1).alias("label")
    )


@check(NUMBERED_SQL + f""",
draws AS (
  SELECT n.number AS draw, m.label, {DRAW_SQL.format(key="m.label || ':' || n.number")} % m.size + 1 AS number
  FROM numbered n, (SELECT DISTINCT label, size FROM numbered WHERE label <> 2) m WHERE n.label = 2
)
SELECT CAST(label AS BIGINT) AS label, number AS draw, o_orderkey FROM numbered WHERE label = 2
UNION ALL
SELECT CAST(d.label AS BIGINT), d.draw, n.o_orderkey FROM draws d JOIN numbered n USING (label, number)""")
def upsample_balanced(spark, folder):
    return sampling.upsample(_classed(spark, folder), "label", "o_orderkey", 2, [0, 1]).select(
        F.col("label").cast("long").alias("label"), "draw", "o_orderkey"
    )


@check(NUMBERED_SQL + """
SELECT o_orderkey, CAST(label AS BIGINT) AS label, number <= ROUND(0.6::DOUBLE * size) AS is_train FROM numbered""")
def stratified_split(spark, folder):
    return sampling.stratified_split(_classed(spark, folder), "label", "o_orderkey", 0.6).select(
        "o_orderkey", F.col("label").cast("long").alias("label"), "is_train"
    )


@check(f"""
SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY {HASH_SQL.format(key='o_orderkey')}, o_orderkey) <=
       (SELECT ROUND(COUNT(*) * 0.6::DOUBLE) FROM orders) AS is_train FROM orders""")
def plain_split(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    return sampling.stratified_split(orders, None, "o_orderkey", 0.6)


@check(f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (
  SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)
  ORDER BY {HASH_SQL.format(key='l_orderkey')}, l_orderkey LIMIT 100)""")
def sampled_entities(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return sampling.sample_entities(lines, "l_orderkey", 100)


@check(f"""
WITH folded AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         (ROW_NUMBER() OVER (PARTITION BY label ORDER BY {HASH_SQL.format(key='vec_id')}, vec_id) - 1) % 3 AS fold
  FROM embeddings
),
near AS (
  SELECT * FROM (
    SELECT a.fold, a.vec_id, a.label AS truth, b.label, list_distance(a.v, b.v) AS d,
           ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
    FROM folded a JOIN folded b ON a.fold <> b.fold) WHERE rank <= 49
),
votes AS (
  SELECT fold, k.size, vec_id, truth, label, COUNT(*) AS uniform, COUNT(*) FILTER (WHERE d = 0) AS exact,
         COALESCE(SUM(1 / NULLIF(d, 0)), 0) AS near
  FROM near n, (SELECT UNNEST(range(1, 50)) AS size) k WHERE n.rank <= k.size GROUP BY ALL
),
chosen AS (
  SELECT fold, size, truth, 'uniform' AS weights, label AS pred FROM votes
  QUALIFY ROW_NUMBER() OVER (PARTITION BY size, vec_id ORDER BY uniform DESC, label) = 1
  UNION ALL
  SELECT fold, size, truth, 'distance', label FROM votes
  QUALIFY ROW_NUMBER() OVER (PARTITION BY size, vec_id ORDER BY exact DESC, near DESC, label) = 1
),
classes AS (SELECT fold, size, weights, truth AS cls FROM chosen UNION SELECT fold, size, weights, pred FROM chosen),
f AS (
  SELECT c.fold, c.size, c.weights, c.cls,
         2.0::DOUBLE * COUNT(*) FILTER (WHERE truth = cls AND pred = cls)
         / (COUNT(*) FILTER (WHERE truth = cls) + COUNT(*) FILTER (WHERE pred = cls)) AS f1
  FROM classes c JOIN chosen h USING (fold, size, weights) GROUP BY ALL
),
macro AS (SELECT fold, size, weights, AVG(f1) AS f1 FROM f GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, weights, ROUND(AVG(f1), 6) AS score, ROUND(STDDEV_POP(f1), 6) AS deviation
FROM macro GROUP BY size, weights""")
def knn_search(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return models.knn_search(vectors, list(range(1, 50)), "vec_id", "embedding").select(
        F.col("size").cast("long").alias("size"), "weights",
        F.round("score", 6).alias("score"), F.round("deviation", 6).alias("deviation"),
    )


def _training(spark, folder):
    """Feature matrix of the labelled companies and of the unlabelled ones."""
    frame, companies, labels = labelled(sources(spark, folder))
    rows = freeze(matrix.feature_matrix(frame, companies, CATEGORIES).join(labels, "id"))
    return rows.filter(F.col("label") != label_plan.YOUNG), rows.filter(F.col("label") == label_plan.YOUNG)


NOISE = 200


def _even_sql(i: int, start: int) -> str:
    digest = f"md5(vec_id || ':{models.SEED}:{i}')"
    return f"(CAST('0x' || substr({digest}, {start}, 12) AS BIGINT)::DOUBLE + 1) / (2.0::DOUBLE ** 48 + 1)"


@check("SELECT vec_id, label, " + ", ".join(
    f"ROUND(SQRT(-2 * LN({_even_sql(i, 1)})) * COS(2 * PI() * {_even_sql(i, 13)}), 6) + 0.0 AS noise_{i}" for i in range(NOISE)
) + " FROM embeddings")
def noise_features(spark, folder):
    """Vectors with two hundred noise columns beside them."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label")
    return features.noise_columns(vectors, NOISE, models.SEED, "vec_id").select(
        "vec_id", "label", *[(F.round(f"noise_{i}", 6) + F.lit(0.0)).alias(f"noise_{i}") for i in range(NOISE)]
    )


STEP = 1


def _by_cut(spark, folder):
    s = sources(spark, folder)
    frame, companies, labels = labelled(s)
    cuts = matrix.cut_ages(frame, labels, STEP)
    rows = matrix.asof_matrix(frame, companies, labels, cuts, CATEGORIES)
    return predict.predict_unlabelled(rows, labels, CATEGORIES)


@check()
def rf_predictions(spark, folder):
    """Class and probabilities of every unlabelled company, from the model of its age cut."""
    return _by_cut(spark, folder)["predictions"]


@check()
def rf_scores_by_age(spark, folder):
    return _by_cut(spark, folder)["scores"].orderBy("cut")


@check()
def rf_importance(spark, folder):
    """Highest feature importances per age cut."""
    return report.named_importances(_by_cut(spark, folder)["importances"])


@check()
def rf_population(spark, folder):
    """One forest on the balanced labelled companies, applied to all companies, closed ones too."""
    s = sources(spark, folder)
    frame, companies = timeline(s)
    rows = freeze(matrix.feature_matrix(frame, companies, CATEGORIES))
    alive, living = without_closed(on_timeline(companies, frame), frame)
    labels = freeze(label_plan.outcome_labels(living, alive))
    known = rows.join(labels, "id").filter(F.col("label") != label_plan.YOUNG)
    return predict.predict_population(known, rows, FEATURES).join(labels, "id", "left")


@check()
def random_search(spark, folder):
    """Macro F1 of random forest settings, best first."""
    known, _ = _training(spark, folder)
    found = models.random_search(known, FEATURES, "id", models.random_candidates(50, len(FEATURES)))
    return evaluate.search_report(found, "score", 3)


def _bulk_matrix(spark, folder, two_classes=False):
    static = static_features(sources(spark, folder), TITLES, TODAY, CODES)
    return freeze(bulk.bulk_matrix(static, two_classes))


@check()
def bulk_predictions(spark, folder):
    """Class and probabilities of every company from the four-class model of its static features."""
    return bulk.bulk_model(_bulk_matrix(spark, folder))["predictions"]


@check()
def bulk_scores(spark, folder):
    """Macro scores of the four-class model on the tenth held out."""
    return bulk.bulk_model(_bulk_matrix(spark, folder))["scores"]


def _sound(predictions, classes):
    """Rows of a prediction table, those whose probabilities do not add up, and those whose class is not the likeliest."""
    chances = F.array(*[F.col(f"proba{k}") for k in range(classes)])
    total = F.aggregate(chances, F.lit(0.0), lambda a, b: a + b)
    return predictions.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) > 1e-9).alias("bad_sums"),
        F.count_if(F.get(chances, F.col("pred")) < F.array_max(chances) - 1e-9).alias("bad_classes"),
    )


@check(STATIC_SQL + "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS bad_sums, CAST(0 AS BIGINT) AS bad_classes FROM static")
def bulk_prediction_check(spark, folder):
    return _sound(bulk_predictions(spark, folder), 4)


@check(OUTCOMES + CUTS_SQL + "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS bad_sums, CAST(0 AS BIGINT) AS bad_classes FROM cuts")
def rf_prediction_check(spark, folder):
    return _sound(rf_predictions(spark, folder), 3)


_FILLED = ", ".join(f"COALESCE({c}::DOUBLE, MEDIAN({c}::DOUBLE) OVER (), 0) AS {c}" for c in bulk.FEATURES)
_BULK_SCALED = ", ".join(
    f"CASE WHEN STDDEV_POP({c}) OVER () > 1e-12 THEN ({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () ELSE 0 END"
    for c in bulk.FEATURES
)


@check(STATIC_SQL + f""",
filled AS (SELECT id, {_FILLED} FROM static),
vectors AS (SELECT id, [{_BULK_SCALED}] AS v FROM filled),
pairs AS (
  SELECT a.id AS query_id, b.id AS item_id,
         ABS(list_dot_product(a.v, b.v) / NULLIF(SQRT(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 0)) AS score
  FROM vectors a JOIN vectors b ON a.id <> b.id
)
SELECT query_id, rank, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs) WHERE rank <= 6""")
def bulk_similar(spark, folder):
    """The six most similar companies of every company, by rank and score."""
    return bulk.bulk_similar(_bulk_matrix(spark, folder)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )
