"""Similarity, neighbour votes and classifier evaluation over the embeddings."""

from pyspark.sql import functions as F

from ..operators import evaluate as op
from ..operators.sampling import folds
from ..operators.similar import nearest, neighbour_vote
from ..session import freeze
from . import check

CLASSES = list(range(10))
# the product of a vector with the mean vector of a class plays its score for the class
FLAT_SQL = """
WITH flat AS (
  SELECT vec_id, label, UNNEST(range(0, len(embedding))) AS pos, UNNEST(embedding::DOUBLE[]) AS v FROM embeddings
),
"""
SCORES_SQL = FLAT_SQL + """
means AS (SELECT label AS cls, pos, AVG(v) AS c FROM flat GROUP BY 1, 2),
centres AS (SELECT cls, list(c ORDER BY pos) AS centre FROM means GROUP BY cls),
scored AS (
  SELECT e.vec_id, e.label, CAST(k.cls AS BIGINT) AS cls, ROUND(list_dot_product(e.embedding::DOUBLE[], k.centre), 3) AS score,
         e.label = k.cls AS positive
  FROM embeddings e, centres k
),
predicted AS (
  SELECT vec_id, label, arg_max(cls, score * 100000 - cls) AS prediction FROM scored GROUP BY vec_id, label
)
"""


def _embeddings(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def _with_centres(frame, group):
    """Adds ``centres``, the mean vector of every group as one small array of (cls, centre)."""
    means = frame.select(F.col(group).alias("cls"), F.posexplode("embedding").alias("pos", "v")).groupBy("cls", "pos").agg(
        F.avg(F.col("v").cast("double")).alias("c")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"])
    each = means.groupBy("cls").agg(ordered.alias("centre"))
    # one row: as many vectors as there are classes
    row = freeze(each.agg(F.array_sort(F.collect_list(F.struct("cls", "centre"))).alias("centres")))
    return frame.join(F.broadcast(row))


def _dot(centre):
    products = F.zip_with("embedding", centre, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _scored(spark, folder):
    """One row per vector and class."""
    frame = _with_centres(_embeddings(spark, folder), "label")
    return frame.withColumn("_k", F.explode("centres")).select(
        "vec_id", "label", F.col("_k.cls").cast("long").alias("cls"), F.round(_dot(F.col("_k.centre")), 3).alias("score"),
        (F.col("label") == F.col("_k.cls")).alias("positive"),
    )


def _predicted(spark, folder):
    frame = _with_centres(_embeddings(spark, folder), "label")
    scores = F.transform("centres", lambda k: F.struct(-F.round(_dot(k["centre"]), 3), k["cls"].alias("cls")))
    return frame.select("vec_id", "label", F.array_min(scores)["cls"].cast("int").alias("prediction"))


@check("""
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id,
         ABS(list_dot_product(a.v, b.v) / SQRT(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a
  JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id
)
SELECT query_id, item_id, ROUND(score, 9) AS score, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs) WHERE rank <= 6""")
def cosine_topk(spark, folder):
    vectors = _embeddings(spark, folder)
    return nearest(vectors, vectors, 6, "vec_id", "embedding").withColumns(
        {"rank": F.col("rank").cast("long"), "score": F.round("score", 9)}
    )


@check("""
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label, list_distance(a.v, b.v) AS d
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a
  JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id
),
near AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rn FROM pairs) WHERE rn <= 5
),
votes AS (
  SELECT query_id, label, COUNT(*) FILTER (WHERE d = 0) AS exact,
         COALESCE(SUM(1 / NULLIF(d, 0)), 0) AS vote
  FROM near GROUP BY query_id, label
)
SELECT query_id, prediction FROM (
  SELECT query_id, CAST(label AS BIGINT) AS prediction,
         ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY exact DESC, vote DESC, label) AS rn FROM votes) WHERE rn = 1""")
def knn_vote(spark, folder):
    vectors = _embeddings(spark, folder)
    near = nearest(vectors, vectors, 5, "vec_id", "embedding", metric="euclid")
    return neighbour_vote(near, vectors, "vec_id").withColumn("prediction", F.col("prediction").cast("long"))


# unscaled amounts of orders and their dearest line, with exact copies of every 50th order
RAW_SQL = """
WITH lines AS (
  SELECT o.o_orderkey AS id, [o.o_totalprice::DOUBLE, MAX(l.l_extendedprice)::DOUBLE, o.o_custkey::DOUBLE] AS v,
         CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey, o.o_totalprice, o.o_custkey, o.o_orderstatus
),
items AS (SELECT * FROM lines UNION ALL SELECT id + 1000000000, v, label FROM lines WHERE id % 50 = 0),
pairs AS (
  SELECT a.id AS query_id, b.id AS item_id, b.label, list_distance(a.v, b.v) AS d
  FROM (SELECT * FROM lines WHERE id % 50 = 0) a JOIN items b ON a.id <> b.id
),
near AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rn FROM pairs) WHERE rn <= 5
),
votes AS (
  SELECT query_id, label, COUNT(*) FILTER (WHERE d = 0) AS exact, COALESCE(SUM(1 / NULLIF(d, 0)), 0) AS vote
  FROM near GROUP BY query_id, label
)
SELECT query_id, prediction FROM (
  SELECT query_id, CAST(label AS BIGINT) AS prediction,
         ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY exact DESC, vote DESC, label) AS rn FROM votes) WHERE rn = 1"""


@check(RAW_SQL)
def knn_vote_raw(spark, folder):
    """Vote over unscaled amounts: the queries are the orders whose key is divisible by 50, against all orders."""
    dearest = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_extendedprice").alias("dearest")
    )
    status = F.col("o_orderstatus")
    lines = spark.read.parquet(f"{folder}/orders.parquet").join(dearest, "o_orderkey").select(
        F.col("o_orderkey").alias("id"),
        F.array(*[F.col(c).cast("double") for c in ("o_totalprice", "dearest", "o_custkey")]).alias("vector"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label"),
    )
    asked = lines.filter(F.col("id") % 50 == 0)
    items = lines.unionByName(asked.withColumn("id", F.col("id") + 1_000_000_000))
    near = nearest(asked, items, 5, metric="euclid")
    return neighbour_vote(near, items).withColumn("prediction", F.col("prediction").cast("long"))


REPORT_SQL = SCORES_SQL + """,
cells AS (SELECT label, prediction, COUNT(*) AS n FROM predicted GROUP BY 1, 2),
classes AS (SELECT label AS cls FROM cells UNION SELECT prediction FROM cells),
sums AS (
  SELECT cls, COALESCE((SELECT SUM(n) FROM cells WHERE label = cls), 0) AS support,
         COALESCE((SELECT SUM(n) FROM cells WHERE prediction = cls), 0) AS predicted,
         COALESCE((SELECT SUM(n) FROM cells WHERE label = cls AND prediction = cls), 0) AS hits
  FROM classes
),
scores AS (
  SELECT cls, CAST(support AS BIGINT) AS support, COALESCE(hits / NULLIF(CAST(predicted AS DOUBLE), 0), 0) AS precision,
         COALESCE(hits / NULLIF(CAST(support AS DOUBLE), 0), 0) AS recall,
         COALESCE(2 * hits / NULLIF(CAST(predicted + support AS DOUBLE), 0), 0) AS f1
  FROM sums
)
"""


@check(REPORT_SQL + """
SELECT CAST(cls AS VARCHAR) AS cls, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(f1, 6) AS f1, support FROM scores
UNION ALL SELECT 'macro', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM scores
UNION ALL SELECT 'total', ROUND(SUM(precision * support) / SUM(support), 6), ROUND(SUM(recall * support) / SUM(support), 6),
       ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM scores""")
def class_report(spark, folder):
    return op.class_report(_predicted(spark, folder), "label", "prediction").withColumns(
        {c: F.round(c, 6) for c in ("precision", "recall", "f1")}
    )


@check(SCORES_SQL + "SELECT CAST(label AS BIGINT) AS label, " + ", ".join(
    f"ROUND(COUNT(*) FILTER (WHERE prediction = {k}) / CAST(COUNT(*) AS DOUBLE), 6) AS as_{k}" for k in CLASSES
) + " FROM predicted GROUP BY label")
def confusion_normalised(spark, folder):
    return op.confusion(_predicted(spark, folder), "label", "prediction", CLASSES).select(
        F.col("label").cast("long").alias("label"), *[F.round(f"as_{k}", 6).alias(f"as_{k}") for k in CLASSES]
    )


ROC_SQL = SCORES_SQL + """,
counted AS (
  SELECT cls, score, COUNT(*) FILTER (WHERE positive) AS p, COUNT(*) FILTER (WHERE NOT positive) AS n
  FROM scored GROUP BY cls, score
),
run AS (
  SELECT cls, score, p, n, SUM(p) OVER w AS tp, SUM(n) OVER w AS fp,
         SUM(p) OVER (PARTITION BY cls) AS all_p, SUM(n) OVER (PARTITION BY cls) AS all_n
  FROM counted WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
),
curve AS (
  SELECT cls, score AS threshold, CAST(fp AS DOUBLE) / all_n AS fpr, CAST(tp AS DOUBLE) / all_p AS tpr FROM run
  UNION ALL SELECT DISTINCT cls, NULL, 0.0, 0.0 FROM run
)
"""


def _curves(spark, folder):
    return op.roc_curve(_scored(spark, folder), "score", "positive", ["cls"])


@check(ROC_SQL + """
SELECT CAST(cls AS BIGINT) AS cls, threshold, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr FROM curve""")
def roc_points(spark, folder):
    return _curves(spark, folder).select(
        F.col("cls").cast("long").alias("cls"), "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


@check(ROC_SQL + """,
steps AS (
  SELECT cls, fpr, tpr, LAG(fpr) OVER w AS x, LAG(tpr) OVER w AS y
  FROM curve WINDOW w AS (PARTITION BY cls ORDER BY threshold DESC NULLS FIRST)
)
SELECT CAST(cls AS BIGINT) AS cls, ROUND(SUM((fpr - x) * (tpr + y) / 2), 6) AS auc FROM steps GROUP BY cls""")
def roc_auc(spark, folder):
    return op.roc_auc(_curves(spark, folder), ["cls"]).select(
        F.col("cls").cast("long").alias("cls"), F.round("auc", 6).alias("auc")
    )


LERP_SQL = """
knots AS (SELECT {by}, fpr, MIN(tpr) AS low, MAX(tpr) AS high FROM curve GROUP BY {by}, fpr),
marks AS (
  SELECT g.{by}, g.fpr,
         (SELECT MAX(k.fpr) FROM knots k WHERE k.{by} = g.{by} AND k.fpr <= g.fpr) AS x0,
         (SELECT MIN(k.fpr) FROM knots k WHERE k.{by} = g.{by} AND k.fpr >= g.fpr) AS x1
  FROM grid g
),
lerp AS (
  SELECT m.{by}, m.fpr,
         CASE WHEN m.x0 = m.fpr THEN a.high
              ELSE a.high + (m.fpr - m.x0) * (b.low - a.high) / (m.x1 - m.x0) END AS tpr
  FROM marks m JOIN knots a ON a.{by} = m.{by} AND a.fpr = m.x0 JOIN knots b ON b.{by} = m.{by} AND b.fpr = m.x1
)
"""


MACRO_SQL = ROC_SQL + """,
grid AS (SELECT k.cls, f.fpr FROM (SELECT DISTINCT fpr FROM curve) f, (SELECT DISTINCT cls FROM curve) k),
""" + LERP_SQL.format(by="cls") + """,
macro AS (SELECT fpr, AVG(tpr) AS tpr FROM lerp GROUP BY fpr)
"""


@check(MACRO_SQL + "SELECT ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr FROM macro")
def macro_roc(spark, folder):
    return op.macro_roc(_curves(spark, folder), "cls", CLASSES).select(
        F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


@check(MACRO_SQL + """
SELECT ROUND(SUM((fpr - x) * (tpr + y) / 2), 6) AS auc
FROM (SELECT fpr, tpr, LAG(fpr) OVER (ORDER BY fpr) AS x, LAG(tpr) OVER (ORDER BY fpr) AS y FROM macro)""")
def macro_auc(spark, folder):
    return op.trapezoid(op.macro_roc(_curves(spark, folder), "cls", CLASSES)).select(F.round("auc", 6).alias("auc"))


HASH_SQL = "CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
DRAW_SQL = HASH_SQL.replace("1, 8", "1, 15")
FOLD_SQL = FLAT_SQL + f"""
sides AS (SELECT label < 5 AS positive, pos, AVG(v) AS c FROM flat GROUP BY 1, 2),
direction AS (
  SELECT list(a.c - b.c ORDER BY a.pos) AS d FROM sides a JOIN sides b USING (pos) WHERE a.positive AND NOT b.positive
),
target AS (
  SELECT vec_id, label < 5 AS positive, ROUND(list_dot_product(embedding::DOUBLE[], d), 3) AS score,
         CAST((ROW_NUMBER() OVER (PARTITION BY label < 5 ORDER BY {HASH_SQL.format(key='vec_id')}, vec_id) - 1) % 6 AS INTEGER) AS fold
  FROM embeddings, direction
),
scored AS (SELECT fold AS cls, score, positive FROM target)"""


@check(FOLD_SQL + ROC_SQL[len(SCORES_SQL):] + """,
grid AS (SELECT cls, i / 99.0::DOUBLE AS fpr FROM (SELECT UNNEST(range(0, 100)) AS i), (SELECT DISTINCT cls FROM curve)),
""" + LERP_SQL.format(by="cls") + """
SELECT ROUND(fpr, 6) AS fpr,
       ROUND(CASE WHEN fpr = 1 THEN 1 ELSE AVG(CASE WHEN fpr = 0 THEN 0 ELSE tpr END) END, 6) AS mean_tpr,
       ROUND(STDDEV_POP(CASE WHEN fpr = 0 THEN 0 ELSE tpr END), 6) AS std_tpr
FROM lerp GROUP BY fpr""")
def kfold_roc(spark, folder):
    frame = _with_centres(_embeddings(spark, folder).withColumn("side", F.col("label") < 5), "side")
    # false sorts before true
    towards = F.zip_with(F.col("centres")[1]["centre"], F.col("centres")[0]["centre"], lambda a, b: a - b)
    target = frame.select("vec_id", F.col("side").alias("positive"), F.round(_dot(towards), 3).alias("score"))
    curves = op.roc_curve(folds(target, "positive", "vec_id", 6), "score", "positive", ["fold"])
    return op.fold_roc(curves, "fold", 6).select(
        *[F.round(c, 6).alias(c) for c in ("fpr", "mean_tpr", "std_tpr")]
    )


@check("""
SELECT * FROM (
  SELECT CAST(vec_id AS BIGINT) AS candidate, ROUND(list_sum(embedding::DOUBLE[]), 2) AS score,
         RANK() OVER (ORDER BY ROUND(list_sum(embedding::DOUBLE[]), 2) DESC) AS rank
  FROM embeddings) WHERE rank <= 10""")
def search_rank(spark, folder):
    results = _embeddings(spark, folder).select(
        F.col("vec_id").alias("candidate"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double")), 2).alias("score"),
    )
    return op.search_report(results, "score", 10).select("candidate", "score", "rank")


# the return flag of a line plays the class, its quantity the rule that predicts it, its years to shipment the age
AGED_SQL = """
WITH aged AS (
  SELECT abs(YEAR(l.l_shipdate) - YEAR(o.o_orderdate)) AS age,
         CASE l.l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         CASE WHEN l.l_quantity < 17 THEN 0 WHEN l.l_quantity < 34 THEN 1 ELSE 2 END AS prediction
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
),
"""


@check(AGED_SQL + """
cells AS (SELECT age, label, prediction, COUNT(*) AS n FROM aged GROUP BY 1, 2, 3),
classes AS (SELECT age, label AS cls FROM cells UNION SELECT age, prediction FROM cells),
sums AS (
  SELECT c.age, c.cls, COALESCE(SUM(n) FILTER (WHERE label = cls), 0) AS support,
         COALESCE(SUM(n) FILTER (WHERE prediction = cls), 0) AS predicted,
         COALESCE(SUM(n) FILTER (WHERE label = cls AND prediction = cls), 0) AS hits
  FROM classes c JOIN cells e ON e.age = c.age GROUP BY c.age, c.cls
)
SELECT CAST(age AS BIGINT) AS age, ROUND(AVG(COALESCE(hits / NULLIF(CAST(predicted AS DOUBLE), 0), 0)), 6) AS precision,
       ROUND(AVG(COALESCE(hits / NULLIF(CAST(support AS DOUBLE), 0), 0)), 6) AS recall,
       ROUND(AVG(COALESCE(2 * hits / NULLIF(CAST(predicted + support AS DOUBLE), 0), 0)), 6) AS f1,
       CAST(SUM(support) AS BIGINT) AS support
FROM sums GROUP BY age""")
def score_by_age(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    aged = spark.read.parquet(f"{folder}/lineitem.parquet").join(orders, "l_orderkey").select(
        F.abs(F.year("l_shipdate") - F.year("o_orderdate")).cast("long").alias("age"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        F.when(quantity < 17, 0).when(quantity < 34, 1).otherwise(2).alias("prediction"),
    )
    scores = op.class_scores(aged, "label", "prediction", ["age"])
    return op.macro_scores(scores, ["age"]).select(
        "age", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    ).orderBy("age")
