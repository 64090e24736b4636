"""Kernel classifier and the report of the chosen models."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluate, kernel
from ..plans.holdout import holdout_report as report_of
from . import check
from .modelling import FEATURES, _training
from .standin_sql import OUTCOMES

# the first numbers of the vectors, few cosines and made weights, so that SQL can follow
INPUTS, COSINES, WIDTH, LABELS = 4, 8, 0.3, 4
DRAWS = kernel.draw_cosines(INPUTS, COSINES)
WEIGHTS = np.array([[np.sin(10 * k + j) for j in range(COSINES + 1)] for k in range(LABELS)])
NAMES = [f"x{i}" for i in range(INPUTS)]


def _numbers(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in map(float, values)) + "]"


_COSINE = f"SQRT(2.0 / {COSINES}) * COS(SQRT({2 * WIDTH}::DOUBLE) * list_dot_product(v, {{w}}) + {{b}}::DOUBLE)"
MAPPED_SQL = f"""
WITH vectors AS (SELECT vec_id, label, list_transform(range(1, {INPUTS + 1}), lambda i: embedding[i]::DOUBLE) AS v FROM embeddings),
mapped AS (SELECT vec_id, label, """ + ", ".join(
    _COSINE.format(w=_numbers(w), b=repr(float(b))) + f" AS z{j}" for j, (w, b) in enumerate(zip(DRAWS.directions, DRAWS.phases))
) + " FROM vectors)"


def _vectors(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(NAMES)])


@check(MAPPED_SQL + " SELECT vec_id, " + ", ".join(f"ROUND(z{j}, 6) + 0.0 AS z{j}" for j in range(COSINES)) + " FROM mapped")
def kernel_features(spark, folder):
    """Random Fourier features of all vectors."""
    mapped = kernel.feature_map(_vectors(spark, folder), NAMES, ["vec_id"], DRAWS, WIDTH)
    return mapped.select("vec_id", *[(F.round(F.col("cosines")[j], 6) + F.lit(0.0)).alias(f"z{j}") for j in range(COSINES)])


_SCORE = [" + ".join(f"z{j} * {float(w[j])!r}::DOUBLE" for j in range(COSINES)) + f" + {float(w[-1])!r}::DOUBLE" for w in WEIGHTS]
_LACKS = " UNION ALL ".join(
    f"SELECT {k} AS cls, GREATEST(0.0, 1 - CASE WHEN label = {k} THEN 1 ELSE -1 END * ({score})) AS lack, "
    f"CASE WHEN label = {k} THEN 1 ELSE -1 END AS sign, z0 FROM mapped"
    for k, score in enumerate(_SCORE)
)


@check(MAPPED_SQL + f""", lacks AS ({_LACKS})
SELECT CAST(cls AS BIGINT) AS cls, ROUND(SUM(lack * lack), 6) AS loss, ROUND(-2 * SUM(lack * sign * z0), 6) AS slope_first,
       ROUND(-2 * SUM(lack * sign), 6) AS slope_bias FROM lacks GROUP BY cls""")
def kernel_loss(spark, folder):
    """Summed squared hinge per class at given weights, with the first and the last part of its gradient."""
    machines = kernel.Machines([{"c": 1.0, "gamma": WIDTH}], list(range(LABELS)), 1, DRAWS, WEIGHTS[None, None])
    rows = _vectors(spark, folder).withColumn("fold", F.lit(0))
    found = kernel.losses(rows, NAMES, "label", machines, np.zeros_like(machines.weights), (0.0,))[0, 0, 0]
    told = [(k, round(float(v[0]), 6), round(float(v[1]), 6), round(float(v[-1]), 6)) for k, v in enumerate(found)]
    return spark.createDataFrame(told, "cls long, loss double, slope_first double, slope_bias double")


@check()
def kernel_search(spark, folder):
    """Macro F1 of fifty random settings of the kernel classifier, best first."""
    known, _ = _training(spark, folder)
    found = kernel.search(known, FEATURES, "id", kernel.random_settings(50))
    return evaluate.search_report(found, "score", 3)


@check()
def holdout_report(spark, folder):
    """Neighbour vote, forest and kernel machines with their chosen settings on the tenth held out."""
    known, _ = _training(spark, folder)
    return report_of(known, FEATURES)


@check(OUTCOMES + """,
held AS (SELECT COUNT(*) - CAST(ROUND(COUNT(*) * 0.9::DOUBLE) AS BIGINT) AS n FROM outcome WHERE label = 2),
classes AS (SELECT DISTINCT label FROM outcome WHERE label <> 3)
SELECT m.model, CAST(c.label AS VARCHAR) AS cls, held.n AS support, TRUE AS sound
FROM classes c, held, (SELECT UNNEST(['neighbours', 'forest', 'kernel']) AS model) m""")
def holdout_support(spark, folder):
    """Support of every class in the report of the chosen models, and whether F1 follows from precision and recall."""
    rows = holdout_report(spark, folder).filter("cls NOT IN ('macro', 'total')")
    mean = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    sound = (F.abs(mean - F.col("f1")) < 1e-9) & F.col("f1").between(0, 1)
    return rows.select("model", "cls", "support", sound.alias("sound"))
