"""One model over the static features of all companies: class, probabilities, scores and similar companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import class_scores, macro_scores
from ..operators.features import fill_and_scale
from ..operators.sampling import stratified_split, upsample
from ..operators.similar import nearest
from ..operators.trees import Rule, fit_predict, with_class
from ..session import freeze
from .static import static_labels

CLOSED, EXITED, LONG, EARLY = 0, 1, 2, 3
FEATURES = [
    "milestones", "latitude", "longitude", "offices", "products", "funding_rounds", "investment_rounds",
    "invested_companies", "acq_before_exit", "investors", "investors_per_round", "funding_total_usd",
    "funding_per_round", "mean_round_gap", "experience",
]
MIN_SPLIT = 50


def bulk_matrix(static: DataFrame, two_classes: bool = False) -> DataFrame:
    """Scaled static features and the label of every company; ``two_classes`` only tells exits from the rest."""
    labelled = static_labels(static).select("id", "label", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    if two_classes:
        labelled = labelled.withColumn("label", (F.col("label") == EXITED).cast("int"))
    return fill_and_scale(freeze(labelled), FEATURES)


def bulk_model(matrix: DataFrame, share: float = 0.9, majority: int = EARLY, classes: int = 4) -> dict[str, DataFrame]:
    """Predictions for all companies and the scores on the rows held out.

    The classes are balanced to the majority, ``share`` of each is trained on.
    """
    matrix = freeze(matrix)
    known = matrix.filter(F.col("label").isNotNull())
    drawn = freeze(upsample(known, "label", "id", majority, [c for c in range(classes) if c != majority]))
    keyed = drawn.withColumn("_key", F.concat_ws("#", "id", "label", F.col("draw").cast("string")))
    split = freeze(stratified_split(keyed, "label", "_key", share))
    one = F.lit(0).alias("model")
    train = split.filter("is_train").select(one, F.col("_key").alias("key"), "label", *FEATURES)
    held = split.filter("NOT is_train").select(one, F.concat(F.lit("="), "_key").alias("key"), *FEATURES)
    everyone = matrix.select(one, F.concat(F.lit("?"), F.col("id").cast("string")).alias("key"), *FEATURES)
    shares, _ = fit_predict(train, everyone.unionByName(held), FEATURES, Rule(classes, min_split=MIN_SPLIT))
    found = freeze(with_class(shares, classes))
    asked = F.col("key").startswith("?")
    tested = found.filter(~asked).select(F.element_at(F.split("key", "#"), -2).cast("int").alias("label"), "pred")
    named = found.filter(asked).withColumn("id", F.expr("substring(key, 2)").cast(matrix.schema["id"].dataType))
    return {
        "predictions": matrix.select("id", "label").join(named, "id").select(
            "id", "label", "pred", *[f"proba{k}" for k in range(classes)]
        ),
        "scores": macro_scores(class_scores(tested, "label", "pred")),
    }


def bulk_similar(matrix: DataFrame, k: int = 6) -> DataFrame:
    """The companies most similar to every company, by the cosine of their features."""
    rows = matrix.select("id", F.array(*FEATURES).alias("vector"))
    return nearest(rows, rows, k)
