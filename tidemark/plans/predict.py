"""Predictions for unlabelled companies, one model per age cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import class_scores, macro_scores
from ..operators.sampling import stratified_split, upsample, upsample_within
from ..operators.trees import Rule, fit_predict, with_class
from ..session import freeze
from .labels import LATE, SLOW, TIMELY
from .matrix import NUMERIC, category_columns

CLASSES = [TIMELY, LATE, SLOW]


def balanced_split(labelled: DataFrame, share: float, majority: int = SLOW) -> DataFrame:
    """Balances the classes and marks the training rows, exactly ``share`` of each class."""
    minorities = [c for c in CLASSES if c != majority]
    drawn = freeze(upsample(labelled, "label", "id", majority, minorities))
    return stratified_split(
        drawn.withColumn("_key", F.concat_ws("#", "id", "label", F.col("draw").cast("string"))), "label", "_key", share
    ).drop("_key")


def predict_unlabelled(asof: DataFrame, labels: DataFrame, categories: list[str], share: float = 0.6) -> dict[str, DataFrame]:
    """Predictions, scores and importances over all cuts of an as-of matrix.

    Every cut has a forest of its own, on ``share`` of its balanced labelled companies; its scores come from the others.
    All cuts are balanced, split and grown in the same jobs, so a finer step of the cuts adds rows but no jobs.
    """
    features = [*NUMERIC, *category_columns(categories)]
    known = asof.filter("NOT is_query").join(labels, "id").select("cut", "id", "label", *features)
    drawn = upsample_within(freeze(known), ["cut"], "label", "id", SLOW, [TIMELY, LATE])
    drawn = drawn.withColumn("_key", F.concat_ws("#", "id", "label", F.col("draw").cast("string")))
    sample = freeze(stratified_split(drawn, ["cut", "label"], "_key", share))
    model = F.col("cut").alias("model")
    unknown = asof.filter("is_query").select(model, F.concat(F.lit("?"), F.col("id").cast("string")).alias("key"), *features)
    held = sample.filter("NOT is_train").select(model, F.concat(F.lit("="), "_key").alias("key"), *features)
    train = sample.filter("is_train").select(model, F.col("_key").alias("key"), "label", *features)
    shares, weights = fit_predict(train, unknown.unionByName(held), features, Rule(len(CLASSES)))
    found = freeze(with_class(shares, len(CLASSES)))
    asked, name = F.col("key").startswith("?"), F.expr("substring(key, 2)")
    cut = F.col("model").cast(asof.schema["cut"].dataType).alias("cut")
    tested = found.filter(~asked).select(cut, F.element_at(F.split("key", "#"), -2).cast("int").alias("label"), "pred")
    return {
        "predictions": found.filter(asked).select(
            name.cast(asof.schema["id"].dataType).alias("id"), cut, "pred", *[f"proba{k}" for k in CLASSES]
        ),
        "scores": macro_scores(class_scores(tested, "label", "pred", ["cut"]), ["cut"]),
        "importances": weights.select(F.col("model").cast("string").alias("model_key"), "feature", "importance"),
    }


def predict_population(known: DataFrame, everyone: DataFrame, features: list[str], share: float = 0.6) -> DataFrame:
    """One forest on ``share`` of the balanced ``known`` rows; class and probabilities of ``everyone`` (id, features)."""
    sample = freeze(balanced_split(known.select("id", "label", *features), share))
    key = F.concat_ws("#", "id", "label", F.col("draw").cast("string"))
    train = sample.filter("is_train").select(F.lit(0).alias("model"), key.alias("key"), "label", *features)
    asked = everyone.select(F.lit(0).alias("model"), F.col("id").cast("string").alias("key"), *features)
    shares, _ = fit_predict(train, asked, features, Rule(len(CLASSES)))
    found = with_class(shares, len(CLASSES)).withColumn("id", F.col("key").cast(everyone.schema["id"].dataType))
    return found.select("id", "pred", *[f"proba{k}" for k in CLASSES])
