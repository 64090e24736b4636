"""Classifier evaluation: reports, confusion, ROC curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ratio
from ..session import freeze
from .scan import ROWS_PER_GROUP, group_sum, last_known, ordered_scan, previous, running_sum


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def class_scores(df: DataFrame, label: str, prediction: str, by: list[str] = (), rows: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; a class never predicted scores zero.

    ``rows`` names a column that says for how many rows a row stands.
    """
    by = list(by)
    cells = df.groupBy(*by, label, prediction).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("_n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col(label) == F.col(prediction), F.col("_n")).otherwise(zero)
    sides = F.explode(
        F.array(
            F.struct(F.col(label).alias("cls"), F.col("_n").alias("s"), zero.alias("p"), hit.alias("h")),
            F.struct(F.col(prediction).alias("cls"), zero.alias("s"), F.col("_n").alias("p"), zero.alias("h")),
        )
    )
    sums = cells.select(*by, sides.alias("c")).groupBy(*by, F.col("c.cls").alias("cls")).agg(
        F.sum("c.s").alias("support"), F.sum("c.p").alias("predicted"), F.sum("c.h").alias("hits")
    )
    return sums.select(
        *by, "cls",
        _zero(ratio("hits", "predicted")).alias("precision"),
        _zero(ratio("hits", "support")).alias("recall"),
        _zero(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))).alias("f1"),
        "support",
    )


def macro_scores(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Unweighted means over the classes."""
    return scores.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Class scores with a macro row and a support-weighted total row."""
    scores = class_scores(df, label, prediction)
    names = ("precision", "recall", "f1")
    weighted = scores.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return (
        scores.withColumn("cls", F.col("cls").cast("string"))
        .unionByName(macro_scores(scores).withColumn("cls", F.lit("macro")))
        .unionByName(weighted.withColumn("cls", F.lit("total")))
    )


def confusion(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """Share of each true class given to each predicted class."""
    return df.groupBy(label).agg(
        *[(F.count_if(F.col(prediction) == k) / F.count(F.lit(1))).alias(f"as_{k}") for k in classes]
    )


def roc_curve(
    df: DataFrame, score: str, positive: str, by: list[str] = (), limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """False and true positive rate at every distinct score, and the origin.

    Rows with equal scores are counted before anything is ordered.
    """
    by = list(by)

    def cell(threshold: Column, pos: Column, neg: Column) -> Column:
        return F.struct(threshold.alias("s"), pos.cast("long").alias("p"), neg.cast("long").alias("n"))

    row = cell(F.col(score), F.col(positive).cast("int"), (~F.col(positive)).cast("int"))
    # a missing threshold is the origin; its rows collapse before the shuffle
    origin = cell(F.lit(None).cast(df.schema[score].dataType), F.lit(0), F.lit(0))
    # written, so that counting its groups does not read the scores again
    counted = freeze(
        df.filter(F.col(score).isNotNull())
        .select(*by, F.explode(F.array(row, origin)).alias("c"))
        .groupBy(*by, F.col("c.s").alias("threshold"))
        .agg(F.sum("c.p").alias("_pos"), F.sum("c.n").alias("_neg"))
    )
    calcs = {
        "_tp": running_sum("_pos"), "_fp": running_sum("_neg"),
        "_all_pos": group_sum("_pos"), "_all_neg": group_sum("_neg"),
    }
    run = ordered_scan(counted, by, [F.col("threshold").desc_nulls_first()], calcs, limit)
    return run.select(
        *by,
        "threshold",
        ratio("_fp", "_all_neg").alias("fpr"),
        ratio("_tp", "_all_pos").alias("tpr"),
        # area of the trapezoid that ends in this point
        (ratio("_neg", "_all_neg") * ratio(2 * F.col("_tp") - F.col("_pos"), 2 * F.col("_all_pos"))).alias("area"),
    )


def roc_auc(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(F.sum("area").alias("auc"))


def interpolate(
    curves: DataFrame, grid: DataFrame, by: list[str], limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """True positive rate of rising curves at the grid's ``fpr`` values, given per curve.

    At a knot the highest value counts; between knots the line runs from the
    highest value on the left to the lowest on the right.
    """
    knots = curves.groupBy(*by, "fpr").agg(
        F.min("tpr").alias("_low"), F.max("tpr").alias("_high"), F.lit(False).alias("_asked")
    ).withColumn("_x", F.col("fpr"))
    points = grid.select(*by, "fpr", F.lit(True).alias("_asked"))
    merged = freeze(
        knots.unionByName(points, allowMissingColumns=True)
        .groupBy(*by, "fpr")
        .agg(*[F.max(c).alias(c) for c in ("_low", "_high", "_x", "_asked")])
    )
    left = ordered_scan(merged, by, ["fpr"], {"_x0": last_known("_x"), "_y0": last_known("_high")}, limit)
    both = ordered_scan(
        left, by, [F.col("fpr").desc()], {"_x1": last_known("_x"), "_y1": last_known("_low")}, limit, merged
    )
    slope = ratio(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))
    value = F.when(F.col("_x").isNotNull(), F.col("_high")).otherwise(
        F.col("_y0") + (F.col("fpr") - F.col("_x0")) * _zero(slope)
    )
    return both.filter(F.col("_asked")).select(*by, "fpr", value.alias("tpr"))


def trapezoid(curve: DataFrame, by: list[str] = (), limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Area under points with distinct ``fpr``."""
    by = list(by)
    stepped = ordered_scan(freeze(curve), by, ["fpr"], {"_x": previous("fpr"), "_y": previous("tpr")}, limit)
    piece = (F.col("fpr") - F.col("_x")) * (F.col("tpr") + F.col("_y")) / 2
    return stepped.groupBy(*by).agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("auc"))


def _values(df: DataFrame, column: str, values) -> Column:
    return F.array(*[F.lit(v).cast(df.schema[column].dataType) for v in values])


def macro_roc(curves: DataFrame, cls: str, classes: list, limit: int | None = ROWS_PER_GROUP) -> DataFrame:
    """Mean curve of all classes over the union of their false positive rates."""
    grid = curves.select("fpr").distinct().withColumn(cls, F.explode(_values(curves, cls, classes)))
    return interpolate(curves, grid, [cls], limit).groupBy("fpr").agg(F.avg("tpr").alias("tpr"))


def even_grid(spark, points: int) -> DataFrame:
    """Evenly spaced values from 0 to 1."""
    return spark.range(points).select((F.col("id") / (points - 1)).alias("fpr"))


def fold_roc(curves: DataFrame, fold: str, folds: int, points: int = 100) -> DataFrame:
    """Mean and deviation over the folds at an even grid; the ends are fixed at 0 and 1."""
    grid = even_grid(curves.sparkSession, points).withColumn(fold, F.explode(_values(curves, fold, range(folds))))
    value = F.when(F.col("fpr") == 0, 0.0).otherwise(F.col("tpr"))
    return interpolate(curves, grid, [fold]).withColumn("tpr", value).groupBy("fpr").agg(
        F.when(F.col("fpr") == 1, 1.0).otherwise(F.avg("tpr")).alias("mean_tpr"),
        F.stddev_pop("tpr").alias("std_tpr"),
    )


def search_report(results: DataFrame, score: str, top: int) -> DataFrame:
    """Best candidates; equal scores share a rank and the next rank is skipped.

    ``results`` has one row per tried candidate.
    """
    # rank = 1 + candidates with a higher score, found over the distinct scores
    counted = results.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    run = ordered_scan(counted, [], [F.col(score).desc()], {"_upto": running_sum("_n")})
    ranks = run.select(score, (F.col("_upto") - F.col("_n") + 1).alias("rank")).filter(F.col("rank") <= top)
    return results.join(ranks, score)
