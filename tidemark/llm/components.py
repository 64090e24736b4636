"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import freeze


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b); equal roots mean connected.

    In every round each node points to its smallest neighbour or itself, pointers are followed twice, and the links
    are rewritten to the pointed-to nodes; links inside a point vanish. The number of rounds grows with the logarithm
    of the longest path. A node's neighbours are reduced by a combined minimum, never gathered.
    """
    links = freeze(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        point = freeze(least.select("node", F.least("node", "m").alias("root")))
        for _ in range(2):
            onward = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            point = point.join(onward, "root").select("node", F.col("next").alias("root"))
        point = freeze(point)
        if labels is None:
            labels = point
        else:
            moved = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = freeze(labels)
        left = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = freeze(
            links.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
