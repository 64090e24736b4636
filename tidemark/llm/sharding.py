"""Sharding by vector bin packing: bytes, tokens and rows of every shard are balanced together.

Equal texts form a group that stays in one shard, unless it has more than half of a shard's bytes, tokens or rows:
then it is cut into pieces by document id. Groups lighter than a cell share cells by hash, heavier ones are placed by
themselves. Cells and pieces are summed in one aggregation and are of bounded number, so the greedy packing runs on the
driver: heaviest first, each into the shard where the dot product of its load with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import freeze, parts_for, text_bytes, unsigned_crc, word_count

#: Cells per shard; with heavy pieces at most four times as many loads reach the driver.
CELLS = 512
#: Rows that one task numbers when slots are dealt.
ROWS_PER_BIN = 200_000


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every load vector; rows of `loads` are (bytes, tokens, rows).

    Each load goes where its dot product with the residual capacity is highest, the smallest shard number at ties.
    """
    total = loads.sum(axis=0)
    scaled = loads / np.where(total > 0, total, 1)
    order = np.lexsort((np.arange(len(loads)), -scaled.max(axis=1)))
    residual = np.full((shards, loads.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(loads), dtype=np.int32)
    for i in order:
        best = int(np.argmax(residual @ scaled[i]))
        chosen[i] = best
        residual[best] -= scaled[i]
    return chosen


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the size, words, checksum and the group of its text; NULL texts form one group."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (text_bytes(text) + 8).alias("size"),
        word_count(text).alias("tokens"),
        unsigned_crc(text).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("grp"),
    )


def placed(slim: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """Adds the shard to measured documents.

    A group is heavy when one of its loads is above the mean cell; there are at most three times as many heavy groups as
    cells. One with more than half of a shard is cut into pieces of about a sixteenth by the hash of doc_id.
    """
    spark = slim.sparkSession
    n = shards * cells
    total = slim.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    limit = [max(1.0, (x or 0) / n) for x in total]
    loads = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    share = F.greatest(*[F.col(c) / x for c, x in zip(("size", "tokens", "rows"), limit, strict=True)])
    groups = slim.groupBy("grp").agg(*loads).withColumn("share", share)
    large = (F.col("share") > cells / 2) & (F.col("rows") > 1)
    pieces = F.when(large, F.ceil(F.col("share") * 16 / cells)).otherwise(1).cast("long")
    heavy = freeze(groups.where(F.col("share") > 1).select("grp", pieces.alias("pieces")))
    keyed = slim.join(heavy, "grp", "left").withColumn(
        "cell",
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("grp"), F.lit(n)))
        .otherwise(F.xxhash64("grp", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("pieces")))),
    ).withColumn("cut", F.col("pieces").isNotNull())
    sums = sorted(keyed.groupBy("cut", "cell").agg(*loads).collect(), key=lambda r: (r.cut, r.cell))
    shard = pack(np.array([tuple(r)[2:] for r in sums], dtype=float).reshape(-1, 3), shards)
    where = spark.createDataFrame(
        [(r.cut, r.cell, int(s)) for r, s in zip(sums, shard, strict=True)], "cut boolean, cell long, shard int"
    )
    return keyed.join(F.broadcast(where), ["cut", "cell"]).drop("cut", "cell", "pieces")


def shard_documents(docs: DataFrame, shards: int = 24, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    The law is `bytes`; grown_shard is therefore NULL. Slots count from 0 in every shard: its rows are spread over bins
    by hash, counted per bin, and numbered inside a bin after the rows of the bins before.
    NULL texts weigh 8 bytes and no words; rows that are equal in id and text get different slots; no rows give no rows.
    """
    slim = freeze(measured(docs))
    rows = freeze(placed(slim, shards).select("doc_id", "size", "text_crc32", "grp", "shard"))
    bins = parts_for(rows.count(), rows_per_bin * shards, 4)
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("doc_id", "grp", F.lit(3)), F.lit(bins)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(counts, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("skip") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
