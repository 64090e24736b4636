"""Frames and small helpers that the corpus operators share."""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze, frozen_path
from ..session import tune as tune_skew

__all__ = ["freeze", "frozen_path", "tune", "table", "word_count", "text_bytes", "fresh", "parts_for", "unsigned_crc"]

# Tasks get the functions themselves, so that the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


#: Rows of a batch that goes to Python; texts are long, and a worker holds a few batches at a time.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """The library's settings and small batches, unless the session states them itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(key, str(BATCH_ROWS))
    return tune_skew(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Runs of other than blank, tab, line and page breaks; 0 for NULL."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unsigned_crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever its other columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many parts of about `each` a total makes; grows with the data."""
    return max(least, math.ceil((total or 0) / each))
