"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

# rows per insert when writing to a database
BATCH_ROWS = 5000


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, the only missing marker the operators know."""
    real = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns])


def query(spark: SparkSession, text: str, dates: list[str] = (), **parameters) -> DataFrame:
    """Result of a SQL text over registered views; parameters are bound, dates become ``DateType``."""
    frame = spark.sql(text, args=parameters) if parameters else spark.sql(text)
    return frame.withColumns({c: F.to_date(c) for c in dates}) if dates else frame


def register(frames: dict[str, DataFrame]) -> None:
    """Makes frames visible to SQL under their names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header; a key column stays a column."""
    return without_nan(spark.read.schema(schema).option("header", True).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def inline_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_table(df: DataFrame, name: str, folder: str | None = None) -> None:
    """Replaces a table: a parquet directory in ``folder``, or a table of the catalog."""
    if folder is None:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_frames(frames: dict[str, DataFrame], folder: str) -> None:
    """Feature tables that belong together, one directory each."""
    for name, frame in frames.items():
        write_table(frame, name, folder)


def read_frames(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def read_database(
    spark: SparkSession, url: str, table: str, split_by: str, low: int, high: int, parts: int, **options
) -> DataFrame:
    """Database table read by ``parts`` tasks over ranges of a numeric column."""
    return without_nan(
        spark.read.jdbc(
            url, table, column=split_by, lowerBound=low, upperBound=high, numPartitions=parts, properties=options
        )
    )


def write_database(df: DataFrame, url: str, table: str, **options) -> None:
    df.write.jdbc(url, table, mode="overwrite", properties={"batchsize": str(BATCH_ROWS), **options})


def table_listing(spark: SparkSession) -> DataFrame:
    """Tables and views with their columns and types."""
    rows = [
        (table.name, column.name, column.dataType)
        for table in spark.catalog.listTables()
        for column in spark.catalog.listColumns(table.name)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def table_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Columns of all frames with their types, and how many rows and known values they hold; one aggregate a frame."""
    parts = []
    for name, df in frames.items():
        counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_known_{c}") for c in df.columns])
        cells = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"),
                F.col("_rows").alias("n_rows"), F.col(f"_known_{c}").alias("n_known"),
            )
            for c, kind in df.dtypes
        ]
        parts.append(counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def first_rows(df: DataFrame, count: int = 1) -> DataFrame:
    return df.limit(count)
