"""Session set-up and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins on a hot entity id are split at run time; without the second setting
# Spark keeps the skewed partition whole whenever an aggregate reuses it.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in ADAPTIVE.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Switches the skew settings on in a session made elsewhere, unless it states them itself."""
    stated = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in ADAPTIVE.items():
        if key not in stated:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as named by the session; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL_FOLDERS.get(context.applicationId)
        if folder is None:
            folder = _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return folder


def frozen_path(spark: SparkSession) -> str:
    """New path below the folder of this application, which may be removed when the application has ended."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    Later steps then see the same rows again even after an executor is lost,
    nothing upstream is computed twice, and the reader prunes columns and knows
    the size of the table when it chooses a join.
    """
    spark = df.sparkSession
    path = frozen_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
