"""Session settings and reliable storage for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "fixtrace", **conf) -> SparkSession:
    """A session with adaptive execution and UTC. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Joins whose partitions turn out small are hashed rather than sorted.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and stages that the driver and all executors share.

    The one that ``spark.checkpoint.dir`` names. Where that is unset, a folder beside the tables of the
    warehouse, which all machines of a cluster share as well.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, for the intermediate tables of one run."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and go on from there."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that they never change again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table over all cores if it comes in fewer pieces, as a small file does.

    Meant before heavy work per row. A table in many pieces stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
