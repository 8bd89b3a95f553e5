"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Python batches hold whole texts, so keep them small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "textgraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a folder of its
    own then.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="textgraph-"))
    return context.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the stage tables of one run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, partitions: int | None, *by: str) -> DataFrame:
    """Rows dealt to so many partitions by a key, before costly work on each row; None: as they lie."""
    return df.repartition(partitions, *by) if partitions else df


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage table and read it back.

    What follows starts from the written rows: a model is not called again,
    the plan is short, and a lost executor costs one read.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
