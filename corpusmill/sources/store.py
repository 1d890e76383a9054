"""Reading tables by name and writing intermediate tables to the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine where spark.checkpoint.dir is unset, as in local tests.
LOCAL_WORK_DIR = "file:///tmp/checkpoints"


#: Rows that Python workers get at once, where the session has Spark's default of 10,000:
#: whole texts make batches large, and an executor holds several.
BATCH_ROWS = "2000"
#: Bytes that a batch is closed at, where the session has Spark's default of 64 MB. A worker holds
#: a batch several times over (Arrow, objects, result), and rows alone do not bound whole texts.
BATCH_BYTES, SPARK_BATCH_BYTES = "4m", "67108864b"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where they can see the folder it was read from.

    Elsewhere the package must be installed or sent along with the job. Also keeps Arrow
    batches small.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", SPARK_BATCH_BYTES) == SPARK_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Setting with the number of partitions that dealt() makes; unset or 0 leaves tables as they are read.
DEAL = "spark.corpusmill.deal"


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as the session asks for by DEAL.

    For tables of one row group, which is one task however many cores there are, as on a
    single machine. The setting costs a shuffle of the table, so it is not meant for large ones.
    """
    n = int(df.sparkSession.conf.get(DEAL, "0"))
    return df.repartition(n) if n else df


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's spark.checkpoint.dir, else the context's checkpoint folder; on one machine
    LOCAL_WORK_DIR. A cluster without any is an error: its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_WORK_DIR


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def application_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, when its results are consumed."""
    remove(spark, application_dir(spark))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Returns the reread DataFrame and its path. A written table survives lost
    executors, and its readers do not recompute what came before.
    """
    spark = df.sparkSession
    importable(spark)
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def appended(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """written() of frames of the same columns, one after the other, as one table."""
    path = None
    for df in frames:
        path = path or work_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete paths of any store that Spark can reach."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
