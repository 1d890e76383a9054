"""JSON Lines, one object a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a JSONL file or folder; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite a folder with JSONL files; nulls are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, splits: tuple[str, ...]) -> None:
    """`<split>.jsonl` for each split, each a folder of parts, empty ones too; df is read once.

    Rows are written by split at once; the folders then get their names.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    draft = f"{root}/_splits"
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("split").json(draft)
    store = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in splits:
        target, part = fs_path(f"{root}/{s}.jsonl"), fs_path(f"{draft}/split={s}")
        store.delete(target, True)
        if store.exists(part):
            store.rename(part, target)
        else:
            store.mkdirs(target)
    store.delete(fs_path(draft), True)


def read_splits(spark: SparkSession, path: str, splits: tuple[str, ...], schema: str | StructType) -> DataFrame:
    """Rows of the splits that write_splits() wrote, with their split."""
    parts = [read_jsonl(spark, f"{path.rstrip('/')}/{s}.jsonl", schema).withColumn("split", F.lit(s)) for s in splits]
    return reduce(DataFrame.unionByName, parts)
