"""Training records: null-preserving quality filter, coercing projection, split counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.splits import DEFAULT_SALT, SPLITS, split_bucket

RECORD_COLUMNS = ("article_id", "source", "url", "title", "category", "published_at", "content_text", "summary", "prompt_version")
#: These pass through unchanged, null included.
NULLABLE = ("category", "published_at")


def not_failed(flag: Column) -> Column:
    """True unless the flag is false: a missing or null quality flag keeps the row."""
    return F.coalesce(flag, F.lit(True))


def dataset_record(rows: DataFrame) -> DataFrame:
    """Project to RECORD_COLUMNS; missing columns count as null, and nulls get defaults.

    Null ids become 0; null texts become ''; category and published_at stay null.
    """
    have = set(rows.columns)

    def column(name: str) -> Column:
        value = F.col(name) if name in have else F.lit(None)
        if name == "article_id":
            return F.coalesce(value.cast("bigint"), F.lit(0)).alias(name)
        value = value.cast("string")
        return (value if name in NULLABLE else F.coalesce(value, F.lit(""))).alias(name)

    return rows.select(*map(column, RECORD_COLUMNS))


def split_rows(rows: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Records that did not fail quality control and have text and summary, with their split.

    Whitespace-only text counts as text. Order of rows plays no part.
    """
    if "qc_passed" in rows.columns:
        rows = rows.where(not_failed(F.col("qc_passed")))
    return dataset_record(rows).where("content_text <> '' and summary <> ''").withColumn("split", split_bucket(F.col("article_id"), salt))


def split_counts(rows: DataFrame) -> DataFrame:
    """One row with the number of rows of each split, zeros included."""
    return rows.agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
