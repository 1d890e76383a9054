"""Split and dataset queries over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.splits import first_hash_byte, split_bucket
from corpusmill.operators import dataset
from corpusmill.sources.store import table


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents as labelled articles, first line as title, last as summary; the flag is null where there is no label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("article_id"), "source", F.lit(None).cast("string").alias("category"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content_text"),
        F.substring_index("text", "\n", -1).alias("summary"), (F.col("quality") == 1).alias("qc_passed"),
    )


def q_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_counts(dataset.split_rows(labelled(spark, d)))


def q_split_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", first_hash_byte(F.col("doc_id")).alias("first_byte"), split_bucket(F.col("doc_id")).alias("split"))


def q_dataset_record(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_rows(labelled(spark, d))


def q_qc_null_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = labelled(spark, d).where(dataset.not_failed(F.col("qc_passed")))
    return kept.groupBy(F.col("qc_passed").isNull().alias("unlabelled")).agg(F.count("*").alias("n"))


QUERIES = {"split_counts": q_split_counts, "split_assign": q_split_assign, "dataset_record": q_dataset_record, "qc_null_kept_filter": q_qc_null_kept}

BYTE = "('0x' || sha256('vn-news-v1:' || doc_id)[1:2])::INT"
BUCKET = f"CASE WHEN {BYTE} < 26 THEN 'test' WHEN {BYTE} < 52 THEN 'val' ELSE 'train' END"
LABELLED = "(SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (quality IS NULL OR quality = 1) AND text <> '' AND split_part(text, chr(10), -1) <> '')"

ORACLE_SQL = {
    "split_counts": f"""
        SELECT count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'val') AS val, count(*) FILTER (WHERE s = 'test') AS test
        FROM (SELECT {BUCKET} AS s FROM {LABELLED})""",
    "split_assign": f"SELECT doc_id, {BYTE} AS first_byte, {BUCKET} AS split FROM documents",
    "dataset_record": f"""
        SELECT doc_id AS article_id, source, '' AS url, split_part(text, chr(10), 1) AS title, NULL::VARCHAR AS category,
               NULL::VARCHAR AS published_at, text AS content_text, split_part(text, chr(10), -1) AS summary, '' AS prompt_version, {BUCKET} AS split
        FROM {LABELLED}""",
    "qc_null_kept_filter": """
        SELECT quality IS NULL AS unlabelled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)
        WHERE quality IS NULL OR quality = 1 GROUP BY 1""",
}
