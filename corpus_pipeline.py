"""From raw documents to packed training sequences in five stages.

Every stage works on all that its predecessor kept and is written as Parquet before the
next one reads it. The columns of documents go through, whatever others there are, up to
packing, whose rows are pieces of sequences.

Null and empty texts are documents without words: not toxic, near copies of each other (one
stays), without repeats, and of size 0, so the mix leaves them out. Null ids are ids of
their own; a null source is a source. Fully repeated rows are near copies. An empty table
gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, repeats, simhash, toxicity
from corpusmill.llm.registry import tokenizer_path
from corpusmill.sources.store import importable, remove, table, written

#: Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard
#: similarity of 0.8. Candidates come from 256-bit fingerprints: texts of that similarity differ
#: in 39 bits on average (48 if they have 4 and 5 shingles) and unrelated ones in 128; the
#: radius takes the spread of the estimate in.
NEAR = {"words": 5, "lanes": 4, "radius": 72, "similarity": 0.8, "recall": 0.999, "least": 0.8}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(~F.col("toxic")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    importable(spark)
    return simhash.keep_one(docs, simhash.near_duplicates(docs, **NEAR))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur elsewhere too; those with nothing left go."""
    importable(spark)
    # Names that cannot clash with those of the counts.
    names = {c: f"_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    left = repeats.remove_repeats(docs.withColumnsRenamed(names), with_text=True)
    now = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return left.where("n_removed = 0 or n_removed < n_bytes").select(*(now.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents repeated or left out to meet their source's target."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, numbered along the order in which the documents were written."""
    importable(spark)
    return packing.pack(docs, tokenizer_path(), order=written_order(docs))


def written_order(docs: DataFrame) -> list[Column] | None:
    """Where a row stands in a written table: its part's number, its file and its row there.

    The mixing stage sorts by position, and Spark numbers the files it writes by the sorted
    partitions, but reads files by size. A table that is not of files has no order.
    """
    name = F.col("_metadata.file_name")
    try:
        docs.select(name).schema
    except AnalysisException:
        return None
    return [F.try_to_number(F.regexp_extract(name, r"part-(\d+)", 1), F.lit("999999999")), name, F.col("_metadata.row_index")]


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_copies),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, suffix order, tokenization and the fitted model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
