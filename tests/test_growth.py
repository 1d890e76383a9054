"""What must not grow with the input: Python batches, shuffled grams, passes over texts, labelling tasks."""

import json
import unicodedata
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusmill.functions import text
from corpusmill.operators import crawl, labeling, near_dup, qc, rouge
from corpusmill.plans import text_queries
from corpusmill.sources.store import importable


@pytest.fixture(scope="module", autouse=True)
def _workers(spark):
    importable(spark)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_bounded_in_bytes(spark):
    rows = spark.range(0, 400, 1, 1).withColumn("t", F.repeat(F.lit("x"), 100_000))

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [b["t"].str.len().sum()]})

    got = [r.n for r in rows.mapInPandas(sizes, "n bigint").collect()]
    assert sum(got) == 40_000_000 and max(got) < 6_000_000


def test_pages_take_one_worker(spark):
    html = "<html><head><title>T</title></head><body><article><p>" + " ".join(f"w{k}" for k in range(60)) + "</p></article></body></html>"
    df = spark.createDataFrame([(1, html), (2, "<p>short</p>"), (3, None)], "i int, html string")
    got = {r.i: r.x for r in df.select("i", crawl.extract_with_print("html").alias("x")).collect()}
    assert got[1].title == "T" and got[1].fp == near_dup.fingerprint(got[1].content_text)
    assert got[2].content_text is None is got[2].fp and got[3].fp is None


def test_normal_form_without_python(spark):
    texts = ["", "abc", "Nguyễn", "ẹ́", "한", "Å", "̈́", "ẋ̣", "\U00011099\U000110ba", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.n for r in df.select("k", text.nfc(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]
    rows = df.select(F.col("t").alias("summary"), F.col("t").alias("source_text"), F.lit(None).cast("string").alias("refusal_reason"))
    assert "Python" not in plan(qc.run_qc(rows, fuzzy=False))
    # Only the fuzzy step is left to Python, in one worker.
    assert plan(qc.run_qc(rows)).count("ArrowEvalPython [") == 1


def test_gram_totals_of_rows_and_of_shared_ids(spark):
    texts = [(1, "abcdefgh" * 60), (2, "Tiếng Việt một hai"), (3, "abc"), (4, None), (5, "?!"), (6, "𝒳𝒴𝒵𝒲𝒳 𝒴𝒵"), (7, "a" * 100)]
    more = [*texts, (1, "abcdefgh" * 30), (None, "xin chào"), (None, "chào xin"), (3, "bcd")]
    for rows in (texts, more):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        want = near_dup.ngrams(docs).groupBy("doc_id").agg(F.count("*").alias("grams"), F.sum("weight").alias("weight"))
        assert Counter(map(tuple, near_dup.gram_totals(docs).collect())) == Counter(map(tuple, want.collect()))


def test_ngram_weights_deals_out_no_grams(spark):
    assert "Exchange" not in plan(text_queries.q_ngram_weights(spark, "/root/testdata/sf0.001"))


def test_rouge_of_rows_and_of_shared_ids(spark):
    pairs = [(1, "the cat sat on the cat", "the cat ran on the cat fast"), (2, "", "x"), (3, None, "a b"), (4, "a b a b", "b a b")]
    more = [*pairs, (1, "cat ran", "dog"), (None, "a b", "a b"), (2, "x y", "x")]
    for rows in (pairs, more):
        df = spark.createDataFrame(rows, "id int, prediction string, reference string")
        for n in (1, 2, 3):
            got, want = (sorted(map(tuple, x.collect()), key=str) for x in (rouge.rouge_n(df, n), rouge.rouge_n_by_id(df, n, "ascii")))
            assert got == want
    assert "Join" not in plan(rouge.rouge_n(spark.createDataFrame(pairs, "id int, prediction string, reference string"), 2))


def test_fingerprints_by_codes():
    for t in ("abcd", "Tiếng Việt " * 80, "𝔸𝔹cdé", "a" * 500, "中文字符測試" * 20, "".join(map(chr, range(0x4E00, 0x5800)))):
        votes, total = [0] * 64, 0
        for gram, weight in near_dup.gram_counts(t).items():
            total += weight
            h = int.from_bytes(near_dup.gram_hash(gram), "big")
            votes = [v + weight * (h >> i & 1) for i, v in enumerate(votes)]
        assert near_dup.fingerprint(t) % 2**64 == sum(1 << i for i, v in enumerate(votes) if 2 * v > total)


def test_pairs_take_fingerprints_once(spark, tmp_path):
    folder = str(tmp_path)

    @F.pandas_udf(LongType())
    def seen(x: pd.Series) -> pd.Series:
        for _ in x:
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return x

    prints = spark.range(40).select(F.col("id").alias("seq"), seen("id").alias("fp"))
    assert near_dup.edges(prints).count() > 0 and len(list(tmp_path.iterdir())) == 40


def test_labelling_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(labeling, "TASK_BYTES", 1000)

    def answer(system, user):
        c = TaskContext.get()
        return json.dumps({"summary": f"{c.stageId()} {c.partitionId()}", "key_entities": [], "confidence": 0.5, "refusal_reason": None})

    rows = spark.createDataFrame([(i, "t", None, "s", "x" * 99) for i in range(200)], "article_id bigint, title string, category string, source string, content_text string")
    got = labeling.label_rows(rows, answer, concurrency=3).collect()
    tasks = Counter(r.summary for r in got)
    assert [r.article_id for r in got] == list(range(200)) and max(tasks.values()) <= 20
    assert {k.split()[1] for k in tasks} <= {"0", "1", "2"}
