"""Quality rules: hashed n-gram likelihood ratio between trusted and raw text.

Words and word pairs are hashed to `buckets` features. Two multinomials are estimated: one
from the trusted target, documents labelled of good quality, one from all documents. Both
get `prior` more n-grams of each bucket, as frequent in the one as in the other, so that
n-grams seen a few times count for little. A document's score is the mean over its n-grams
of log p_target - log p_raw; it is kept if that is at least `threshold`, the same for all.
Target counts come from at most `trusted` labelled documents, the ones whose ids hash
lowest; raw counts and scores cover every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.native import BLANK, let, words

BUCKETS = 1 << 16
TRUSTED = 20_000
THRESHOLD = -0.15
PRIOR = 10.0
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and word pairs of a text, given its words' hashes."""
    pairs = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(hashes[i], h), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def repeat_words(hashes: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words in windows of `width` words that the text has twice or more."""

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twins(p: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(p, j)["k"] == e["k"], F.lit(False))
            return F.array_sort(F.filter(F.transform(p, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"])), lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda i, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - i, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

        return let(let(placed, twins), total)

    keys = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))), lambda h, i: F.xxhash64(F.slice(hashes, i + 1, width)))
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("bigint")).otherwise(covered(k)))


def base_counts(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols and n_dup_lines of a text that is not null."""
    gone = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "word_chars": F.length(F.regexp_replace(text, f"{BLANK}+", "")).cast("bigint"),
        "n_symbols": (F.length(text) - gone(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` ids labelled of good quality, chosen by hash."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int, trusted: int, prior: float) -> DataFrame:
    """One row, one column: the log ratio of every bucket, in order."""
    marked = docs.join(F.broadcast(trusted_ids(labels, trusted).withColumn("good", F.lit(1))), "doc_id", "left")
    grams = marked.select("good", F.explode(let(word_hashes(F.col("text")), lambda h: gram_buckets(h, buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    one = every.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))), lambda x: F.struct(x["raw"].alias("raw"), x["target"].alias("target"))).alias("c"),
        F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"),
    )
    share = F.col("target_all") / F.col("raw_all")
    ratio = lambda x: F.log((x["target"] + prior * share) / (share * (x["raw"] + prior)))
    # Without trusted documents nothing speaks for or against a text.
    return one.select(F.transform("c", lambda x: F.when(F.col("target_all") > 0, ratio(x)).otherwise(F.lit(0.0))).alias("w"))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """Counts, score and verdict for every document.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. Returns doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (double,
    null without words) and kept. base_failed: under 20 words, or over 30 % of them in
    repeated windows; such documents are not kept. Null texts have no words. Null and
    repeated ids give rows of their own; an unlabelled corpus scores 0 throughout. An empty
    table gives no rows.
    """
    # The one row is a scalar subquery: an array of fixed size, sent to executors as a constant.
    weights = bucket_weights(docs.select("doc_id", "text"), labels, buckets, trusted, prior).scalar()

    def body(h: Column) -> Column:
        score = let(gram_buckets(h, buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get("w", b)) / F.nullif(F.size(g), F.lit(0)))
        return F.struct(F.size(h).cast("bigint").alias("n_words"), repeat_words(h).alias("n_repeat_words"), score.alias("score"))

    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), weights.alias("w"))
    found = text.select("doc_id", *(c.alias(k) for k, c in base_counts(F.col("text")).items()), let(word_hashes(F.col("text")), body).alias("m"))
    failed = (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))
    rows = found.select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), "m.score")
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
