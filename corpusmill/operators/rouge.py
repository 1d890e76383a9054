"""ROUGE-1, ROUGE-2 and ROUGE-L F-measures of prediction and reference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusmill.sources.store import written

TOKENS = {"ascii": r"[a-z0-9]+", "unicode": r"[\p{L}\p{N}]+"}


def tokens(text: Column, tokenizer: str = "ascii") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS[tokenizer]), 0)


def grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))


def f_measure(overlap: Column, predicted: Column, wanted: Column) -> Column:
    """2PR / (P + R) = 2 overlap / (predicted + wanted); nothing in common gives 0."""
    return F.when(overlap > 0, 2.0 * overlap / (predicted + wanted)).otherwise(0.0)


def overlap_of(n: int) -> Callable[[Column, Column], Column]:
    """A column function of two texts whose words one blank parts: o, p, r, their common n-grams and those of each."""

    def counted(text: str) -> Counter:
        words = text.split()
        return Counter(zip(*(words[k:] for k in range(n)), strict=False))

    @F.pandas_udf(StructType([StructField(c, LongType()) for c in "opr"]))
    def run(predicted: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        both = ((counted(x), counted(y)) for x, y in zip(predicted, wanted, strict=True))
        return pd.DataFrame([((a & b).total(), a.total(), b.total()) for a, b in both], columns=["o", "p", "r"])

    return run


def rouge_n(pairs: DataFrame, n: int, tokenizer: str = "ascii") -> DataFrame:
    """pairs(id, prediction, reference) to id, f: overlap of n-grams, each counted as often as both have it.

    A pair is counted where it is read, and no gram is dealt out. Only pairs that share an id,
    and so their grams, are taken apart; those without one score 0.
    """
    joined = (F.array_join(tokens(F.col(c), tokenizer), " ") for c in ("prediction", "reference"))
    each, _ = written(pairs.select("id", overlap_of(n)(*joined).alias("n")).select("id", "n.*"), "overlaps")
    shared, _ = written(each.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared-ids")
    score = F.when(F.col("id").isNotNull(), f_measure(F.col("o"), F.col("p"), F.col("r"))).otherwise(0.0)
    if shared.isEmpty():
        return each.select("id", score.alias("f"))
    alone = each.join(shared, "id", "left_anti").select("id", score.alias("f"))
    return alone.union(rouge_n_by_id(pairs.join(shared, "id", "left_semi"), n, tokenizer))


def rouge_n_by_id(pairs: DataFrame, n: int, tokenizer: str) -> DataFrame:
    """rouge_n() by way of every gram of every id; all pairs of an id score what they have together."""
    # Words in columns of their own: within grams they would be found anew for every gram.
    words = pairs.select("id", tokens(F.col("prediction"), tokenizer).alias("p"), tokens(F.col("reference"), tokenizer).alias("r"))
    sides = words.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), grams(F.col("p"), n).alias("g")), F.struct(F.lit(1).alias("side"), grams(F.col("r"), n).alias("g")))).alias("s"))
    counts = sides.select("id", "s.side", F.explode("s.g").alias("gram")).groupBy("id", "gram").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("r"))
    sums = counts.groupBy("id").agg(F.sum(F.least("p", "r")).alias("o"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    return pairs.select("id").join(sums, "id", "left").select("id", F.coalesce(f_measure(F.col("o"), F.col("p"), F.col("r")), F.lit(0.0)).alias("f"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(pairs: DataFrame, tokenizer: str = "ascii") -> DataFrame:
    t = pairs.select("id", tokens(F.col("prediction"), tokenizer).alias("p"), tokens(F.col("reference"), tokenizer).alias("r"))
    return t.select("id", f_measure(lcs("p", "r"), F.size("p"), F.size("r")).alias("f"))


def mean_f(scores: DataFrame, name: str) -> DataFrame:
    """The mean, 0 without pairs."""
    return scores.agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias(name))
