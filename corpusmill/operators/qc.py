"""Quality control of summaries against their source text."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusmill.functions import text as T


@dataclass(frozen=True)
class QcConfig:
    min_words: int = 40
    max_words: int = 90
    min_sentences: int = 2
    max_sentences: int = 4
    entity_fuzzy_min_ratio: float = 0.85


def shared_characters(short: str, long: str) -> np.ndarray:
    """For each part of `long` as long as `short`, how many characters the two have in common at most."""
    codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    m = len(short)
    out = np.zeros(len(codes) - m + 1, dtype=np.int64)
    for char in set(short):
        seen = np.concatenate(([0], np.cumsum(codes == ord(char))))
        out += np.minimum(seen[m:] - seen[:-m], short.count(char))
    return out


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """0-100: the best match of the shorter text with any part of the longer one of its length.

    Parts are matched from the one that shares most characters on, until no other can be
    better; with `least` a lower result may be given as 0, and the first that reaches it is good enough.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best, m = 0.0, SequenceMatcher(None, autojunk=False)
    m.set_seq2(short)
    bound = shared_characters(short, long) / len(short)
    for at in np.argsort(-bound, kind="stable").tolist():
        if bound[at] <= best or 100 * bound[at] < least:
            break
        m.set_seq1(long[at : at + len(short)])
        best = max(best, m.ratio())
        if least and 100 * best >= least:
            break
    return 100 * best


@F.pandas_udf(ArrayType(StringType()))
def not_alike(names: pd.Series, source: pd.Series, least: pd.Series) -> pd.Series:
    """The names no part of the source is like."""
    return pd.Series([[n for n in ns if partial_ratio(n, s, 100 * r) < 100 * r] if len(ns) else [] for ns, s, r in zip(names, source, least, strict=True)])


def source_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def run_qc(rows: DataFrame, cfg: QcConfig = QcConfig(), fuzzy: bool = True) -> DataFrame:
    """rows(summary, source_text, refusal_reason, ...) with qc_passed and qc_details.

    Reasons come in a fixed order. With fuzzy, names that no cheaper test finds in the source
    are compared with its parts.
    """
    norm = lambda c: T.strip(T.nfc(F.coalesce(F.col(c), F.lit(""))))
    r = rows.withColumns({"_summary": norm("summary"), "_source": norm("source_text")})
    r = r.withColumns({
        "_words": T.word_count(F.col("_summary")), "_sentences": F.size(T.sentences(F.col("_summary"))),
        "_numbers": F.filter(T.numerics(F.col("_summary")), lambda t: ~T.contains_numeric(F.col("_source"), t)),
        "_names": F.filter(T.entities(F.col("_summary")), lambda e: ~T.contains_entity(F.col("_source"), e)),
    })
    if fuzzy:
        # Rows without such names send no text to Python.
        source = F.when(F.size("_names") > 0, F.col("_source"))
        r = r.withColumn("_names", not_alike("_names", source, F.lit(cfg.entity_fuzzy_min_ratio)))
    first = lambda c: F.array_join(F.slice(c, 1, 5), ",")
    say = lambda test, *parts: F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))
    words, n = F.col("_words").cast("string"), F.col("_sentences").cast("string")
    reasons = F.array_compact(F.array(
        say(F.coalesce("refusal_reason", F.lit("")) != "", "llm_refusal:", F.col("refusal_reason")),
        say(F.col("_words") < cfg.min_words, "too_short:", words, "<", cfg.min_words),
        say(F.col("_words") > cfg.max_words, "too_long:", words, ">", cfg.max_words),
        say(F.col("_sentences") < cfg.min_sentences, "too_few_sentences:", n, "<", cfg.min_sentences),
        say(F.col("_sentences") > cfg.max_sentences, "too_many_sentences:", n, ">", cfg.max_sentences),
        say(F.size("_numbers") > 0, "unsupported_numbers:", first("_numbers")),
        say(F.size("_names") > 0, "unsupported_entities:", first("_names")),
    ))
    r = r.withColumn("_reasons", reasons)
    details = F.struct((F.size("_reasons") == 0).alias("passed"), F.col("_reasons").alias("reasons"), F.col("_words").alias("word_count"), F.col("_sentences").alias("sentence_count"), F.col("_numbers").alias("missing_numbers"), F.col("_names").alias("missing_entities"))
    return r.withColumns({"qc_passed": F.size("_reasons") == 0, "qc_details": details}).drop("_summary", "_source", "_words", "_sentences", "_numbers", "_names", "_reasons")


def qc_counts(rows: DataFrame) -> DataFrame:
    """total, passed, failed; a null flag has failed."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("qc_passed").eqNullSafe(True)).alias("passed"), F.count_if(~F.col("qc_passed").eqNullSafe(True)).alias("failed"))
