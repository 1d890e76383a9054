"""Summaries by a pluggable model, a batch at a time; the default takes sentences."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A function of texts to summaries; made once for each worker by a loader.
Model = Callable[[list[str]], list[str]]
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def leading_sentences(texts: list[str], n: int = 3) -> list[str]:
    """The n sentences whose words are most frequent in the text, in their order; ties go to earlier ones."""
    out = []
    for t in texts:
        parts = [s for s in SENTENCE.split(t.strip()) if s]
        freq = Counter(re.findall(r"\w+", t.lower()))
        score = [sum(freq[w] for w in set(ws)) / len(ws) if (ws := re.findall(r"\w+", s.lower())) else 0.0 for s in parts]
        best = sorted(sorted(range(len(parts)), key=lambda k: (-score[k], k))[:n])
        out.append(" ".join(parts[k] for k in best))
    return out


def summarizer(load: Callable[[], Model] = lambda: leading_sentences, batch: int = 4) -> Callable[[Column], Column]:
    """A column function. Blank texts get '' and do not reach the model, which is loaded when first needed."""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in series:
            texts = s.fillna("").tolist()
            out, full = [""] * len(texts), [k for k, t in enumerate(texts) if t.strip()]
            for at in range(0, len(full), batch):
                model = model or load()
                for k, summary in zip(full[at : at + batch], model([texts[k] for k in full[at : at + batch]]), strict=True):
                    out[k] = summary
            yield pd.Series(out)

    return run


def _sentences(text: str) -> tuple[list[str], list[list[str]]]:
    parts = [s for s in SENTENCE.split(text.strip()) if s]
    return parts, [re.findall(r"\w+", s.lower()) for s in parts]


def _ranked(similar: np.ndarray, damping: float = 0.85) -> np.ndarray:
    """Stationary weights of a walk along similarities; rows without any lead everywhere."""
    n = len(similar)
    sums = similar.sum(axis=1, keepdims=True)
    step = np.where(sums > 0, similar / np.where(sums > 0, sums, 1), 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(100):
        new = (1 - damping) / n + damping * rank @ step
        if np.abs(new - rank).sum() < 1e-9:
            break
        rank = new
    return rank


def _best(parts: list[str], rank: np.ndarray, n: int) -> str:
    return " ".join(parts[k] for k in sorted(sorted(range(len(parts)), key=lambda k: (-round(rank[k], 12), k))[:n]))


def lexrank(texts: list[str], n: int = 3, threshold: float = 0.1) -> list[str]:
    """The n sentences most central by cosines of tf-idf vectors above a threshold, in their order."""
    out = []
    for text in texts:
        parts, ws = _sentences(text)
        if not parts:
            out.append("")
            continue
        vocab = {w: k for k, w in enumerate(sorted({w for s in ws for w in s}))}
        tf = np.zeros((len(parts), len(vocab)))
        for k, s in enumerate(ws):
            for w in s:
                tf[k, vocab[w]] += 1
        tf = tf / np.maximum(tf.max(axis=1, keepdims=True, initial=0), 1) * np.log(1 + len(parts) / np.maximum((tf > 0).sum(axis=0), 1))
        unit = tf / np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
        close = (unit @ unit.T > threshold).astype(float)
        np.fill_diagonal(close, 0)
        out.append(_best(parts, _ranked(close), n))
    return out


def textrank(texts: list[str], n: int = 3) -> list[str]:
    """The n sentences most central by words in common over the logarithms of lengths, in their order."""
    out = []
    for text in texts:
        parts, ws = _sentences(text)
        sets = [set(s) for s in ws]
        similar = np.zeros((len(parts), len(parts)))
        for i in range(len(parts)):
            for j in range(i):
                scale = math.log(max(len(ws[i]), 1)) + math.log(max(len(ws[j]), 1))
                similar[i, j] = similar[j, i] = len(sets[i] & sets[j]) / scale if scale > 0 else 0.0
        out.append(_best(parts, _ranked(similar), n) if parts else "")
    return out


@dataclass(frozen=True)
class Generation:
    """How a sequence model reads and writes."""

    max_input_length: int = 1024
    max_new_tokens: int = 128
    num_beams: int = 4
    no_repeat_ngram_size: int = 3
    length_penalty: float = 1.0
    early_stopping: bool = True


def first_loaded(*loaders: Callable[[], Model]) -> Model:
    """The model of the first loader that works, such as an adapter's and then the plain model's; the last one's error counts."""
    for load in loaders[:-1]:
        try:
            return load()
        except Exception:  # noqa: BLE001 whatever a library raises, the next loader may do
            continue
    return loaders[-1]()


def sequence_model(model_id: str, base_id: str | None = None, token: str | None = None, device: str | None = None, how: Generation = Generation()) -> Model:
    """A hosted or local sequence-to-sequence model, taken as an adapter first; its libraries must be installed where tasks run."""
    import transformers

    def tokenizer_of(source: str) -> object:
        return transformers.AutoTokenizer.from_pretrained(source, token=token)

    def plain() -> Model:
        return generating(transformers.AutoModelForSeq2SeqLM.from_pretrained(model_id, token=token), tokenizer_of(model_id), how, device)

    def adapter() -> Model:
        import peft

        base = base_id or peft.PeftConfig.from_pretrained(model_id, token=token).base_model_name_or_path
        model = peft.PeftModel.from_pretrained(transformers.AutoModelForSeq2SeqLM.from_pretrained(base, token=token), model_id, token=token)
        folder = Path(model_id)
        return generating(model, tokenizer_of(base if folder.exists() and not (folder / "tokenizer.json").exists() else model_id), how, device)

    return first_loaded(adapter, plain)


def generating(model: object, tokenizer: object, how: Generation, device: str | None = None) -> Model:
    """A model and its tokenizer as a function of texts."""
    if device:
        model.to(device)
    model.eval()
    options = {k: v for k, v in asdict(how).items() if k != "max_input_length"}

    def run(texts: list[str]) -> list[str]:
        inputs = tokenizer(texts, max_length=how.max_input_length, truncation=True, padding=True, return_tensors="pt")
        inputs = {k: v.to(device) for k, v in inputs.items()} if device else inputs
        return [str(x) for x in tokenizer.batch_decode(model.generate(**inputs, **options), skip_special_tokens=True)]

    return run


def tokenized(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[int]]]], max_input: int = 1024, max_target: int = 128) -> DataFrame:
    """input_ids, attention_mask and labels (arrays of int) of rows(content_text, summary); all other columns go.

    load makes a function of texts to ids, once for each task. Ids beyond the greatest
    lengths are cut off; null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            texts, targets = ([x or "" for x in c.to_pylist()] for c in b.columns)
            ids, labels = [x[:max_input] for x in encode(texts)], [x[:max_target] for x in encode(targets)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([[1] * len(x) for x in ids], kind), pa.array(labels, kind)], names=["input_ids", "attention_mask", "labels"])

    return rows.select("content_text", "summary").mapInArrow(run, "input_ids array<int>, attention_mask array<int>, labels array<int>")


def padded(ids: Column, pad: int) -> Column:
    """ids with every negative one, a place that counts for nothing, made the padding's."""
    return F.transform(ids, lambda x: F.when(x < 0, pad).otherwise(x))


def manual_article(spark: SparkSession, text: str) -> DataFrame:
    """A text that was typed in, as an article."""
    return spark.createDataFrame([(1, "", "", "", None, text)], "article_id bigint, source_name string, url string, title string, published_at string, content_text string")


def response(articles: DataFrame, summary: Column, date: str) -> DataFrame:
    """One row: date, total and items of articles with their summaries, in article order. For a page of results."""
    item = F.struct("article_id", "title", F.col("source_name").alias("source"), "url", "published_at", summary.alias("summary"))
    items = articles.select(item.alias("i")).agg(F.count("*").alias("total"), F.array_sort(F.collect_list("i")).alias("items"))
    return items.select(F.lit(date).alias("date"), "total", F.transform("items", lambda x: x.dropFields("article_id")).alias("items"))
