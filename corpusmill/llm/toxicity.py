"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their first letters (so that inflected words count
together), each valued log(1 + its count), and the log of the number of words (at least SHORT). One weight
vector w is shared by all thresholds t_1 < t_2 < ...: P(severity <= k) = logistic(t_k - w.x),
and the expected severity is the sum over k of P(severity > k). Labels say toxic or not;
grades 1 and up split the toxic ones by how many features they hold that few clean texts of
the sample do and several toxic ones do.

The model is fitted on the driver from at most `sample` labelled texts, half of them toxic,
chosen by hash, one of each id, and none whose words and counts take over LONGEST_SAMPLED
characters; it has at most MOST_FEATURES features, so what the driver gets and what it
sends is bounded. Scoring covers every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SAMPLE = 6000
#: Characters of a sampled text's distinct words and their counts.
LONGEST_SAMPLED = 1 << 16
#: Shorter texts count as this long: few words are no sign of either kind.
SHORT = 50
#: Lengths of first letters.
PREFIXES = (3, 4, 5, 6)
#: Texts of the sample that must hold a feature, and the least difference of its means.
LEAST_TEXTS = 3
LEAST_SHARE = 0.02
#: The mean over toxic texts from which a feature marks severity.
MARKED_SHARE = 0.05
PENALTY = 0.006
MOST_FEATURES = 5_000
#: Expected severity from which a document is rejected.
REJECT = 0.5


def text_words(text: str | None) -> Counter[str]:
    """Words of a text, lower-cased, without punctuation, and how often it has them."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def text_features(words: Counter[str]) -> dict[str, float]:
    """Values of a text's features: words as they are, first letters with a mark, the length under ''."""
    counts: Counter[str] = Counter()
    for w, c in words.items():
        counts[w] += c
        for k in PREFIXES:
            if len(w) >= k:
                counts[w[:k] + "-"] += c
    return {f: math.log1p(c) for f, c in counts.items()} | {"": math.log(max(words.total(), SHORT))}


def packed_words(text: str | None) -> str:
    """The words of a text and their counts in one string, words in order."""
    return " ".join(f"{w} {c}" for w, c in sorted(text_words(text).items()))


def unpacked(words: str) -> dict[str, float]:
    """Features of packed_words()."""
    parts = words.split(" ") if words else []
    return text_features(Counter({w: int(c) for w, c in zip(parts[::2], parts[1::2], strict=True)}))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[str], np.ndarray]:
    """Packed words and toxic (0/1) of at most `sample` labelled documents, equal texts once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    pick = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    chosen = F.broadcast(pick(1).union(pick(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed_words(t.as_py()) for t in b.column(1)], pa.string()), b.column(2)], names=["doc_id", "words", "toxic"])

    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    packed = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, words string, toxic int").where(F.length("words") <= LONGEST_SAMPLED)
    # However many rows have an id, one of its texts comes to the driver.
    rows = packed.groupBy("doc_id").agg(F.min(F.struct("words", "toxic")).alias("one")).select("one.*").collect()
    once = sorted({(r.words, r.toxic) for r in rows})
    return [w for w, _ in once], np.array([t for _, t in once], dtype=np.int64)


class Shares:
    """Of every feature of the sample, the number of texts that hold it and its mean over clean and over toxic texts."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.of: dict[str, list[float]] = {}
        n = [max(1, int((toxic == kind).sum())) for kind in (0, 1)]
        for words, kind in zip(texts, toxic.tolist(), strict=True):
            for f, v in unpacked(words).items():
                x = self.of.setdefault(f, [0, 0.0, 0.0])
                x[0] += 1
                x[1 + kind] += v / n[kind]
        self.of.pop("", None)

    def marked(self) -> set[str]:
        """Features that toxic texts hold and clean ones rarely do."""
        return {f for f, (_, clean, toxic) in self.of.items() if toxic >= MARKED_SHARE and toxic >= 5 * clean}

    def features(self) -> list[str]:
        """The length, and what LEAST_TEXTS texts hold with means LEAST_SHARE apart."""
        gap = {f: d for f, (n, clean, toxic) in self.of.items() if n >= LEAST_TEXTS and (d := abs(toxic - clean)) >= LEAST_SHARE}
        return ["", *sorted(gap, key=lambda f: (-gap[f], f))[:MOST_FEATURES]]


def graded(counts: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Severity grades 0..grades-1 of the sample: toxic texts split at even shares of their numbers of marked features."""
    cuts = np.quantile(counts[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, counts, side="left"), 0)


def likelihood(p: np.ndarray, k: int, flat: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood of grades y and its gradient.

    p: weights, then k thresholds; flat, value, row: feature, value and text of every feature
    that a text holds; share: what each text weighs.
    """
    v, n = len(p) - k, len(y)
    at = np.arange(n)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    score = np.bincount(row, weights=value * p[:v][flat], minlength=n)
    c = np.concatenate([np.zeros((n, 1)), logistic(p[v:] - score[:, None]), np.ones((n, 1))], axis=1)
    hi, lo = c[at, y + 1], c[at, y]
    between = np.maximum(hi - lo, 1e-9)
    up, down = share / between * hi * (1 - hi), share / between * lo * (1 - lo)
    g_t = [down[y == j + 1].sum() - up[y == j].sum() for j in range(k)]
    return float(-(share * np.log(between)).sum()), np.concatenate([np.bincount(flat, weights=value * (up - down)[row], minlength=v), g_t])


def fit(texts: list[str], toxic: np.ndarray, grades: int = 3, penalty: float = PENALTY, rounds: int = 600) -> tuple[dict[str, float], list[float]]:
    """Weights of words and thresholds of the cumulative-link model.

    Accelerated proximal gradient on the likelihood, toxic and clean texts weighing half
    each, with an absolute-value penalty: words that happen to be frequent in copies of one
    toxic text get no weight beside those that toxic texts share. Without texts of both
    kinds there is nothing to fit: no weights, and thresholds that give everything severity
    zero.
    """
    if not len(toxic) or toxic.max() == 0 or toxic.min() > 0:
        return {}, [50.0] * (grades - 1)
    shares = Shares(texts, toxic)
    marked, names = shares.marked(), shares.features()
    del shares
    vocab = {f: k for k, f in enumerate(names)}
    flat, value, lengths, counts = [], [], [], []
    for words in texts:
        held = unpacked(words)
        mine = [f for f in held if f in vocab]
        flat.append(np.array([vocab[f] for f in mine], dtype=np.int32))
        value.append(np.array([held[f] for f in mine]))
        lengths.append(len(mine))
        counts.append(len(marked.intersection(held)))
    y = graded(np.array(counts), toxic, grades)
    flat, value, row = np.concatenate(flat), np.concatenate(value), np.repeat(np.arange(len(y)), lengths)
    n, k, v = len(y), grades - 1, len(names)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())

    gradient = lambda p: likelihood(p, k, flat, value, row, y, share)[1]

    # The curvature along scores and thresholds is at most 1 for each; power iteration gives the largest.
    z = np.ones(v + 1)
    for _ in range(30):
        s = share * (np.bincount(row, weights=value * z[:v][flat], minlength=n) + z[v])
        z = np.append(np.bincount(flat, weights=value * s[row], minlength=v), s.sum())
        bound = np.linalg.norm(z)
        z /= bound
    step = 1 / max(bound, 1e-9)
    p = q = np.concatenate([np.zeros(v), np.linspace(0.0, 1.0, k) if k > 1 else [0.0]])
    momentum = 1.0
    for _ in range(rounds):
        new = q - step * gradient(q)
        new[:v] = np.sign(new[:v]) * np.maximum(np.abs(new[:v]) - step * penalty, 0)
        new[v:] = np.maximum.accumulate(new[v:] + 0.05 * np.arange(k)) if k > 1 and (np.diff(new[v:]) < 0.05).any() else new[v:]
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        p, q, momentum = new, new + (momentum - 1) / faster * (new - p), faster
    return {w: float(p[i]) for w, i in vocab.items() if p[i]}, p[v:].tolist()


def expected_severity(words: Counter[str], weights: dict[str, float], thresholds: list[float]) -> float:
    counts: dict[str, int] = {}
    for w, c in words.items():
        if w in weights:
            counts[w] = counts.get(w, 0) + c
        for k in PREFIXES:
            if len(w) >= k and (f := w[:k] + "-") in weights:
                counts[f] = counts.get(f, 0) + c
    score = weights.get("", 0.0) * math.log(max(words.total(), SHORT)) + math.fsum(weights[f] * math.log1p(c) for f, c in counts.items())
    return float(sum(1 / (1 + np.exp(np.clip(t - score, -40, 40))) for t in thresholds))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = 3, reject: float = REJECT) -> DataFrame:
    """docs with severity (double, 0 to grades - 1) and toxic (severity of at least `reject`).

    docs: doc_id, text and any others, all kept; columns named severity or toxic are
    replaced. labels: doc_id, toxic. Null and empty texts are scored by their lack of words.
    Repeated rows get equal scores. Without labels of both kinds nothing is toxic. An empty
    table gives no rows.
    """
    weights, thresholds = fit(*sampled(docs, labels, sample), grades)
    model = docs.sparkSession.sparkContext.broadcast((weights, thresholds))
    # Other columns travel in a struct, so their names cannot clash.
    others = [c for c in docs.columns if c not in ("severity", "toxic")]
    packed = docs.select(F.struct(*others).alias("row"))
    at = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model.value
        for b in batches:
            severity = [expected_severity(text_words(x.as_py()), w, t) for x in b.column(0).field(at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity, pa.float64())], names=["row", "severity"])

    out = packed.mapInArrow(run, f"row {dict(packed.dtypes)['row']}, severity double")
    return out.select("row.*", "severity", (F.col("severity") >= reject).alias("toxic"))
