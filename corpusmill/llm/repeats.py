"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix is ordered through its first `depth` bytes only, by passes that go from the
leading digit on. Suffixes that are alone in their group after a pass are unique and leave;
groups that are left after the last pass are exactly the repeated windows of `depth` bytes.

Pass 1 is distributed and its digit is ANCHOR bytes long: of the ANCHOR-byte strings in a
window, the one with the least hash, leftmost among equals. Equal windows have equal anchors
at equal offsets, so the digit is a function of the window's bytes; neighbouring windows
share an anchor, so one row stands for a run of them (about 80 for a depth of 200), and a
run whose anchor occurs once is dropped whole.
Pass 2 takes all bytes of such a run as its digit: equal runs are repeated throughout.
Pass 3 orders the windows of the runs that remain, those that share an anchor but differ
elsewhere, by digits of DIGIT bytes in the task that holds the anchor's group. Groups over a
bound, such as a passage that many documents embed, are dealt by whole windows instead.

Rows hold 64-bit hashes of digits; run identity rests on two of them, 128 bits together, and
so does the identity (k, k2) of a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.blocks import grouped, groups
from corpusmill.sources.store import remove, written

DEPTH = 200
ANCHOR = 40
DIGIT = 50
#: Runs of one anchor that a task orders; anchors met more often are dealt by windows.
GROUP_ROWS = 20_000
#: Bytes of text looked at together.
STRETCH = 400_000
BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
PLACE = np.uint64(0xFFFFFF)


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of every `width` bytes, by doubling; empty if there are fewer."""
    if len(codes) < width:
        return np.zeros(0, dtype=np.uint64)
    power = lambda n: np.uint64(pow(BASE, n, 2**64))
    by_width, m = {1: codes}, 1
    while 2 * m <= width:
        h = by_width[m]
        by_width[2 * m] = h[:-m] * power(m) + h[m:]
        m *= 2
    out, have = by_width[m], m
    while have < width:
        s = 1 << ((width - have).bit_length() - 1)
        n = len(codes) - (have + s) + 1
        out = out[:n] * power(s) + by_width[s][have : have + n]
        have += s
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return out ^ (out >> np.uint64(27))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        values = np.minimum(values[:-m], values[m:])
        m *= 2
    rest = width - m
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(texts: list[bytes], depth: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: text number, start, windows, hash of the anchor, hash of all bytes."""
    joined = b"".join(texts)
    if len(joined) > PLACE:
        raise ValueError("texts are too long to look at together")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    none = np.zeros(0, dtype=np.int64)
    if len(joined) < depth:
        return none, none, none, none, none
    hashes = rolling(BYTE_CODES[np.frombuffer(joined, np.uint8)], anchor)
    least = sliding_min((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), depth - anchor + 1)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    inside = np.flatnonzero(text_of[: len(least)] == text_of[depth - 1 : depth - 1 + len(least)])
    if not len(inside):
        return none, none, none, none, none
    place = (least[inside] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    windows = np.diff(np.append(first, len(place)))
    at = inside[first]
    whole = np.array([xxhash.xxh64_intdigest(joined[a:z]) for a, z in zip(at.tolist(), (at + windows - 1 + depth).tolist(), strict=True)], dtype=np.uint64)
    text = text_of[at]
    return text, at - (np.cumsum(lengths) - lengths)[text], windows, hashes[place[first]].view(np.int64), whole.view(np.int64)


def stretches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Keys (texts, 2), offsets and texts, some STRETCH bytes at a time.

    A text longer than that comes in pieces which overlap so that every window lies in one
    piece. Anchors depend on a window's own bytes only, so runs that a cut divides still
    match others window by window.
    """
    keys, offsets, texts, size = [], [], [], 0
    for b in batches:
        for k, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = text.as_py()
            for at in range(0, max(1, len(text) - depth + 1), STRETCH):
                keys.append((k, k2))
                offsets.append(at)
                texts.append(text[at : at + STRETCH + depth - 1])
                size += len(texts[-1])
                if size >= STRETCH:
                    yield np.array(keys, dtype=np.int64), np.array(offsets, dtype=np.int64), texts
                    keys, offsets, texts, size = [], [], [], 0
    if keys:
        yield np.array(keys, dtype=np.int64), np.array(offsets, dtype=np.int64), texts


def window_order(joined: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int, digit: int) -> np.ndarray:
    """Which windows occur twice or more in their group: radix passes from the leading digit on.

    joined: bytes; start, group: a window's place and the hash of its group. Returns indexes.
    """
    codes = BYTE_CODES[joined]
    left = np.arange(len(start))
    cls = group
    for at in range(0, depth, digit):
        width = min(digit, depth - at)
        hashes = rolling(codes, width)
        mixed = (cls * np.uint64(BASE)) ^ hashes[start[left] + at]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(mixed)
        s = mixed[order]
        twin = np.zeros(len(s), dtype=bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:].copy()
        keep = np.sort(order[twin])
        left, cls = left[keep], mixed[keep]
        if not len(left):
            break
    return left


def packed(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (start << 16) | windows


KEY = ["k", "k2"]


def repeated_spans(base: DataFrame, docs: DataFrame, depth: int, anchor: int, digit: int, group_rows: int) -> tuple[DataFrame, list[str]]:
    """Runs of repeated windows: k, k2, span (start << 16 | windows), for docs(k, k2, text binary).

    base holds the same rows dealt by k and k2. Also returns the paths of tables that the
    result is read from.
    """
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, texts in stretches(batches, depth):
            text, start, windows, head, whole = runs(texts, depth, anchor)
            arrays = (head, whole, keys[text, 0], keys[text, 1], packed(start + offsets[text], windows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["head", "whole", *KEY, "span"])

    # Pass 1: anchors that occur twice or more. Tables are written before joins, so that these
    # read two plain exchanges and a hot anchor, run or window can be split.
    rows, rows_path = written(docs.select(*KEY, "text").mapInArrow(find, "head bigint, whole bigint, k bigint, k2 bigint, span bigint"), "rows")
    heads, heads_path = written(rows.groupBy("head").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1"), "anchors")
    met, met_path = written(rows.join(heads, "head").select("head", "whole", *KEY, "span", (F.col("lo") == F.col("hi")).alias("alike"), (F.col("n") > group_rows).alias("hot")), "runs")
    remove(spark, rows_path, heads_path)
    # Pass 2: equal runs.
    alike = met.where("alike").select(*KEY, "span")
    mixed = met.where(~F.col("alike"))
    kinds, kinds_path = written(mixed.groupBy("head", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "span")).alias("one"), F.first("hot").alias("hot")), "run-kinds")
    equal = mixed.join(kinds.where("n > 1").select("head", "whole"), ["head", "whole"]).select(*KEY, "span")

    # Pass 3: windows of one run of each kind.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, k2, text, refs in zip(*(b.column(c).to_pylist() for c in (*KEY, "text", "refs")), strict=True):
                # Of equal documents in a row one will do.
                if (k, k2) == before:
                    continue
                before = (k, k2)
                for r in refs:
                    at, n = r["span"] >> 16, r["span"] & 0xFFFF
                    for c, x in zip(out, (r["head"], k, k2, r["span"], r["hot"], text[at : at + n - 1 + depth]), strict=True):
                        c.append(x)
            kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds_of, strict=True)], names=["head", *KEY, "span", "hot", "bytes"])

    refs, refs_path = written(kinds.select("one.k", "one.k2", F.struct("head", F.col("one.span").alias("span"), "hot").alias("r")).groupBy(*KEY).agg(F.collect_list("r").alias("refs")), "refs")
    spans, spans_path = written(base.join(refs, KEY).mapInArrow(cut, "head bigint, k bigint, k2 bigint, span bigint, hot boolean, bytes binary"), "run-bytes")
    remove(spark, refs_path)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in groups(batches, ["head"]):
            for part in whole_groups(t, 20_000):
                head, k, k2, span = (part.column(c).to_numpy() for c in ("head", *KEY, "span"))
                text = part.column("bytes").to_pylist()
                lengths = np.fromiter(map(len, text), np.int64, len(text))
                n = span & 0xFFFF
                run = np.repeat(np.arange(len(n)), n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                joined = np.frombuffer(b"".join(text), np.uint8)
                start = (np.cumsum(lengths) - lengths)[run] + within
                found = window_order(joined, start, head.view(np.uint64)[run], depth, digit)
                if len(found):
                    first = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 1) | (np.diff(run[found]) != 0))))
                    count = np.diff(np.append(first, len(found)))
                    w = found[first]
                    at = run[w]
                    yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(k2[at]), pa.array(packed((span[at] >> 16) + within[w], count))], names=[*KEY, "span"])

    ordered = grouped(spans.where("not hot").drop("hot"), ["head"]).mapInArrow(order, "k bigint, k2 bigint, span bigint")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ks, k2s, ws, spans_ = [], [], [], []
                for k, k2, span, text in zip(*(part.column(c).to_pylist() for c in (*KEY, "span", "bytes")), strict=True):
                    n = span & 0xFFFF
                    ks += [k] * n
                    k2s += [k2] * n
                    spans_ += [((span >> 16) + i << 16) | 1 for i in range(n)]
                    ws += [digest(text[i : i + depth]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), *(pa.array(x, pa.int64()) for x in (ks, k2s, spans_))], names=["window", *KEY, "span"])

    hot = spans.where("hot").mapInArrow(windows, "window binary, k bigint, k2 bigint, span bigint")
    many, many_path = written(hot.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "windows")
    return alike.union(equal).union(ordered).union(hot.join(many, "window").select(*KEY, "span")), [met_path, kinds_path, spans_path, many_path]


def whole_groups(t: pa.Table, rows: int) -> Iterator[pa.Table]:
    """Slices of about `rows` rows that end where head changes."""
    head = t.column("head").to_numpy()
    ends = np.append(np.flatnonzero(head[1:] != head[:-1]) + 1, len(head))
    at = 0
    while at < len(head):
        end = int(ends[min(np.searchsorted(ends, at + rows), len(ends) - 1)])
        yield t.slice(at, end - at)
        at = end


def removed_runs(spans: list[int] | None, depth: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by spans of windows; ranges that touch are one."""
    if not spans:
        return []
    s = np.sort(np.array(spans, dtype=np.int64))
    start, end = s >> 16, (s >> 16) + (s & 0xFFFF) - 1 + depth
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[first].tolist(), reach[np.append(first[1:] - 1, len(s) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, digit: int = DIGIT, group_rows: int = GROUP_ROWS, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a `depth`-byte string that also starts elsewhere.

    docs: doc_id, text; text is taken as UTF-8 bytes, null as empty. Strings are judged on
    the input, within and across documents, overlaps count, and no string crosses documents.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with
    with_text also kept, the remaining bytes joined as text (a character cut in two is
    dropped), and all further columns of docs.
    Repeated rows are documents of their own, so from `depth` bytes on they are removed
    whole. Texts shorter than `depth` stay. An empty table gives no rows. Further columns
    whose names are those of the result come with a mark of `_` behind them.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    names = (F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    keyed = docs.select(*names, "doc_id", text, *([F.struct(*extra).alias("extra")] if extra else []))
    base = keyed.repartition(*KEY)
    spans, paths = repeated_spans(base, keyed, depth, anchor, digit, group_rows)
    # Documents of one key have equal spans: a set holds them once however many copies there are.
    by_doc, _ = written(spans.groupBy(*KEY).agg(F.collect_set("span").alias("spans")), "spans")
    remove(docs.sparkSession, *paths)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, counts, digests, kept = [], [], [], [], []
            for body, spans_ in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                body = body.as_py()
                cuts = removed_runs(spans_, depth)
                edges = [0, *(x for cut in cuts for x in cut), len(body)]
                left = b"".join(body[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(body))
                removed.append(len(body) - len(left))
                counts.append(len(cuts))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if with_text else None)
            arrays = {"doc_id": b.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                arrays["kept"] = pa.array(kept, pa.string())
            if extra:
                arrays["extra"] = b.column("extra")
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    kinds = dict(keyed.dtypes)
    schema = f"doc_id {kinds['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if with_text else "") + (f", extra {kinds['extra']}" if extra else "")
    out = base.join(by_doc, KEY, "left").mapInArrow(rest, schema)
    if not extra:
        return out
    plain = [c for c in out.columns if c != "extra"]
    taken = {c.lower() for c in (*plain, *extra)}
    names = []
    for c in extra:
        name = c
        while name.lower() in {p.lower() for p in plain} or name != c and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(F.col("extra")[c].alias(name))
    return out.select(*plain, *names)
