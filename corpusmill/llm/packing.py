"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed by their number of tokens to tiers of power-of-two context sizes.
Each tier is packed into windows of its own size; gaps of long windows are filled from
shorter tiers, at last by cutting a document to measure; windows are then dealt to step
groups of like numbers of tokens.

Every task packs the documents it reads, a bounded batch at a time, and carries what is
left over to its next batch, so nothing is shuffled and the padding does not depend on
how many tasks there are: a task's last tokens go to windows of ever smaller powers of
two, which need no padding either. Where documents have an order, such as that of a
curriculum, they are ranged to tasks along it, and sequences are numbered in the order of
the documents they start with.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import word_tokenizer

CONTEXT = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens that a task holds before it packs them.
BATCH_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 64 * CONTEXT
#: Bytes of text tokenized at once; few enough to stay in a core's cache between passes.
TEXT_BYTES = 1 << 16

PIECE = tuple[int, int, int]  # document's place in the batch, start, length


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The shortest context that holds `length` tokens."""
    return next(t for t in tiers if length <= t)


class Shelves:
    """Pieces of each tier, sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.of: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def put(self, piece: PIECE) -> None:
        doc, start, length = piece
        insort(self.of[tier_of(length, self.tiers)], (length, doc, start))

    def tokens(self, tier: int) -> int:
        return sum(x[0] for x in self.of[tier])

    def longest(self, tier: int) -> PIECE:
        length, doc, start = self.of[tier].pop()
        return doc, start, length

    def fitting(self, gap: int, most: int) -> PIECE | None:
        """The longest piece of at most `gap` tokens, from tiers of at most `most`."""
        for tier in reversed([t for t in self.tiers if t <= most]):
            shelf = self.of[tier]
            if at := bisect_right(shelf, (gap, 1 << 62)):
                length, doc, start = shelf.pop(at - 1)
                return doc, start, length
        return None

    def cut(self, gap: int, most: int) -> PIECE | None:
        """`gap` tokens off the shortest piece that is longer, its rest put back."""
        for tier in [t for t in self.tiers if t <= most]:
            shelf = self.of[tier]
            at = bisect_right(shelf, (gap, 1 << 62))
            if at < len(shelf):
                length, doc, start = shelf.pop(at)
                self.put((doc, start + gap, length - gap))
                return doc, start, gap
        return None


def pack_windows(shelves: Shelves, last: bool) -> list[list[PIECE]]:
    """Full windows, each a list of pieces in order.

    Long tiers go first and may take pieces of shorter ones. Where the pieces left are fewer
    than a window's tokens they stay for the next batch; with `last` they go to windows of
    smaller powers of two, down to one token.
    """
    windows = []

    def fill(size: int, most: int, first: PIECE | None) -> None:
        window, gap = [], size
        piece = first
        while gap:
            piece = piece or shelves.fitting(gap, most) or shelves.cut(gap, most)
            window.append(piece)
            gap -= piece[2]
            piece = None
        windows.append(window)

    for tier in reversed(shelves.tiers):
        short = sum(shelves.tokens(t) for t in shelves.tiers if t <= tier)
        while shelves.of[tier] and short >= tier:
            fill(tier, tier, shelves.longest(tier))
            short -= tier
    if last:
        rest = sum(shelves.tokens(t) for t in shelves.tiers)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            fill(size, shelves.tiers[-1], None)
            rest -= size
    return windows


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: longest first, each to the group with the fewest tokens."""
    n = max(1, round(sum(lengths) / step_tokens))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        load, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (load + lengths[k], g))
    return out


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Pack documents into sequences; one row for each piece of a document.

    docs: doc_id, text and any others, which are ignored. A document is its text's ids
    (null text: none), then end_id. Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (the sequence's length, a power of two, all of it filled),
    step_group, and with with_ids the piece's ids as array<int>. Each id lies in one piece.
    Null and repeated doc_ids are documents of their own. Sequence numbers hold the task's
    number in their upper bits and follow the order of its input, so a task that is run
    again gives the same rows. An empty table gives no rows.

    With `order` documents are packed in that order: sequence_id rises along it, but for the
    documents of one batch of BATCH_TOKENS and the pieces it leaves over. Nulls come first.
    """
    if list(tiers) != sorted(tiers) or tiers[-1] != context or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two that end with the context size")
    end = end_id.to_bytes(4, "little")
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        base = TaskContext.get().partitionId() << 32
        sequences = groups = 0
        held: dict[int, tuple[object, bytes]] = {}
        shelves, docs_seen, waiting = Shelves(tiers), 0, 0

        def emit(windows: list[list[PIECE]]) -> pa.RecordBatch:
            nonlocal sequences, groups
            lengths = [sum(p[2] for p in w) for w in windows]
            steps = step_groups(lengths, step_tokens)
            cols: list[list] = [[] for _ in range(10)]
            for w, length, step in zip(windows, lengths, steps, strict=True):
                offset = 0
                for doc, start, n in w:
                    doc_id, ids = held[doc]
                    part = ids[4 * start : 4 * (start + n)]
                    row = (doc_id, start, n, zlib.crc32(part), len(ids) // 4, base + sequences, offset, length, base + groups + step, memoryview(part).cast("I").tolist() if with_ids else None)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                    offset += n
                sequences += 1
            groups += max(steps, default=-1) + 1
            arrays = [pa.array(cols[0], ARROW.get(id_type, pa.string())), *(pa.array(c, pa.int64()) for c in cols[1:9])] + ([pa.array(cols[9], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=NAMES[: len(arrays)])

        def batch(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            # Along the input: by the first document that begins in a window, else by the first it holds.
            windows = sorted(pack_windows(shelves, last), key=lambda w: min((p[1] > 0, p[0]) for p in w)[1])
            for at in range(0, len(windows), 2048):
                yield emit(windows[at : at + 2048])
            left = {x[1] for t in tiers for x in shelves.of[t]}
            for doc in held.keys() - left:
                del held[doc]
            waiting = sum(shelves.tokens(t) for t in tiers)

        for ids, texts in portions(batches):
            for doc_id, coded in zip(ids, words.encode(texts), strict=True):
                coded += end
                n = len(coded) // 4
                held[docs_seen] = (doc_id, coded)
                for start in range(0, n, context):
                    shelves.put((docs_seen, start, min(context, n - start)))
                docs_seen += 1
                waiting += n
                if waiting >= BATCH_TOKENS:
                    yield from batch(False)
        words.rest()
        yield from batch(True)

    kinds = [f"doc_id {id_type}", *(f"{c} bigint" for c in NAMES[1:9]), *(["ids array<int>"] if with_ids else [])]
    read = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *(c.alias(f"order_{k}") for k, c in enumerate(order or [])))
    if order:
        # As many ranges as docs come in.
        tasks = max(1, docs.rdd.getNumPartitions())
        along = [f"order_{k}" for k in range(len(order))]
        read = read.repartitionByRange(tasks, *along).sortWithinPartitions(*along).select("doc_id", "text")
    return read.mapInArrow(run, ", ".join(kinds))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]
ARROW = {"bigint": pa.int64(), "int": pa.int32()}


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of some TEXT_BYTES at a time."""
    for b in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= TEXT_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts
