"""Search of 64-bit fingerprints within a few bits, by keys that any two near ones share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.operators.blocks import grouped, groups, in_blocks

#: Comparisons that cost as much as one row of a table: dealing it out and sorting it.
ROW_COST = 16
#: Fingerprints of one key that a task compares with each other.
SHARD_ROWS = 2048
GROUP = ["shard", "block_i", "block_j"]


def exact_layout(n: int, radius: int = 3) -> list[np.ndarray]:
    """Which bits make the key of each table, for n fingerprints; any two within `radius` bits share a key.

    64 bits in m blocks, of which `radius` differing bits touch as many at most: each choice
    of m - radius blocks is a key. More blocks make longer keys, so fewer chance meetings, and
    more tables; m is the number with the least work, a row of a table costing ROW_COST
    comparisons.
    """
    m = min(range(radius + 1, 10), key=lambda m: comb(m, radius) * (ROW_COST + n / 2 ** (64 * (m - radius) // m)))
    blocks = np.array_split(np.arange(64), m)
    return [np.concatenate(kept) for kept in combinations(blocks, m - radius)]


def shard_keys(fp: np.ndarray, picks: list[np.ndarray]) -> np.ndarray:
    """Keys of fingerprints (texts, lanes): int64 array (texts, tables); those of different tables differ."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    keys = [bits[:, pick] @ (1 << np.arange(len(pick), dtype=np.int64)) for pick in picks]
    return np.stack(keys, axis=1) * len(picks) + np.arange(len(picks))


def dealt_by_key(prints: DataFrame, picks: list[np.ndarray], cap: int) -> DataFrame:
    """prints(fp, ...) once for every key and pair of blocks, groups together; keys of one row are left out."""
    schema = prints.schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shard_keys(b.column("fp").to_numpy().view(np.uint64)[:, None], picks)
            t = pa.Table.from_batches([b]).take(pa.array(np.repeat(np.arange(b.num_rows), len(picks))))
            yield from t.append_column("shard", pa.array(keys.ravel())).to_batches()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return grouped(in_blocks(prints.mapInArrow(deal, f"{columns}, shard bigint"), ["shard"], "fp", cap), GROUP)


def ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of numbers, or of structs of numbers field by field."""
    whole = column.combine_chunks()
    fields = whole.flatten() if pa.types.is_struct(whole.type) else [whole]
    order = np.lexsort([f.to_numpy(zero_copy_only=False) for f in reversed(fields)])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank


def near(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of pairs of left and right within `radius` bits, a stripe at a time; a fingerprint is no pair with itself."""
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        x, y = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= radius)
        x, y = rows[x], right[y]
        yield x[x != y], y[x != y]


def search(t: pa.Table, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (both ways) of rows of t that lie in one group and within `radius` bits."""
    fp, block, bi, bj = (t.column(c).to_numpy() for c in ("fp", "block", "block_i", "block_j"))
    fp = fp.view(np.uint64)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        every = np.arange(a, z)
        if bi[a] == bj[a]:
            yield from near(fp, every, every, radius)
        else:
            i, j = every[block[a:z] == bi[a]], every[block[a:z] == bj[a]]
            for x, y in near(fp, i, j, radius):
                yield np.concatenate([x, y]), np.concatenate([y, x])


def with_neighbours(prints: DataFrame, picks: list[np.ndarray], radius: int = 3, cap: int = SHARD_ROWS) -> DataFrame:
    """fp of the fingerprints that have another within `radius` bits, with what they have; rows repeat.

    prints: fp (bigint, distinct), seq (numbers or a struct of them), judge (boolean). earlier
    tells of an earlier neighbour, judged of an earlier one whose judge is true. A row of the
    result stands for all pairs of a fingerprint in one group, so no pairs are listed.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, GROUP):
            rank, judge = ranks(t.column("seq")), t.column("judge").to_numpy(zero_copy_only=False).astype(bool)
            any_, earlier, judged = (np.zeros(t.num_rows, dtype=bool) for _ in range(3))
            for x, y in search(t, bounds, radius):
                before = rank[y] < rank[x]
                any_[x] = True
                earlier[x[before]] = True
                judged[x[before & judge[y]]] = True
            at = np.flatnonzero(any_)
            yield pa.RecordBatch.from_arrays([t.column("fp").combine_chunks().take(pa.array(at)), pa.array(earlier[at]), pa.array(judged[at])], names=["fp", "earlier", "judged"])

    return dealt_by_key(prints.select("fp", "seq", "judge"), picks, cap).mapInArrow(look, "fp bigint, earlier boolean, judged boolean")


def pairs(prints: DataFrame, picks: list[np.ndarray], radius: int = 3, cap: int = SHARD_ROWS) -> DataFrame:
    """earlier, later: seq of every pair within `radius` bits, once. prints: seq, fp (distinct)."""
    kind = dict(prints.dtypes)["seq"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, GROUP):
            rank, seq = ranks(t.column("seq")), t.column("seq").combine_chunks()
            shard, fp = t.column("shard").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            for x, y in search(t, bounds, radius):
                x, y = x[rank[x] < rank[y]], y[rank[x] < rank[y]]
                for at in range(0, len(x), 10_000):
                    p, q = x[at : at + 10_000], y[at : at + 10_000]
                    # Listed by the first table in which they share a key.
                    same = shard_keys(fp[p][:, None], picks) == shard_keys(fp[q][:, None], picks)
                    first = same.argmax(axis=1) == shard[p] % len(picks)
                    yield pa.RecordBatch.from_arrays([seq.take(pa.array(p[first])), seq.take(pa.array(q[first]))], names=["earlier", "later"])

    return dealt_by_key(prints.select("seq", "fp"), picks, cap).mapInArrow(look, f"earlier {kind}, later {kind}")
