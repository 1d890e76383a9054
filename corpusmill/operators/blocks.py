"""Buckets in bounded blocks, and Arrow batches cut at the ends of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.store import written


def in_blocks(rows: DataFrame, keys: list[str], by: str, cap: int, root_of: DataFrame | None = None, across: bool = True) -> DataFrame:
    """Deal the rows of each bucket to pairs of blocks of about `cap` rows.

    Buckets of one row are left out. A bucket of at most `cap` rows is one group with
    block_i = block_j = 0. A larger one is cut into g blocks by a hash of the column `by`,
    and each row goes to its block's g pairs, so any two rows of a bucket meet in one
    group and no group holds over about two blocks, however large the bucket is. Adds
    block (the row's own), block_i and block_j.

    With root_of (`by`, root; every value of `by` once), rows of equal root need not meet: two
    blocks that hold the same root only are no pair, and such a block is none with itself.
    Without across, a row goes to its own block only, and rows that lie in one block in one
    bucket may lie apart in another.
    """
    # Written, so that the join below reads two plain exchanges and can split a hot bucket.
    sizes, _ = written(rows.groupBy(*keys).agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1"), "bucket-sizes")
    g = F.ceil(F.col("bucket_rows") / cap).cast("int")
    if not across:
        block = own_block([by, *keys], g)
        return rows.join(sizes, keys).withColumn("block", block).withColumns({"block_i": F.col("block"), "block_j": F.col("block")}).drop("bucket_rows")
    dealt = rows.join(sizes, keys).withColumn("block", own_block([by], g))
    others = F.sequence(F.lit(0), g - 1)
    large = sizes.where(F.col("bucket_rows") > cap)
    if root_of is not None and not large.isEmpty():
        members = rows.join(large, keys).withColumn("block", own_block([by], g)).join(root_of, by)
        only = members.groupBy(*keys, "block").agg(F.when(F.min("root") == F.max("root"), F.min("root")).alias("root"))
        blocks = only.groupBy(*keys).agg(F.collect_list(F.struct("block", "root")).alias("blocks")).withColumn("own", F.explode("blocks"))
        differ = F.filter("blocks", lambda x: ~F.coalesce(x["root"] == F.col("own.root"), F.lit(False)))["block"]
        partners, _ = written(blocks.select(*keys, "own.block", differ.alias("partners")), "partners")
        dealt = dealt.join(partners, [*keys, "block"], "left")
        others = F.coalesce("partners", others)
    return (
        dealt.withColumn("other", F.explode(others))
        .withColumn("block_i", F.least("block", "other"))
        .withColumn("block_j", F.greatest("block", "other"))
        .drop("other", "bucket_rows", "partners")
    )


def own_block(by: list[str], g: Column) -> Column:
    return F.pmod(F.xxhash64(*by), g).cast("int")


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bring equal keys together, in order, for a mapInArrow that reads groups()."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys, tables of whole groups with the groups' limits.

    Yields (table, bounds): group k has rows bounds[k] to bounds[k + 1]. Many small groups
    come in one table, which spares the cost of a call for each.
    """
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = pa.concat_tables([held, t]) if held is not None else t
        b = bounds(t)
        if len(b) > 2:
            yield t.slice(0, b[-2]).combine_chunks(), b[:-1]
        held = t.slice(b[-2])
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


class Forest:
    """Union-find over 0..n-1 that keeps the smallest index as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """(member, root) of every member that is not a root."""
        return [(x, r) for x in range(len(self.up)) if (r := self.find(x)) != x]
