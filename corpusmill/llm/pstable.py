"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised, projected on Gaussian directions, shifted and cut into cells of
width `width`; `directions` cell numbers hashed together name a bucket, and every vector
goes to one bucket in each of `tables` tables. For unit vectors a cosine of c is a
distance of sqrt(2 - 2c), so near vectors share cells more often than others. All pairs
that share a bucket are then compared by cosine in double precision.

The number of directions grows with the logarithm of the number of vectors, so that
unrelated ones (at distance 1.41 they keep a cell with probability 0.486) rarely share a
bucket at any size, and the number of tables grows with it, so that a pair at the least
cosine is missed by all tables with probability `miss`; nearer pairs are missed far less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, erfc, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.blocks import Forest, grouped, groups, in_blocks
from corpusmill.llm.components import components
from corpusmill.sources.store import remove, written

#: Seed of the projections and shifts.
SEED = 8191
#: Rows compared at once, which bounds a task's memory.
STRIPE = 64


def keeps_cell(distance: float, width: float) -> float:
    """The probability that two vectors at a distance fall into one cell of a projection."""
    r = width / distance
    return 1 - erfc(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    """How many tables and directions there are, and how wide a cell is."""

    tables: int
    directions: int
    width: float

    @classmethod
    def for_vectors(cls, n: int, least: float, miss: float, width: float) -> Tables:
        directions = ceil(log(4 * max(n, 100)) / -log(keeps_cell(sqrt(2), width)))
        together = keeps_cell(sqrt(max(2 - 2 * least, 1e-6)), width) ** directions
        return cls(ceil(log(miss) / log(1 - together)), directions, width)

    def keys(self, unit: np.ndarray, first: int | None = None) -> np.ndarray:
        """The 32-bit bucket of each unit vector in each table, or in the first ones: int32 array (vectors, tables)."""
        n = self.tables if first is None else first
        a, shift, mult = projections(unit.shape[1], self.tables, self.directions, self.width)
        used = n * self.directions
        cells = np.floor((unit @ a[:, :used] + shift[:used]) / self.width).astype(np.int64).astype(np.uint64).reshape(len(unit), n, self.directions)
        h = (cells * mult[:n]).sum(axis=2, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


@lru_cache(maxsize=4)
def projections(dim: int, tables: int, directions: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (dim, tables * directions), shifts, and odd multipliers that hash cells; fixed by a seed."""
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * directions)), rng.uniform(0, width, tables * directions), rng.integers(0, 2**63, (tables, directions), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one, in double precision; squares of huge or tiny components stay finite."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a list column, at most 512 of one length at a time."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        pick = np.flatnonzero(lengths == dim)
        for at in range(0, len(pick), 512):
            rows = pick[at : at + 512]
            yield rows, flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)


def can_link() -> Column:
    """Whether a row's vector can link: not null or empty, all components finite and not all zero."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(e, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def compare(unit: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, least: float, layout: Tables) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between rows `left` and rows `right` of a group, seen first in this table.

    A pair that shares a bucket of an earlier table was counted there; only rows that have a
    partner get their buckets worked out. Returns the weight of the partners of each row, and
    star edges. left is right: each pair once.
    """
    partners, forest = np.zeros(len(unit), dtype=np.int64), Forest(len(unit))
    same = left is right
    keys = np.zeros((len(unit), 0), dtype=np.int32)
    known = np.zeros(len(unit), dtype=bool)
    for at in range(0, len(left), STRIPE):
        rows = left[at : at + STRIPE]
        x, y = np.nonzero(unit[rows] @ unit[right].T >= least)
        if same:
            x, y = x[(late := y > x + at)], y[late]
        x, y = rows[x], right[y]
        if table and len(x):
            if not keys.shape[1]:
                keys = np.zeros((len(unit), table), dtype=np.int32)
            new = np.unique(np.concatenate([x, y]))
            new = new[~known[new]]
            for k in range(0, len(new), 256):
                keys[new[k : k + 256]] = layout.keys(unit[new[k : k + 256]], table)
            known[new] = True
            fresh = np.concatenate([~(keys[x[k : k + 65536]] == keys[y[k : k + 65536]]).any(axis=1) for k in range(0, len(x), 65536)])
            x, y = x[fresh], y[fresh]
        np.add.at(partners, x, weight[y])
        np.add.at(partners, y, weight[x])
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            forest.link(p, q)
    return partners, forest.stars()


def embedding_links(vectors: DataFrame, least: float = 0.95, miss: float = 0.001, width: float = 2.0, cap: int = 2048) -> DataFrame:
    """Cosine links among vectors: vec_id, n_links, component_id, kept, one row per row of vectors.

    vectors: vec_id, embedding and any others, which are ignored. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and neither do
    vectors of different lengths. Equal vectors link with each other (cosine one), repeated
    rows included; they are searched as one. n_links counts other rows; component_id is the
    smallest vec_id reachable, the row's own included; kept says whether it is the row's
    own. A null vec_id gives null component_id and kept unless it reaches another id. An
    empty table gives no rows.
    """
    base = vectors.select("vec_id", "embedding")
    # Equal vectors are one node from here on; -0.0 and 0.0 are made equal first.
    zero = F.lit(0.0).cast(dict(base.dtypes)["embedding"].removeprefix("array<").removesuffix(">"))
    clean = base.where(can_link()).withColumn("embedding", F.transform("embedding", lambda x: x + zero)).withColumn("name", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b")))
    kinds = clean.groupBy("name").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"))
    # Numbers given as the table is written are fixed and unique at any size.
    node_of, node_path = written(kinds.withColumn("node", F.monotonically_increasing_id()), "vectors")

    layout = Tables.for_vectors(node_of.count(), least, miss, width)
    tables = np.arange(layout.tables, dtype=np.int32)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, v in by_length(b.column(1)):
                keys = layout.keys(units(v))
                node = b.column(0).take(pa.array(np.repeat(rows, len(tables))))
                n = len(node)
                yield pa.RecordBatch.from_arrays([node, pa.array(np.full(n, v.shape[1], dtype=np.int32)), pa.array(np.tile(tables, len(rows))), pa.array(keys.ravel())], names=["node", "dim", "tbl", "bucket"])

    keys = ["dim", "tbl", "bucket", "block_i", "block_j"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, keys):
            node, copies, block, bi, bj, tbl, dims = (t.column(c).to_numpy() for c in ("node", "copies", "block", "block_i", "block_j", "tbl", "dim"))
            flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            place = np.concatenate(([0], np.cumsum(dims, dtype=np.int64)))
            us, vs, ns = [], [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                unit = units(flat[place[a] : place[z]].astype(np.float64).reshape(z - a, -1))
                every = np.arange(z - a)
                left, right = (every, None) if bi[a] == bj[a] else (every[block[a:z] == bi[a]], every[block[a:z] == bj[a]])
                partners, stars = compare(unit, copies[a:z], left, left if right is None else right, int(tbl[a]), least, layout)
                up = dict(stars)
                for x in np.flatnonzero(partners).tolist():
                    us.append(node[a + x])
                    vs.append(node[a + up.get(x, x)])
                    ns.append(partners[x])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], names=["u", "v", "n"])

    rows = node_of.select("node", "embedding").mapInArrow(bucket, "node bigint, dim int, tbl int, bucket int")
    # Vectors join when buckets of one row are gone.
    dealt = in_blocks(rows, ["dim", "tbl", "bucket"], "node", cap).join(node_of.select("node", "copies", "embedding"), "node")
    dealt = grouped(dealt, keys)
    found, found_path = written(dealt.mapInArrow(check, "u bigint, v bigint, n bigint"), "cosine-links")
    root_of = components(found.select("u", "v"))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    rooted, rooted_path = written(node_of.drop("embedding").join(counts, "node", "left").join(root_of, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    # Written as both sides of the joins below, so that a giant component's root can be split.
    smallest, smallest_path = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named, _ = written(rooted.join(smallest, "root").select("name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "groups")
    remove(vectors.sparkSession, node_path, found_path, rooted_path, smallest_path)
    linked = clean.select("vec_id", "name").join(named, "name").select("vec_id", "n_links", "component_id")
    return linked.union(base.where(~can_link()).select("vec_id", F.lit(0).cast("bigint"), "vec_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
