"""SimHash near-duplicate groups, searched with BK-trees.

Every text gets a fingerprint: each shingle of words is hashed, and a bit is set where
over half of the hashes have it. Two fingerprints link when at most `radius` bits differ,
and a group is a connected component of links.

Distinct fingerprints are dealt into shards by several keys. A shard becomes a BK-tree:
a node's children are keyed by their integer Hamming distance to it, and a search follows
only the edges whose key lies within the radius of its own distance. A broadcast of every
shard tree would grow with the corpus, so a shard's tree and its queries meet in the task
that holds the shard, and shards over a bound are cut into blocks that meet in pairs.
For 64 bits and radius 3 the bits are cut into blocks and the keys are all choices of all but
three blocks: three differing bits leave the blocks of one choice untouched, so no link is
lost. The number of blocks, and with it the length of the keys, grows with the number of
fingerprints, so that a shard stays small.

Where a least Jaccard similarity is asked for, components of fingerprints are candidates
only: their texts meet again in blocks, and two link if their shingle sets are as similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.blocks import Forest, grouped, groups, in_blocks
from corpusmill.llm.components import components
from corpusmill.operators.hamming import exact_layout, shard_keys
from corpusmill.sources.store import remove, written

#: XXH64 seed of the shingle hash.
SEED = 42
#: Rows of a shard that one task compares with each other.
SHARD_ROWS = 2048
#: Tables that are searched ahead of all, so that the rest need not connect again what these do.
FIRST_TABLES = 8
#: Texts of a group of candidates that one task verifies with each other.
VERIFY_ROWS = 512
#: Shingles whose hashes are held before they are counted.
HELD = 200_000
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of `words` words, of all words if there are fewer; none without words."""
    parts = text.lower().split()  # bytes: A-Z only, and splits at \x20 and \x09-\x0D only
    if not parts:
        return []
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def remix(h: np.ndarray, lane: int) -> np.ndarray:
    """A further 64 bits of each hash; lane 0 is the hash itself."""
    if not lane:
        return h
    h = (h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def majority(hashes: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    """Bitwise strict majority of each text's hashes: uint64 array (texts, lanes); all counts over 0.

    Eight bit positions are summed at once as the bytes of a 64-bit word, over runs of at
    most 255 hashes.
    """
    firsts = np.cumsum(counts) - counts
    runs = -(-counts // 255)
    run_first = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(run_first, runs)
    run_starts = np.repeat(firsts, runs) + 255 * within
    out = np.zeros((len(counts), lanes), dtype=np.uint64)
    for lane in range(lanes):
        h = remix(hashes, lane)
        for j in range(8):
            sums = np.add.reduceat((h >> np.uint64(j)) & ONES, run_starts).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(sums.astype(np.int64), run_first, axis=0)
            bits = (2 * votes > counts[:, None]).astype(np.uint64)
            out[:, lane] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(axis=1, dtype=np.uint64)
    return out


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes: uint64 array."""
    return np.unique(np.array(shingle_hashes(text or b"", words), dtype=np.uint64))


def fingerprints(texts: list[bytes | None], words: int = 3, lanes: int = 1, names: list[bytes] | None = None) -> np.ndarray:
    """Fingerprints of texts: uint64 array (texts, lanes). Null texts and texts without words get zero.

    With names (a list), each shingle counts once, and names receives the 128-bit XXH3 of each
    text's shingle set.
    """
    out = np.zeros((len(texts), lanes), dtype=np.uint64)
    hashes: list[int] = []
    counts: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            out[rows] = majority(np.array(hashes, dtype=np.uint64), np.array(counts), lanes)
        for x in (hashes, counts, rows):
            x.clear()

    for i, text in enumerate(texts):
        found = shingle_hashes(text, words) if text else []
        if names is not None:
            once = np.unique(np.array(found, dtype=np.uint64))
            names.append(xxhash.xxh3_128_digest(once.tobytes()))
            found = once.tolist()
        if found:
            hashes += found
            counts.append(len(found))
            rows.append(i)
            if len(hashes) > HELD:
                flush()
    flush()
    return out


def row_key() -> Column:
    """128 bits that tell documents of one doc_id apart."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b"))


def fingerprinted(docs: DataFrame, words: int, lanes: int, by_set: bool = False) -> DataFrame:
    """docs(doc_id, text) to doc_id, row_key, fp (binary, big-endian lanes), name (binary).

    name tells what counts as equal: the fingerprint, or with by_set the 128-bit name of the
    set of shingles, each of which then counts once.
    """
    pairs = docs.select("doc_id", row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names: list[bytes] | None = [] if by_set else None
            fp = fingerprints(b.column(2).to_pylist(), words, lanes, names)
            raw = [r.tobytes() for r in fp.astype(">u8")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(names if by_set else raw, pa.binary())], names=["doc_id", "row_key", "fp", "name"])

    return pairs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row_key struct<a:bigint,b:bigint>, fp binary, name binary")


def layout(n: int, lanes: int, similarity: float, recall: float) -> list[np.ndarray]:
    """Which bits make the key of each table, for n fingerprints.

    Keys grow with log2(n), so that unrelated fingerprints share few shards at any size, and
    the number of tables grows with them, so that a pair of texts whose shingle sets have
    Jaccard similarity `similarity` meets in one with probability `recall`. Such a pair is at
    an angle whose cosine is 2s / (1 + s), and a bit agrees with probability 1 - angle / pi.
    The choice of bits is fixed by a seed.
    """
    bits = max(10, int(np.ceil(np.log2(max(n, 2))))) + 2
    agree = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - agree**bits)))
    rng = np.random.default_rng(20240607)
    return [rng.choice(64 * lanes, bits, replace=False) for _ in range(tables)]


class BKTree:
    """A BK-tree of (fingerprint, index) under Hamming distance."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, dict[int, int]]] = []

    def add(self, fp: int, index: int) -> None:
        nodes = self.nodes
        new, at = len(nodes), 0
        nodes.append((fp, index, {}))
        if not new:
            return
        while True:
            d = (nodes[at][0] ^ fp).bit_count()
            down = nodes[at][2].setdefault(d, new)
            if down == new:
                return
            at = down

    def search(self, fp: int, radius: int) -> list[int]:
        """Indexes of the fingerprints within `radius`."""
        nodes = self.nodes
        found, todo = [], [0] if nodes else []
        while todo:
            other, index, children = nodes[todo.pop()]
            d = (other ^ fp).bit_count()
            if d <= radius:
                found.append(index)
            todo += [child for key, child in children.items() if d - radius <= key <= d + radius]
        return found


def shard_links(fps: list[int], block: list[int], i: int, j: int, radius: int, root: list[int] | None = None) -> list[tuple[int, int]]:
    """Star edges that span the links of one group of a shard.

    A group of one block compares all its rows; a group of two compares across them. Rows of
    equal root count as connected and get no edge for it.
    """
    forest, tree = Forest(len(fps)), BKTree()
    first: dict[int, int] = {}
    at = range(len(fps)) if root is None else [first.setdefault(r, x) for x, r in enumerate(root)]
    if len(first) == 1:
        return []
    if i == j:
        for x, fp in enumerate(fps):
            for y in tree.search(fp, radius):
                forest.link(at[x], at[y])
            tree.add(fp, x)
    else:
        for x, fp in enumerate(fps):
            if block[x] == i:
                tree.add(fp, x)
        for x, fp in enumerate(fps):
            if block[x] == j:
                for y in tree.search(fp, radius):
                    forest.link(at[x], at[y])
    return forest.stars()


def links(distinct: DataFrame, lanes: int, radius: int, picks: list[np.ndarray], cap: int = SHARD_ROWS, root_of: DataFrame | None = None, across: bool = True) -> DataFrame:
    """Edges u, v that connect the same nodes as all links among distinct (node, fp).

    With root_of (node, root), those that connect the same nodes together with it. Without
    across, blocks of large shards are searched in themselves only, and links between are not found.
    """
    rooted = root_of is not None

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shard_keys(unpacked(b.column(1).to_pylist(), lanes), picks)
            node = b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), len(picks))))
            yield pa.RecordBatch.from_arrays([node, pa.array(keys.ravel())], names=["node", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, ["shard", "block_i", "block_j"]):
            node = t.column("node").to_numpy()
            fps = [int.from_bytes(x, "big") for x in t.column("fp").to_pylist()]
            block, bi, bj = (t.column(c).to_pylist() for c in ("block", "block_i", "block_j"))
            root = t.column("root").to_pylist() if rooted else None
            u, v = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for x, y in shard_links(fps[a:z], block[a:z], bi[a], bj[a], radius, root and root[a:z]):
                    u.append(node[a + x])
                    v.append(node[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = distinct.select("node", "fp").mapInArrow(shard, "node bigint, shard bigint")
    known = distinct.select("node", "fp")
    if rooted:
        known, _ = written(known.join(root_of, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    # Fingerprints join when shards of one row are gone.
    dealt = in_blocks(rows, ["shard"], "node", cap, known.select("node", "root") if rooted else None, across).join(known, "node")
    return grouped(dealt, ["shard", "block_i", "block_j"]).mapInArrow(search, "u bigint, v bigint")


def linked(distinct: DataFrame, lanes: int, radius: int, picks: list[np.ndarray], cap: int = SHARD_ROWS, first: int = FIRST_TABLES) -> DataFrame:
    """node, root: components of the links among distinct (node, fp).

    Members of one group share a key in most tables, so each of them would get an edge from every
    table and every pair of blocks. With many tables a few come first, in single blocks; what they
    connect need not be connected again, and all tables and pairs of blocks look for the rest. No
    pair of different roots that shares a key goes unseen.
    """
    if len(picks) <= 2 * first:
        return components(links(distinct, lanes, radius, picks, cap))
    root_of = components(links(distinct, lanes, radius, picks[:first], cap, across=False))
    more = links(distinct, lanes, radius, picks, cap, root_of)
    return components(more.union(root_of.select("node", "root")))


def unpacked(fps: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), dtype=">u8").reshape(-1, lanes).astype(np.uint64)


def similar_links(sets: list[np.ndarray], fps: np.ndarray, block: np.ndarray, i: int, j: int, radius: int, least: float) -> list[tuple[int, int]]:
    """Star edges that span the pairs of one group whose sets have Jaccard similarity `least`.

    Pairs that are connected already need no look. A group of one block compares all its
    rows; a group of two compares across them.
    """
    size = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    for x in range(1, len(sets)):
        apart = np.bitwise_count(fps[:x] ^ fps[x]).sum(axis=1, dtype=np.int64)
        near = (apart <= radius) & (np.minimum(size[:x], size[x]) >= least * np.maximum(size[:x], size[x]) - 1e-9) & (root[:x] != root[x])
        if i != j:
            near &= block[:x] != block[x]
        found = np.flatnonzero(near)
        for y in found[np.argsort(apart[found], kind="stable")].tolist():
            if root[x] == root[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= least * (size[x] + size[y] - both) - 1e-9:
                root[root == max(root[x], root[y])] = min(root[x], root[y])
    return [(x, r) for x, r in enumerate(root.tolist()) if r != x]


def verified(docs: DataFrame, distinct: DataFrame, candidates: DataFrame, words: int, lanes: int, radius: int, least: float, cap: int = VERIFY_ROWS) -> tuple[DataFrame, str]:
    """Edges u, v among the nodes of each component of candidates(node, root) whose shingle sets are similar.

    Also returns the path of a table that they are read from.
    """
    keyed = docs.select(row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    members = distinct.join(candidates, "node").select("node", "root", "fp", "row_key")
    rows, path = written(keyed.join(members, "row_key").drop("row_key").dropDuplicates(["node"]), "candidates")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches, ["root", "block_i", "block_j"]):
            node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
            bi, bj = (t.column(c).to_pylist() for c in ("block_i", "block_j"))
            u, v = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = t.slice(a, z - a)
                sets = [shingle_set(x.as_py(), words) for x in part.column("text")]
                for x, y in similar_links(sets, unpacked(part.column("fp").to_pylist(), lanes), block[a:z], bi[a], bj[a], radius, least):
                    u.append(node[a + x])
                    v.append(node[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return grouped(in_blocks(rows, ["root"], "node", cap), ["root", "block_i", "block_j"]).mapInArrow(verify, "u bigint, v bigint"), path


def near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 1, radius: int = 3, similarity: float | None = None, recall: float = 0.95, cap: int = SHARD_ROWS, least: float | None = None) -> DataFrame:
    """Group near copies: doc_id, row_key, fp (binary), root (bigint, one for each group), component_id.

    docs: doc_id, text and any others, which are ignored. component_id is the smallest
    doc_id of the group, the document itself included; null ids don't count, and a group
    of null ids only has a null component_id. Null texts, empty texts and texts without
    words all have fingerprint zero and link like any other. Repeated rows stay repeated.
    An empty table gives no rows.

    similarity=None searches 64-bit fingerprints exactly within 3 bits. Otherwise shards are
    laid out so that texts of that similarity meet with probability `recall`, more alike ones
    with a higher one, and `radius` decides; with `least`, it finds candidates only, and texts
    link if their sets of shingles have a Jaccard similarity of `least`.
    """
    if similarity is None and (lanes, radius > 3) != (1, False):
        raise ValueError("a search without a similarity is exact for one lane and radius 3 at most")
    spark = docs.sparkSession
    prints, _ = written(fingerprinted(docs, words, lanes, least is not None), "fingerprints")
    one = F.min(F.struct("row_key", "fp"))
    named = prints.groupBy("name").agg(F.min("doc_id").alias("first_id"), one.alias("one"))
    # Numbers given as the table is written are fixed and unique at any size.
    distinct, distinct_path = written(named.select("name", "first_id", "one.*", F.monotonically_increasing_id().alias("node")), "distinct")
    n = distinct.count()
    picks = exact_layout(n, radius) if similarity is None else layout(n, lanes, similarity, recall)
    root_of = linked(distinct, lanes, radius, picks, cap)
    paths = [distinct_path]
    if least is not None:
        edges, path = verified(docs, distinct, root_of, words, lanes, radius, least)
        root_of = components(edges)
        paths.append(path)
    rooted, path = written(distinct.select("node", "name", "first_id").join(root_of, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "rooted")
    paths.append(path)
    # Written as both sides of the joins below, so that a giant group's root can be split.
    smallest, path = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    paths.append(path)
    name_of, _ = written(rooted.join(smallest, "root").select("name", "root", "component_id"), "groups")
    remove(spark, *paths)
    return prints.join(name_of, "name").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, grouped_docs: DataFrame) -> DataFrame:
    """The rows of docs that represent their group: its smallest doc_id, ties by row_key.

    Columns stay as they are; of fully repeated rows one stays.
    """
    firsts = grouped_docs.groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("w")).select(F.col("w.row_key").alias("key"))
    # The row travels as a struct, so names cannot clash; of one key's rows any is as good.
    whole = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"))
    return whole.join(firsts, "key").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
