"""Connected components by alternating star contraction, with no driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.store import remove, written


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an edge list with the smallest node they can reach.

    edges: columns u, v (bigint); direction, repeats and loops do not matter, rows
    with a null end are ignored. Returns node, root for every node that has an edge to
    another one, root included. Empty edges give an empty result.

    Each round connects every node's larger neighbours to the smallest node around it
    (large star), then its smaller ones (small star); the number of rounds grows with
    the logarithm of the graph's width. A round's edges are written to the shared
    folder, so lost executors cost one round at most.
    """
    spark = edges.sparkSession
    tidy = edges.where("u <> v").select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("p")).distinct()
    now, path = written(tidy, "edges")
    before = signature(now)
    while before[0]:
        large, least_path = large_star(now)
        middle, middle_path = written(large, "edges")
        small, smallest_path = small_star(middle)
        after, new_path = written(small, "edges")
        remove(spark, path, least_path, middle_path, smallest_path)
        now, path = after, new_path
        current = signature(now)
        if current == before:
            break
        before = current
    return now.select(F.col("c").alias("node"), F.col("p").alias("root")).union(now.select("p", "p").distinct())


def signature(edges: DataFrame) -> tuple:
    """Row count and order-free hash; equal before and after the last round."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("c", "p"))).first())


# The least neighbours are written in both steps: a join of two plain exchanges is one that
# adaptive execution can split, and a large group's centre has an edge to every member.


def large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Connect each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.select(F.col("c").alias("a"), F.col("p").alias("b")).union(edges.select("p", "c"))
    least, path = written(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("c"), F.least("a", "m").alias("p")).distinct(), path


def small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least, path = written(edges.groupBy("c").agg(F.min("p").alias("m")), "least")
    others = edges.join(least, "c").where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p"))
    return others.union(least.select("c", F.col("m").alias("p"))).distinct(), path
