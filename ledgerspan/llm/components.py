"""Connected components by alternating large and small stars, staged in the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import discard, stage


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); component is the smallest id reachable.

    A round joins each node with the smallest of its neighbours. Both joins are ordinary equi-joins, so
    Spark splits the partition of a hub with very many links; the minimum is a partial aggregate.
    Null ends and self links are ignored; an empty table gives an empty result.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        done = _mark(after)
        discard(edges)
        edges = after
        if done == mark:
            break
        mark = done
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them, to see whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def forest(a, b, parent: dict) -> list:
    """Of links (a, b), those that join two trees of `parent` (a union-find dictionary, updated)."""
    def root(x):
        while x in parent:
            above = parent[x]
            if above in parent:
                parent[x] = parent[above]
            x = above
        return x

    kept = []
    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((x, y))
    return kept
