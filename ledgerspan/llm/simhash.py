"""SimHash near-duplicates with BK-trees (operator 3).

A fingerprint has 64 bits; two texts are near duplicates if their fingerprints differ in at most `radius` bits.
Distinct fingerprints are dealt into shards by parts of their bits such that any two within the radius share a
shard. Each shard is a Burkhard-Keller tree: children are keyed by their integer Hamming distance to the parent, and
a search follows only edges whose distance is within the radius of the query's own distance to the parent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import LOWER_BYTES, kind_of, stage
from ledgerspan.llm.components import connected_components, forest

SHINGLE, RADIUS, HASH_SEED = 3, 2, 42
#: Nodes of one tree on average; larger shards are split into several trees that are all searched.
TREE_NODES = 4096
#: Trees are broadcast only if all of them together have at most so many nodes; beyond, both sides are shuffled.
BROADCAST_NODES, NODE_BYTES = 1_000_000, 13
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the hashes of all word shingles; 0 if there is no word."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(part, HASH_SEED) for part in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), BLOCK):
        block = hashes[begin:begin + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, without a shuffle."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [signed(fingerprint(text.as_py(), shingle)) for text in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind_of(docs, 'doc_id')}, fp long")


# --- trees --------------------------------------------------------------------------------------------------------

def grow_tree(points: list[int]) -> tuple[list[int], list[dict[int, int]]]:
    """A BK-tree over distinct unsigned points: the points, and for each node its children by distance."""
    children: list[dict[int, int]] = [{} for _ in points]
    for k in range(1, len(points)):
        at, point = 0, points[k]
        while True:
            distance = (points[at] ^ point).bit_count()
            below = children[at].get(distance)
            if below is None:
                children[at][distance] = k
                break
            at = below
    return points, children


def pack_tree(points: list[int]) -> bytes:
    """The tree as flat arrays: points, the parent of each, and the distance to the parent (parents come first)."""
    points, children = grow_tree(points)
    parent, distance = np.zeros(len(points), np.int32), np.zeros(len(points), np.uint8)
    for node, below in enumerate(children):
        for d, child in below.items():
            parent[child], distance[child] = node, d
    return np.array(points, np.uint64).tobytes() + parent.tobytes() + distance.tobytes()


def unpack_tree(data: bytes) -> tuple[list[int], list[dict[int, int]]]:
    n = len(data) // NODE_BYTES
    points = np.frombuffer(data, np.uint64, n).tolist()
    parent = np.frombuffer(data, np.int32, n, 8 * n).tolist()
    distance = np.frombuffer(data, np.uint8, n, 12 * n).tolist()
    children: list[dict[int, int]] = [{} for _ in range(n)]
    for child in range(1, n):
        children[parent[child]][distance[child]] = child
    return points, children


def search_tree(tree: tuple[list[int], list[dict[int, int]]], query: int, radius: int) -> list[int]:
    """All points within the radius of the query."""
    points, children = tree
    found, waiting = [], [0] if points else []
    while waiting:
        node = waiting.pop()
        distance = (points[node] ^ query).bit_count()
        if distance <= radius:
            found.append(points[node])
        below = children[node]
        for d in range(max(distance - radius, 0), distance + radius + 1):
            if d in below:
                waiting.append(below[d])
    return found


# --- shards -------------------------------------------------------------------------------------------------------

def shard_keys(fp: Column, radius: int) -> Column:
    """Keys that any two fingerprints within the radius have one of in common.

    The bits form radius + 2 parts; at most `radius` of them differ, so two are equal: one key per pair of parts.
    """
    parts = radius + 2
    edges = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(parts)]
    keys = [F.struct(F.lit(n).alias("pair"), fp.bitwiseAND(F.lit(signed(masks[a] | masks[b]))).alias("bits"))
            for n, (a, b) in enumerate(combinations(range(parts), 2))]
    return F.explode(F.array(*keys))


def near_links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp): of the links found, a spanning forest of each task.

    Shards with one member need no tree. A shard of more than `tree_nodes` members becomes several trees by a
    hash, so that no task has to hold a shard; every query of the shard searches each of them.
    """
    sharded = distinct.select("fp", shard_keys(F.col("fp"), radius).alias("shard"))
    sizes = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(sharded.join(sizes, "shard").select(
        F.xxhash64("shard").alias("shard"), "fp",
        F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tree_nodes)).alias("tree")), "simhash-shards")
    grouped = members.groupBy("shard", "tree").agg(F.collect_list("fp").alias("points"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack_tree(sorted(p % (1 << 64) for p in points)) for points in batch.column("points").to_pylist()]
            yield pa.record_batch([batch.column("shard"), batch.column("points"), pa.array(packed, pa.binary())],
                                  names=["shard", "points", "packed"])

    schema = "shard long, points array<long>, packed binary"
    trees = stage(grouped.select("shard", "points").mapInArrow(build, schema), "simhash-trees")
    nodes = trees.agg(F.sum(F.octet_length("packed") / NODE_BYTES)).first()[0] or 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for batch in batches:
            a, b = [], []
            for queries, data in zip(batch.column("points").to_pylist(), batch.column("packed").to_pylist()):
                tree = unpack_tree(data)
                for fp in queries:
                    for point in search_tree(tree, fp % (1 << 64), radius):
                        a.append(fp)
                        b.append(signed(point))
            kept = forest(a, b, parent)
            yield pa.record_batch([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())],
                                  names=["a", "b"])

    reach = trees.select("shard", "packed")
    asked = trees.select("shard", "points").join(F.broadcast(reach) if nodes <= BROADCAST_NODES else reach, "shard")
    return asked.select("points", "packed").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    Equal fingerprints meet in a partial aggregate, so a class of copies is one node however large. Texts without
    a word have fingerprint 0 and link like others; null counts as empty. component_id is the smallest
    non-null doc_id reachable, null only if a whole component has none. Repeated rows each get a row; an empty
    table gives an empty result.
    """
    prints = stage(fingerprints(docs, shingle), "simhash-fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_links(classes.select("fp"), radius))
    placed = classes.join(parts, classes["fp"] == parts["id"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part"))
    placed = stage(placed, "simhash-parts")
    roots = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(roots, "part").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each component the document with the smallest doc_id; columns as they came.

    Rows with the same doc_id are one document and stay together. Rows without one can't be told apart and stay.
    """
    found = near_duplicates(docs, shingle, radius)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
