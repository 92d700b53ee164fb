"""Embedding near-duplicates with hierarchical navigable small-world graphs (operator 6).

Distinct vectors are dealt into shards by a hash. Each shard is a graph of several levels, built in one task; every
vector searches every shard. What the search reaches is verified by the cosine in double precision. The beam is
widened until an audit against brute force finds the recall asked for; where no beam passes, all pairs are compared.
Components are the union of all links.

A graph travels as a row per vector, so no row and no batch grows with a shard; what a task holds is bounded by the
bytes of two shards, however many links they have.
"""

from __future__ import annotations

import math
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ledgerspan.llm.common import discard, stage
from ledgerspan.llm.components import connected_components

LINKS, BEAM, BUILD_BEAM = 16, 32, 48
#: Shards at least, and bytes of vectors of a shard at most (on average): a task holds one shard.
LEAST_SHARDS, SHARD_BYTES = 8, 32_000_000
#: Searches and insertions that run side by side in numpy.
SIDE_BY_SIDE = 256
#: Members that the audit looks at first, and those with a link that it must hold; it grows by GROWTH until it does.
AUDIT, LINKED, GROWTH = 256, 128, 4
#: The recall that the audit asks for, and how often the beam may double before all pairs are compared.
RECALL, WIDENINGS = 0.99, 5
#: Similarity below the threshold through which a search still walks from link to link.
MARGIN = 0.05
#: Vectors that a comparison takes at once, and bytes of a batch that leaves a task.
COMPARED, BATCH_BYTES = 4096, 4_000_000
#: Links that wait, cells of a block of rows, and bytes of links that a task holds in memory; more go to a temporary file.
WAITING, BLOCK_CELLS, HELD = 1 << 20, 1 << 23, 32_000_000


def _top(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` largest scores of each row, largest first."""
    if scores.shape[1] > count:
        part = np.argpartition(-scores, count - 1, axis=1)[:, :count]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-scores, axis=1, kind="stable")


def _choose(base: np.ndarray, vectors: np.ndarray, candidates: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """For each row `count` neighbours out of the candidates (-1: none), nearest first.

    A candidate nearer to a chosen neighbour than to the row itself waits: links then lead in different
    directions. The nearest of those waiting fill what is left.
    """
    order = np.argsort(-scores, axis=1, kind="stable")
    candidates, scores = np.take_along_axis(candidates, order, 1), np.take_along_axis(scores, order, 1)
    points = vectors[candidates]
    between = points @ points.transpose(0, 2, 1)
    valid = candidates >= 0
    chosen = np.zeros(candidates.shape, bool)
    for k in range(candidates.shape[1]):
        covered = (chosen & (between[:, k, :] > scores[:, k, None])).any(1)
        chosen[:, k] = valid[:, k] & ~covered & (chosen.sum(1) < count)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
    best = np.argsort(rank, axis=1)[:, :count]
    out = np.take_along_axis(np.where(valid, candidates, -1), best, 1)
    if out.shape[1] < count:
        out = np.pad(out, ((0, 0), (0, count - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


class Graph:
    """Vectors of unit length and, for each level, the neighbours of its members (-1: none).

    The table of a level ends with its last member, so it is small where vectors come by falling level.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, neighbours: list[np.ndarray], entry: int) -> None:
        self.vectors, self.levels, self.neighbours, self.entry = vectors, levels, neighbours, entry

    # -- search
    def beam(self, queries: np.ndarray, starts: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the `width` nearest members of the level that a best-first search reaches, per query."""
        links, count = self.neighbours[level], len(queries)
        seen = np.zeros((count, len(links) + 1), bool)
        rows = np.arange(count)
        found = np.full((count, width), -1, np.int64)
        scores = np.full((count, width), -np.inf, np.float32)
        open_ = np.zeros((count, width), bool)
        found[:, 0], open_[:, 0] = starts, True
        scores[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[starts])
        seen[rows, starts] = True
        seen[:, -1] = True  # place -1
        steps = max(1, min(4, width // 8))
        active = rows
        while len(active):
            ranked = np.where(open_[active], scores[active], -np.inf)
            take = _top(ranked, steps)
            usable = np.isfinite(np.take_along_axis(ranked, take, 1))
            more = usable.any(1)
            active, take, usable = active[more], take[more], usable[more]
            if not len(active):
                break
            open_[active[:, None], take] &= ~usable
            heads = np.where(usable, found[active[:, None], take], -1)
            near = np.where((heads >= 0)[:, :, None], links[heads], -1).reshape(len(active), -1)
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            # a place reached twice in one step counts once
            order = np.argsort(near, axis=1, kind="stable")
            ordered = np.take_along_axis(near, order, 1)
            twice = np.zeros(near.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~twice
            near_scores = np.full(near.shape, -np.inf, np.float32)
            at, column = np.nonzero(fresh)
            near_scores[at, column] = np.einsum("nd,nd->n", queries[active[at]], self.vectors[near[at, column]])
            all_scores = np.concatenate([scores[active], near_scores], 1)
            all_found = np.concatenate([found[active], near], 1)
            all_open = np.concatenate([open_[active], fresh], 1)
            best = _top(all_scores, width)
            scores[active] = np.take_along_axis(all_scores, best, 1)
            found[active] = np.where(np.isfinite(scores[active]), np.take_along_axis(all_found, best, 1), -1)
            open_[active] = np.take_along_axis(all_open, best, 1) & (found[active] >= 0)
        return found, scores

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Nearest place found on the level above `down_to`, greedily from the top."""
        at = np.full(len(queries), self.entry, np.int64)
        for level in range(len(self.neighbours) - 1, down_to, -1):
            at = self.beam(queries, at, level, 4)[0][:, 0]
        return at

    def within(self, queries: np.ndarray, threshold: float, width: int) -> Iterator[np.ndarray]:
        """Places with a score of at least `threshold`, per query: the beam's, and all that links lead to from these.

        The walk goes on through places down to threshold - MARGIN, so a group of copies larger than the beam is found whole.
        """
        found, scores = self.beam(queries, self.descend(queries, 0), 0, width)
        for query, own, score in zip(queries, found, scores):
            near = own[score >= threshold - MARGIN]
            if len(near) < width // 2:
                yield own[score >= threshold]
                continue
            seen = np.zeros(len(self.vectors) + 1, bool)
            seen[-1] = True
            seen[own] = True
            hits, front = [own[score >= threshold]], near
            while len(front):
                reached = np.unique(self.neighbours[0][front])
                reached = reached[~seen[reached]]
                seen[reached] = True
                values = self.vectors[reached] @ query
                hits.append(reached[values >= threshold])
                front = reached[values >= threshold - MARGIN]
            yield np.concatenate(hits)

    # -- building
    @staticmethod
    def levels_of(seed: np.ndarray, links: int = LINKS) -> np.ndarray:
        """The highest level of each vector, from a hash of it."""
        uniform = (seed.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
        return np.minimum(np.floor(-np.log(np.maximum(uniform, 1e-12)) / np.log(links)), 8).astype(np.int64)

    @staticmethod
    def build(vectors: np.ndarray, seed: np.ndarray, links: int = LINKS, width: int = BUILD_BEAM) -> "Graph":
        """Inserts the vectors (unit length) in rounds that at most double the graph; seed: a hash of each, for its level."""
        count = len(vectors)
        levels = Graph.levels_of(seed, links)
        order = np.argsort(-levels, kind="stable")[:1].tolist()
        rest = np.setdiff1d(np.arange(count), order)
        order = np.concatenate([order, rest[np.argsort(seed[rest], kind="stable")]]).astype(np.int64)
        top = int(levels[order[0]])
        neighbours = [np.full((int(np.flatnonzero(levels >= level)[-1]) + 1, 2 * links if level == 0 else links), -1, np.int32)
                      for level in range(top + 1)]
        graph = Graph(vectors, levels, neighbours, int(order[0]))
        done = 1
        while done < count:
            batch = order[done:done + min(SIDE_BY_SIDE, max(done, 16))]
            graph._insert(batch, width)
            done += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, width: int) -> None:
        queries = self.vectors[batch]
        at = np.full(len(batch), self.entry, np.int64)
        for level in range(len(self.neighbours) - 1, -1, -1):
            own = self.levels[batch] >= level
            if not own.any():
                at = self.beam(queries, at, level, 4)[0][:, 0]
                continue
            found, scores = self.beam(queries, at, level, width)
            at = found[:, 0]
            members = np.flatnonzero(own)
            # those inserted side by side also see each other
            peers = np.broadcast_to(batch[members], (len(members), len(members)))
            peer_scores = queries[members] @ queries[members].T
            np.fill_diagonal(peer_scores, -np.inf)
            keep = _top(peer_scores, min(width, len(members)))
            candidates = np.concatenate([found[members], np.take_along_axis(peers, keep, 1)], 1)
            all_scores = np.concatenate([scores[members], np.take_along_axis(peer_scores, keep, 1)], 1)
            candidates = np.where(np.isfinite(all_scores), candidates, -1)
            table = self.neighbours[level]
            chosen = _choose(queries[members], self.vectors, candidates, all_scores, table.shape[1])
            table[batch[members]] = chosen
            self._link_back(table, batch[members], chosen)

    def _link_back(self, table: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the reverse of each new link; full lists are chosen anew."""
        heads, column = np.nonzero(chosen >= 0)
        targets, sources = chosen[heads, column].astype(np.int64), batch[heads]
        known = (table[targets] == sources[:, None]).any(1)
        targets, sources = targets[~known], sources[~known]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        nodes, first, size = np.unique(targets, return_index=True, return_counts=True)
        limit = table.shape[1]
        for begin in range(0, len(nodes), SIDE_BY_SIDE):
            part = slice(begin, begin + SIDE_BY_SIDE)
            own, starts, sizes = nodes[part], first[part], size[part]
            most = int(sizes.max())
            fresh = np.full((len(own), most), -1, np.int64)
            row = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            fresh[row, place] = sources[starts[row] + place]
            candidates = np.concatenate([table[own].astype(np.int64), fresh], 1)
            scores = np.einsum("rd,rkd->rk", self.vectors[own], self.vectors[candidates])
            scores = np.where(candidates >= 0, scores, -np.inf)
            if candidates.shape[1] > 2 * limit:
                best = _top(scores, 2 * limit)
                candidates, scores = np.take_along_axis(candidates, best, 1), np.take_along_axis(scores, best, 1)
            table[own] = _choose(self.vectors[own], self.vectors, candidates, scores, limit)

    # -- storage
    def above(self, place: int) -> bytes | None:
        """The neighbours of a member on all levels but the lowest."""
        return b"".join(x[place].tobytes() for x in self.neighbours[1:self.levels[place] + 1]) or None


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of unit length, in double precision."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)  # no overflow of squares
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def units(raw: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """The same for many vectors, some at a time."""
    out = np.empty(raw.shape, kind)
    for begin in range(0, len(raw), COMPARED):
        out[begin:begin + COMPARED] = unit(raw[begin:begin + COMPARED])
    return out


def scramble(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def drawn(ids: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 of each id, apart from the hash that levels and order of a graph come from."""
    return (scramble(scramble(ids)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def verified(vectors: np.ndarray, places: np.ndarray, query: np.ndarray, threshold: float) -> np.ndarray:
    """Those places whose cosine is at least `threshold`; the sum has the same order from either end of a pair."""
    good = [part[np.einsum("kd,kd->k", vectors[part], np.broadcast_to(query, (len(part), len(query)))) >= threshold]
            for part in (places[begin:begin + COMPARED] for begin in range(0, len(places), COMPARED))]
    return np.concatenate(good) if good else places


def compared(vectors: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """For each query the places of all vectors that it links with, by brute force."""
    for begin in range(0, len(queries), SIDE_BY_SIDE // 4):
        part = queries[begin:begin + SIDE_BY_SIDE // 4]
        found: list[list[np.ndarray]] = [[] for _ in part]
        for first in range(0, len(vectors), COMPARED):
            row, place = np.nonzero(part @ vectors[first:first + COMPARED].T >= threshold - 1e-9)
            some, starts = np.unique(row, return_index=True)
            for k, places in zip(some.tolist(), np.split(first + place, starts[1:])):
                found[k].append(verified(vectors, places, part[k], threshold).astype(np.int32))
        yield from (np.concatenate(x) if x else np.zeros(0, np.int32) for x in found)


def reached(net: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, width: int) -> Iterator[np.ndarray]:
    """For each query the places of the vectors that a search finds and that it links with."""
    for begin in range(0, len(queries), SIDE_BY_SIDE):
        part = queries[begin:begin + SIDE_BY_SIDE]
        for query, places in zip(part, net.within(part.astype(np.float32), threshold - 1e-5, width)):
            yield verified(vectors, places, query, threshold)


class Pairs:
    """Which members of two shards (or of one) are linked: each pair once, whichever end sets it and how often.

    Links wait in a list and are then put away by blocks of rows: as their places, or as the bits of the rectangle
    they span where these are fewer. What exceeds HELD bytes goes to a temporary file, and one block at a time comes back.
    """

    def __init__(self, count: int, other: int, same: bool) -> None:
        self.other, self.same = other, same
        self.height = max(1, min(count, BLOCK_CELLS // max(other, 1)))
        self.fresh, self.waiting, self.held, self.file = [], 0, 0, None
        self.runs: dict[int, list[tuple]] = defaultdict(list)

    def add(self, row: int, places: np.ndarray) -> None:
        if len(places):
            self._gather(row * self.other + places.astype(np.int64))
            if self.same:
                self.add_back(row, places)

    def add_back(self, place: int, rows: np.ndarray) -> None:
        if len(rows):
            self._gather(rows.astype(np.int64) * self.other + place)

    def _gather(self, cells: np.ndarray) -> None:
        self.fresh.append(cells)
        self.waiting += len(cells) + 16  # an array costs as much besides its cells
        if self.waiting >= WAITING:
            self._put_away()

    def _put_away(self) -> None:
        if not self.fresh:
            return
        rows, places = np.divmod(np.unique(np.concatenate(self.fresh)), self.other)
        self.fresh, self.waiting = [], 0
        blocks, starts = np.unique(rows // self.height, return_index=True)
        for block, y, x in zip(blocks.tolist(), np.split(rows, starts[1:]), np.split(places, starts[1:])):
            y = y - block * self.height
            top, left = int(y.min()), int(x.min())
            tall, wide = int(y.max()) - top + 1, int(x.max()) - left + 1
            if tall * wide < 32 * len(y):
                area = np.zeros((tall, wide), bool)
                area[y - top, x - left] = True
                self._keep(block, (top, left, tall, wide), np.packbits(area))
            else:
                self._keep(block, None, (y * self.other + x).astype(np.uint32))

    def _keep(self, block: int, rectangle: tuple | None, data: np.ndarray) -> None:
        if self.held + data.nbytes <= HELD:
            self.held += data.nbytes
            self.runs[block].append((rectangle, data, 0, 0))
            return
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(data.tobytes())
        self.runs[block].append((rectangle, None, at, data.nbytes))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, places) of every row with a link; a row never links with itself."""
        self._put_away()
        for block in sorted(self.runs):
            area = np.zeros((self.height, self.other), bool)
            for rectangle, data, at, size in self.runs[block]:
                if data is None:
                    data = np.frombuffer(self._read(at, size), np.uint8 if rectangle else np.uint32)
                if rectangle:
                    top, left, tall, wide = rectangle
                    area[top:top + tall, left:left + wide] |= np.unpackbits(data, count=tall * wide).reshape(tall, wide).view(bool)
                else:
                    area.reshape(-1)[data] = True
            for k in np.flatnonzero(area.any(1)).tolist():
                row, places = block * self.height + k, np.flatnonzero(area[k])
                if self.same:
                    places = places[places != row]
                if len(places):
                    yield row, places


class Trees:
    """A spanning forest of links between numbered members, as it grows."""

    def __init__(self, count: int) -> None:
        self.parent = np.arange(count)

    def join(self, members: np.ndarray) -> np.ndarray:
        """Links all members; returns the roots of the trees that became one, if more than one, else nothing."""
        roots = self.parent[members]
        while (roots != (above := self.parent[roots])).any():
            roots = above
        self.parent[members] = roots
        roots = np.unique(roots)
        self.parent[roots] = roots[0]
        return roots if len(roots) > 1 else roots[:0]


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows that `_binary` made bytes of."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(len(column), -1)


class Shard:
    """The members of a shard, put in their places as rows bring them."""

    def __init__(self, size: int, dim: int) -> None:
        self.ids, self.weights = np.empty(size, np.int64), np.empty(size, np.int64)
        self.vectors, self.links, self.above = np.empty((size, dim)), np.empty((size, 2 * LINKS), np.int32), {}

    def add(self, rows: pa.RecordBatch, kind: type) -> None:
        places = rows.column("place").to_numpy()
        self.ids[places], self.weights[places] = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
        self.vectors[places] = unit(_matrix(rows.column("vector"), kind))
        self.links[places] = _matrix(rows.column("links"), np.int32)
        above = rows.column("above")
        some = np.flatnonzero(above.is_valid().to_numpy(zero_copy_only=False))
        self.above |= {int(places[k]): np.frombuffer(above[k].as_py(), np.int32).reshape(-1, LINKS) for k in some.tolist()}

    def graph(self) -> Graph:
        """The graph; its first member is one of the highest level."""
        neighbours = [self.links]
        for level in range(max(map(len, self.above.values()), default=0)):
            members = [k for k, x in self.above.items() if len(x) > level]
            neighbours.append(np.full((max(members) + 1, LINKS), -1, np.int32))
            neighbours[-1][members] = [self.above[k][level] for k in members]
        return Graph(self.vectors.astype(np.float32), np.zeros(0), neighbours, 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, beam: int = BEAM, shard_bytes: int = SHARD_BYTES,
                    least_shards: int = LEAST_SHARDS, audit: int = AUDIT, recall: float = RECALL, linked: int = LINKED,
                    widenings: int = WIDENINGS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Equal vectors are one member of a graph with their number as weight (a partial aggregate), so thousands of copies cost as
    one. All members are indexed; each searches all shards. A task holds two shards and searches each from the other, so
    a pair that one end finds counts for both. It reports how many vectors each member links with, and of the links
    themselves a spanning forest, which has the same components. Vectors travel in the precision they came in.

    The audit compares links with those of brute force over all members, each pair of members as one link whatever
    its copies. Those asked go to all shards, in groups of two shards' size at most (on average). It begins with about `audit` members, picked by a hash, and grows until `linked` of them have a link or it holds
    all members. Both the share of all their links and the mean share of a member must reach `recall`; otherwise the
    beam doubles, `widenings` times at most, and then all pairs are compared.

    Null or zero vectors, and those with null or non-finite components, link with nothing. Vectors of different
    length never link. Repeated rows each count and each get a row; a null vec_id is kept with the component of its
    vector. component_id is the smallest non-null vec_id of a component, or null. An empty table stays empty.
    """
    usable = (F.coalesce(F.size("embedding"), F.lit(0)) > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding").cast("array<double>")).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    members = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "hnsw-members")
    sizes = members.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length
    bytes_, count = sum(r["dim"] * r["n"] * 8 for r in sizes), sum(r["n"] for r in sizes)
    shards = max(least_shards, -(-bytes_ // shard_bytes))
    dealt = members.select("cid", "n", "v", F.size("v").alias("dim"),
                           F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard"))

    element = vectors.schema["embedding"].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind = np.float32 if single else np.float64
    shard_type = ("dim int, shard int, size int, place int, cid long, n long, drawn double, vector binary, links binary, "
                  "above binary")

    def index(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, shard = (x.as_py() for x in key)
        columns = [(x.column("cid").to_numpy(), x.column("n").to_numpy(),
                    x.column("v").flatten().to_numpy().reshape(-1, dim).astype(kind)) for x in batches]
        ids, weights, raw = (np.concatenate(x) for x in zip(*columns))
        del columns
        order = np.argsort(-Graph.levels_of(scramble(ids)), kind="stable")
        ids, weights, raw = ids[order], weights[order], raw[order]
        graph, count = Graph.build(units(raw, np.float32), scramble(ids)), len(ids)
        step = max(1, BATCH_BYTES // (raw.itemsize * dim))
        for begin in range(0, count, step):
            part = np.arange(begin, min(count, begin + step), dtype=np.int32)
            same = [pa.array(np.full(len(part), x, np.int32)) for x in (dim, shard, count)]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(part), pa.array(ids[part]), pa.array(weights[part]), pa.array(drawn(ids[part])), _binary(raw[part]),
                 _binary(graph.neighbours[0][part]), pa.array([graph.above(k) for k in part.tolist()], pa.binary())],
                ["dim", "shard", "size", "place", "cid", "n", "drawn", "vector", "links", "above"])

    indexed = stage(dealt.groupBy("dim", "shard").applyInArrow(index, shard_type), "hnsw-graphs")
    with_each = indexed.drop("drawn").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>")))
    pairs_of_shards = with_each.withColumns(
        {"low": F.least("shard", "other"), "high": F.greatest("shard", "other")}).drop("other").groupBy("dim", "low", "high")

    def opened(dim: int, batches: Iterator[pa.RecordBatch]) -> list[Shard]:
        """The one or two shards of a task."""
        found: dict[int, Shard] = {}
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for number in np.unique(numbers).tolist():
                rows = batch.filter(pa.array(numbers == number))
                if number not in found:
                    found[number] = Shard(rows.column("size")[0].as_py(), dim)
                found[number].add(rows, kind)
        return [found[x] for x in sorted(found)]

    def found_with(width: int | None) -> DataFrame:
        """Links by searches with a beam of `width`; None: by comparing all pairs.

        a, -1, n, m: rows and members that member a links with, by task; a, b: links that make up a spanning forest.
        """
        def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dim, low, high = (x.as_py() for x in key)
            parts = opened(dim, batches)
            if len(parts) < (1 if low == high else 2):
                return
            one, two = parts[0], parts[-1]
            pairs = Pairs(len(one.ids), len(two.ids), low == high)
            if width is None:
                for row, places in enumerate(compared(two.vectors, one.vectors, threshold)):
                    pairs.add(row, places)
            else:
                for row, places in enumerate(reached(two.graph(), two.vectors, one.vectors, threshold, width)):
                    pairs.add(row, places)
                if low != high:
                    for place, own in enumerate(reached(one.graph(), one.vectors, two.vectors, threshold, width)):
                        pairs.add_back(place, own)
            # members are numbered through both shards
            first = 0 if low == high else len(one.ids)
            ids = one.ids if low == high else np.concatenate([one.ids, two.ids])
            n, m, trees, a, b = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), Trees(len(ids)), [], []
            for row, places in pairs:
                n[row] += two.weights[places].sum()
                m[row] += len(places)
                if low != high:
                    n[first + places] += one.weights[row]
                    m[first + places] += 1
                if len(roots := trees.join(np.append(first + places, row))):
                    a.append(np.full(len(roots) - 1, ids[roots[0]]))
                    b.append(ids[roots[1:]])
            some = np.flatnonzero(m)
            none = np.zeros(sum(map(len, a)), np.int64)
            columns = {"a": [ids[some], *a], "b": [np.full(len(some), -1), *b], "n": [n[some], none], "m": [m[some], none]}
            yield pa.RecordBatch.from_pydict({x: pa.array(np.concatenate(y)) for x, y in columns.items()})

        return stage(pairs_of_shards.applyInArrow(search, "a long, b long, n long, m long"), "hnsw-found")

    def links_of(least: float, most: float) -> DataFrame:
        """a, m: by brute force, how many members each member drawn between the two shares links with, by task."""
        groups = max(1, math.ceil((min(most, 1.0) - least) * shards / 2))
        sent = indexed.where((F.col("drawn") >= least) & (F.col("drawn") < most)).select(
            "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>")).alias("shard"),
            F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(groups)).cast("int").alias("part"), "cid", "vector", F.lit(True).alias("asked"))
        there = indexed.select(
            "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<int>")).alias("part"), "cid", "vector",
            F.lit(False).alias("asked"))

        def count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, raw = {True: [], False: []}, {True: [], False: []}
            for batch in batches:
                asked = batch.column("asked").to_numpy(zero_copy_only=False)
                for side in (True, False):
                    if (asked == side).any():
                        rows = batch.filter(pa.array(asked == side))
                        ids[side].append(rows.column("cid").to_numpy())
                        raw[side].append(_matrix(rows.column("vector"), kind))
            if not (ids[True] and ids[False]):
                return
            (outer_ids, outer), (inner_ids, inner) = (
                (np.concatenate(ids[side]), units(np.concatenate(raw.pop(side)))) for side in (True, False))
            m = np.array([(inner_ids[x] != own).sum() for own, x in zip(outer_ids, compared(inner, outer, threshold))], np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(outer_ids[m > 0]), "m": pa.array(m[m > 0])})

        return sent.unionByName(there).groupBy("dim", "shard", "part").applyInArrow(count_links, "a long, m long")

    truth, share, last = None, min(1.0, audit / max(count, 1)), 0.0
    while True:
        more = stage(links_of(last, share if share < 1 else 2.0), "hnsw-audit")
        truth = more if truth is None else truth.unionByName(more)
        if share >= 1 or truth.select("a").distinct().count() >= linked:
            break
        last, share = share, min(1.0, share * GROWTH)
    truth = truth.groupBy("a").agg(F.sum("m").alias("m"))

    def passes(found: DataFrame) -> bool:
        have = found.where("b = -1").groupBy("a").agg(F.sum("m").alias("have"))
        per = truth.join(have, "a", "left").select("m", F.coalesce("have", F.lit(0)).alias("have"))
        total, mean = per.agg(F.sum("have") / F.sum("m"), F.avg(F.col("have") / F.col("m"))).first()
        return total is None or min(total, mean) >= recall

    found, width = found_with(beam), beam
    for _ in range(widenings):
        if passes(found):
            break
        discard(found)
        width *= 2
        found = found_with(width)
    else:
        if not passes(found):
            discard(found)
            found = found_with(None)
    counts = found.where("b = -1").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b >= 0").select("a", "b"))
    placed = members.select("cid", "least", "n").join(counts, "cid", "left").join(
        parts.withColumnRenamed("id", "cid"), "cid", "left").select(
        "cid", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cid").alias("part"))
    placed = stage(placed, "hnsw-placed")
    roots = placed.groupBy("part").agg(F.min("least").alias("root"))
    known = members.select("cid", "v").join(placed.join(roots, "part").select("cid", "n_links", "root"), "cid")
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                               F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("root")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

