"""Removal of repeated byte strings by common-prefix intervals of suffix arrays (operator 10).

Every byte covered by a string of `length` bytes that starts anywhere else in the corpus goes. One suffix array over
a corpus fits no machine, so the corpus is first dealt into small groups that provably hold every repeat:

1. Winnowing. In each window of `length` bytes the `anchor`-byte strings with the smallest hash are anchors. The
   choice depends on the window's bytes alone, so the two places of a repeat have an anchor in common, at the
   same offset. What surrounds an anchor (its snippet) holds every window that could have chosen it.
2. Anchors whose hash occurs once are done. Equal snippets of one anchor are repeated as a whole: a count.
3. Different snippets with the same anchor are compared in an enhanced suffix array of their group, whose intervals of
   common prefixes are found by a stack scan; an interval whose members differ in the byte to their left is a
   maximal repeat, with all its places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import kind_of, stage

LENGTH, ANCHOR = 400, 250
#: Snippets that one suffix array holds (300 bytes each); larger groups are counted window by window.
GROUP_LIMIT = 20_000
#: Odd bases of two polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of a text in constant time each, from running sums of code * base^place."""

    codes = _scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))
    powers: dict[int, np.ndarray] = {}
    inverse: dict[int, np.ndarray] = {}

    @classmethod
    def prepare(cls, kind: int, size: int) -> None:
        """Powers of the kind's base and of its inverse for texts below `size` bytes."""
        if size > len(cls.powers.get(kind, ())):
            size = 1 << max(16, int(size).bit_length())
            for tables, base in ((cls.powers, BASES[kind]), (cls.inverse, pow(BASES[kind], -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                tables[kind] = np.cumprod(factors, dtype=np.uint64)

    def __init__(self, text: bytes, kinds: int = 2) -> None:
        n = len(text)
        codes = self.codes[np.frombuffer(text, np.uint8)]
        self.sums = []
        for kind in range(kinds):
            self.prepare(kind, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * self.powers[kind][:n], out=sums[1:])
            self.sums.append(sums)

    def between(self, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        sums = self.sums[kind]
        return _scramble((sums[end] - sums[begin]) * self.inverse[kind][begin])


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick.reduce over every window of that width, from running picks within blocks of the width."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, x[-1], np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n - width + 1], ahead[width - 1:n])


def anchors_of(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, snippet hash, place) of each anchor; of equal smallest hashes in a window all are anchors."""
    n, width = len(text), length - anchor + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = Hashes(text)
    begin = np.arange(n - anchor + 1)
    each = hashes.between(begin, begin + anchor, 0)
    least = _slide(each, width, np.minimum)
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1:width - 1 + len(least)] = least
    place = np.flatnonzero(_slide(around, width, np.maximum) == each)
    first, last = np.maximum(place + anchor - length, 0), np.minimum(place + length, n)
    snippet = hashes.between(first, last, 1) ^ _scramble(((place - first) * (2 * length) + last - place).astype(np.uint64))
    return each[place], snippet, place


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def prefix_intervals(prefixes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of an enhanced suffix array whose common prefix is at least `least`.

    prefixes[k] is the common prefix of the suffixes in places k - 1 and k. A stack holds the open intervals.
    """
    waiting: list[tuple[int, int]] = []
    for k in range(1, len(prefixes) + 1):
        depth, first = (prefixes[k] if k < len(prefixes) else 0), k - 1
        while waiting and waiting[-1][0] > depth:
            deep, first = waiting.pop()
            yield deep, first, k - 1
        if depth >= least and (not waiting or waiting[-1][0] < depth):
            waiting.append((depth, first))


def runs_from(values: list[int], least: int) -> Iterator[range]:
    """The runs of places whose values are all at least `least`."""
    k = 0
    while k < len(values):
        if values[k] < least:
            k += 1
            continue
        first = k
        while k < len(values) and values[k] >= least:
            k += 1
        yield range(first, k)


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, anchor: int = ANCHOR,
                    ) -> list[tuple[int, int] | None]:
    """For each snippet the stretch [begin, end), relative to the anchor's place, that other snippets repeat, or None.

    Every repeat found holds the anchor, so a snippet's repeats make one stretch. lefts are the bytes before the anchor, last one first; rights those behind it. A left-maximal repeat begins where
    two neighbours in the order of lefts part, so only suffixes at these depths are sorted.
    """
    count = len(lefts)
    begins, ends = [0] * count, [0] * count
    by_left = sorted(range(count), key=lefts.__getitem__)
    shared = [common(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])]
    for depth in set(shared):
        for run in runs_from(shared, depth):
            # the suffixes that begin `depth` bytes before the anchor and share these, in order
            ranked = sorted(by_left[run.start:run.stop + 1], key=rights.__getitem__)
            prefixes = [0] + [depth + anchor + common(rights[a], rights[b]) for a, b in zip(ranked, ranked[1:])]
            for extent, first, last in prefix_intervals(prefixes, length):
                members = ranked[first:last + 1]
                before = {lefts[k][depth:depth + 1] for k in members}
                if len(before) > 1 or b"" in before:
                    for k in members:
                        begins[k] = min(begins[k], -depth)
                        ends[k] = max(ends[k], extent - depth)
    return [(b, e) if e else None for b, e in zip(begins, ends)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at:begin])
        at = end
    return b"".join([*kept, text[at:]])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _text_hash(text: Column) -> Column:
    """32 bits that tell rows with the same doc_id and different texts apart."""
    return F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """All rows of docs (doc_id, text) with `th` (32 bits of the text's hash) and `spans`, the merged stretches
    (begin, end) of UTF-8 bytes that repeat.

    Anchors are about one in 75 bytes. They are counted by hash in partial aggregates, so a passage in a third of all
    documents is one row per task. Groups of different snippets are dealt by anchor; one above group_limit is not
    gathered but counted: each window of its snippets becomes a row with a hash, summed in partial aggregates.
    Texts travel once, dealt by document.

    Null counts as the empty text. Rows that repeat each other repeat as texts and are emptied of all 400-byte
    strings; rows with the same doc_id and different texts are different documents. An empty table stays empty.
    """
    side, id_kind = length - anchor, kind_of(docs, "doc_id")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", _text_hash(F.col("text")).alias("th"), text.alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for row, value in enumerate(batch.column("text")):
                h, s, place = anchors_of(value.as_py().encode(), length, anchor)
                order = np.lexsort((place, s, h))
                h, s = h[order], s[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])) if len(h) else order
                parts.append((h[first], s[first], place[order], np.diff(np.append(first, len(h))), np.full(len(first), row)))
            h, s, place, size, rows = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            rows = pa.array(rows.astype(np.int64))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                              pa.array(place.astype(np.int32)))
            yield pa.record_batch([_longs(h), _longs(s), batch.column("doc_id").take(rows), batch.column("th").take(rows),
                                   places], names=["h", "s", "doc_id", "th", "places"])

    # a document's places with the same anchor and snippet, as of a line it repeats, are one row
    anchors = keyed.mapInArrow(find, f"h long, s long, doc_id {id_kind}, th int, places array<int>")
    shared = stage(anchors.groupBy("h").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("h"), "repeats-shared")
    repeated = stage(anchors.join(shared, "h"), "repeats-anchors")
    snippets = repeated.groupBy("h", "s").agg(
        F.sum(F.size("places")).alias("copies"),
        F.min(F.struct("doc_id", "th", F.col("places")[0].alias("place"))).alias("at"))
    # equal snippets repeat as a whole
    alike = snippets.where("copies > 1").select("h", "s")
    whole = repeated.join(alike, ["h", "s"]).select("doc_id", "th", F.explode("places").alias("place")).select(
        "doc_id", "th", F.greatest(F.col("place") - side, F.lit(0)).alias("begin"), (F.col("place") + length).alias("end"))
    # one of each kind of snippet meets the other kinds
    kinds = snippets.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    asked = snippets.join(kinds, "h").groupBy(F.col("at.doc_id").alias("q_id"), F.col("at.th").alias("q_th")).agg(
        F.collect_list(F.struct(F.col("h"), F.col("at.place").alias("place"), (F.col("copies") == 1).alias("single"),
                                (F.col("kinds") > group_limit).alias("large"))).alias("places"))
    same = keyed["doc_id"].eqNullSafe(asked["q_id"]) & (keyed["th"] == asked["q_th"])
    sources = keyed.join(asked, same).select("doc_id", "th", "text", "places")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            texts, places = batch.column("text"), batch.column("places")
            for row in range(len(texts)):
                data = texts[row].as_py().encode()
                for x in places[row].as_py():
                    p = x["place"]
                    rows.append(row)
                    out.append((x["h"], x["large"], x["single"], p, data[max(p - side, 0):p][::-1],
                                data[p + anchor:p + length]))
            h, large, single, place, left, right = zip(*out) if out else ((),) * 6
            rows = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [pa.array(h, pa.int64()), pa.array(large, pa.bool_()), pa.array(single, pa.bool_()),
                 batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(place, pa.int32()),
                 pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["h", "large", "single", "doc_id", "th", "place", "left", "right"])

    # repeated rows (same doc_id and text) would ask twice, which changes nothing
    taken = sources.mapInArrow(
        take, f"h long, large boolean, single boolean, doc_id {id_kind}, th int, place int, left binary, right binary")
    members = F.collect_list(F.struct("single", "doc_id", "th", "place", "left", "right"))
    small = taken.where("not large").groupBy("h").agg(members.alias("members"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, begins, ends = [], [], [], []
            for group in batch.column("members"):
                rows = group.as_py()
                spans = maximal_repeats([x["left"] for x in rows], [x["right"] for x in rows], length, anchor)
                for x, own in zip(rows, spans):
                    if x["single"] and own:
                        ids.append(x["doc_id"])
                        ths.append(x["th"])
                        begins.append(x["place"] + own[0])
                        ends.append(x["place"] + own[1])
            yield pa.record_batch([pa.array(ids, batch.schema.field("members").type.value_type.field("doc_id").type),
                                   pa.array(ths, pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                                  names=["doc_id", "th", "begin", "end"])

    span_schema = f"doc_id {id_kind}, th int, begin int, end int"
    parts = small.select("members").mapInArrow(scan, span_schema)
    large = taken.where("large").select("h", "single", "doc_id", "th", "place", "left", "right")
    # every window of a snippet: `before` bytes left of the anchor, the rest right of it
    windows = large.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(side)))).where(
        (F.length("left") >= F.col("before")) & (F.length("right") >= side - F.col("before")))
    content = F.sha2(F.concat(F.substring("left", F.lit(1), F.col("before")),
                              F.substring("right", F.lit(1), side - F.col("before"))), 256)
    windows = windows.select("h", "before", content.alias("content"), "single", "doc_id", "th", "place")
    common_windows = windows.groupBy("h", "before", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    counted = windows.where("single").join(common_windows, ["h", "before", "content"]).select(
        "doc_id", "th", (F.col("place") - F.col("before")).alias("begin"),
        (F.col("place") - F.col("before") + length).alias("end"))
    spans = whole.unionByName(parts).unionByName(counted).groupBy(
        F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(
        F.collect_list(F.struct("begin", "end")).alias("raw"))
    return keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["s_id"]) & (keyed["th"] == spans["s_th"]), "left").select(
        "doc_id", "th", "text", "raw")


def merged(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each row's text as bytes and its merged spans, cut at the text's end."""
    for text, raw in zip(batch.column("text"), batch.column("raw")):
        data = text.as_py().encode()
        yield data, [(b, min(e, len(data))) for b, e in merge([(x["begin"], x["end"]) for x in raw.as_py() or ()])]


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see repeated_spans for odd rows."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(data), sum(e - b for b, e in spans), len(spans), hashlib.sha256(cut(data, spans)).hexdigest())
                    for data, spans in merged(batch)]
            size, removed, count, digest = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                                   pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"doc_id {kind_of(docs, 'doc_id')}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeated_spans(docs, **options).mapInArrow(report, schema)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without their repeated strings, rows and columns as they came; an n_chars column is counted anew.

    A cut may fall inside a character; what is left of such a character goes with it. Null texts stay null, and a
    text that repeats as a whole becomes empty.
    """
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cut(data, spans).decode("utf-8", "ignore") for data, spans in merged(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(kept, pa.string())],
                                  names=["__id", "__th", "__kept"])

    schema = f"__id {kind_of(docs, 'doc_id')}, __th int, __kept string"
    changed = repeated_spans(docs.select("doc_id", "text"), **options).where("raw is not null").mapInArrow(
        rest, schema).dropDuplicates(["__id", "__th"])
    same = docs["doc_id"].eqNullSafe(changed["__id"]) & (_text_hash(docs["text"]) == changed["__th"])
    text = F.when(docs["text"].isNull(), None).otherwise(F.coalesce(changed["__kept"], docs["text"]))
    columns = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed["__kept"].isNull(), docs["n_chars"]).otherwise(
            F.length(changed["__kept"]).cast(kind)).alias("n_chars")
    return docs.join(changed, same, "left").select(*[columns.get(c, docs[c]) for c in docs.columns])
