"""Benchmark decontamination by templates (operator 2).

Numbers, names and units of benchmark items and documents become typed placeholders, so a question with other
values still has the same template. Windows of templates meet in a hash join; the values in their slots must then map
one to one, or the match does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import SPACE, kind_of, stage, staged_bytes
from ledgerspan.llm.repeats import Hashes

#: Tokens of a window; shorter items are matched as a whole, down to LEAST_TOKENS, below which nothing is said.
WINDOW, LEAST_TOKENS = 8, 5
#: A window needs so many tokens that are no placeholders (whole shorter items: half of theirs).
LEAST_LITERALS = 4
#: Share of an item's tokens that consistent windows of one document must cover.
COVERAGE = 0.5
#: Or so many tokens of an item in a row, so many of them no placeholders: an excerpt, however long its item is.
RUN, RUN_LITERALS = 13, 7
#: Bits of the filter of benchmark windows that tasks get; its size is fixed, whatever the benchmark's.
FILTER_BITS = 1 << 23
#: Words kept per Python worker before the memory is emptied, and characters of text looked at side by side.
REMEMBERED, TEXT_AT_ONCE = 65_536, 1 << 19
#: Leaked ids, as written, up to which their table is broadcast to the anti join; beyond it both sides shuffle.
BROADCAST_BYTES = 64 << 20

NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Fixed words: numbers and units (English, with the signs and abbreviations used everywhere).
NUMBER_WORDS = frozenset((
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half "
    "third quarter dozen first second").split())
UNIT_WORDS = frozenset((
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds "
    "ounce ounces ml l liter liters litre litres gallon gallons meter meters metre metres kilometer kilometers "
    "centimeter centimeters ms s sec min h hr hrs seconds minute minutes hour hours day days week weeks month months "
    "year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit "
    "kmh kph mph hz khz mhz ghz kb mb gb tb w kw kwh v volt volts watt watts").split())
SPECIAL = NUMBER_WORDS | UNIT_WORDS
NUMBER = re.compile(r"[+\-]?[$€£]?\d+(?:[.,:/\-]\d+)*(?P<unit>[a-zA-Z%°€$£]{0,4})$")
EDGE = re.compile(r"^[^\w$€£+\-]+|[^\w%°€$£]+$")
ENDS = frozenset(".!?:")


def canonical(word: str) -> tuple[tuple[str, str], ...]:
    """(form, value) parts of one blank-separated word: a placeholder and its value, or a lower-case literal.

    A word with a capital first letter is given as NAME; whether it counts as one is the caller's, who knows its place.
    """
    bare = EDGE.sub("", word)
    if not bare:
        return ()
    if (number := NUMBER.match(bare)) is not None:
        unit = number["unit"].lower()
        value = bare[:len(bare) - len(unit)] if unit else bare
        if bare[0] in "$€£":
            return ((NUM, value.lstrip("+-$€£")), (UNIT, bare[0]))
        return ((NUM, value), (UNIT, unit)) if unit else ((NUM, value),)
    low = re.sub(r"[^\w]", "", bare).lower()
    if not low:
        return ()
    if low in NUMBER_WORDS:
        return ((NUM, low),)
    if low in UNIT_WORDS:
        return ((UNIT, low),)
    return ((NAME if bare[:1].isupper() and bare[1:].islower() else low, low),)


def _hash(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode(), 2)


#: Odd multiplier of the window hash.
BASE = 0x9E3779B97F4A7C15
NAME_HASH = _hash(NAME)
SLOTS = np.array([_hash(x) for x in (NUM, NAME, UNIT)], np.uint64)


class Tokens(NamedTuple):
    """Template tokens of a list of texts, one after the other."""

    plain: np.ndarray  # hash of each token, capitals at sentence starts read as words
    named: np.ndarray  # the same, these read as names
    literal: np.ndarray  # whether `named` is no placeholder
    text: np.ndarray  # number of the text
    word: np.ndarray  # number of the blank-separated word, and which of its parts
    part: np.ndarray
    data: bytes
    begin: np.ndarray  # of each word in data
    end: np.ndarray

    def values(self, first: int, width: int) -> list[str]:
        """What stands at the places first .. first + width - 1."""
        return [canonical(self.data[self.begin[w]:self.end[w]].decode())[k][1]
                for w, k in zip(self.word[first:first + width], self.part[first:first + width])]


class Templates:
    """Template tokens of texts. Words are hashed side by side; each distinct word is looked at once and remembered."""

    def __init__(self, room: int = REMEMBERED) -> None:
        self.room, self.rows = room, {}
        self.lit, self.form = np.zeros((room, 2), np.uint64), np.zeros((room, 2), np.uint64)
        self.count, self.ends = np.zeros(room, np.int64), np.zeros(room, bool)

    def _remember(self, first: int, words: list[bytes]) -> None:
        """Rows first, first + 1, ... for these words, put into the arrays side by side."""
        lit, form, count, ends, others = [], [], [], [], []
        for row, word in enumerate(words, start=first):
            text = word.decode()
            ends.append(text[-1] in ENDS)
            plain = text if text.isalnum() else text[:-1]
            if plain.isalpha() and text[-1] != "_" and (low := plain.lower()) not in SPECIAL:
                # most words: letters, perhaps one mark behind
                named = not (lower := plain.islower()) and plain[1:].islower() and plain[0].isupper()
                if lower or named:
                    value = _hash(low)
                    lit.append(value)
                    form.append(NAME_HASH if named else value)
                    count.append(1)
                    continue
            lit.append(0)
            form.append(0)
            count.append(0)
            others.append((row, text))
        rows = slice(first, first + len(words))
        self.lit[rows, 0], self.form[rows, 0] = np.array(lit, np.uint64), np.array(form, np.uint64)
        self.count[rows], self.ends[rows] = count, ends
        for row, text in others:
            forms = canonical(text)
            self.count[row] = len(forms)
            for k, (form_k, value) in enumerate(forms):
                self.form[row, k] = _hash(form_k)
                self.lit[row, k] = _hash(value) if form_k == NAME else self.form[row, k]

    def tokens(self, texts: list) -> Tokens:
        raw = [(text or "").encode() for text in texts]
        data = b"\n".join(raw) + b"\n"
        space = SPACE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        offsets = np.cumsum([0] + [len(x) + 1 for x in raw])
        text = np.searchsorted(offsets, begin, side="right") - 1
        distinct, first, place = np.unique(Hashes(data, 1).between(begin, end, 0), return_index=True, return_inverse=True)
        if len(self.rows) + len(distinct) > self.room:
            self.__init__(max(self.room, 2 * len(distinct)))
        known, keys = self.rows, distinct.tolist()
        fresh = [k for k, key in enumerate(keys) if key not in known]
        if fresh:
            row, at = len(known), first[fresh]
            known.update(zip([keys[k] for k in fresh], range(row, row + len(fresh))))
            self._remember(row, [data[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist())])
        rows = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[place]
        start = np.ones(len(rows), bool)
        start[1:] = (text[1:] != text[:-1]) | self.ends[rows[:-1]]
        word = np.repeat(np.arange(len(rows)), self.count[rows])
        part = np.arange(len(word)) - np.repeat(np.cumsum(self.count[rows]) - self.count[rows], self.count[rows])
        own = rows[word]
        named = self.form[own, part]
        plain = np.where(start[word], self.lit[own, part], named)
        return Tokens(plain, named, ~np.isin(named, SLOTS), text[word], word, part, data, begin, end)


def batches_of(texts: list, size: int = TEXT_AT_ONCE) -> Iterator[tuple[int, list]]:
    """(number of the first, texts) of runs of texts of about `size` characters."""
    first, length = 0, 0
    for k, text in enumerate(texts):
        length += len(text or "")
        if length >= size:
            yield first, texts[first:k + 1]
            first, length = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of `width` tokens."""
    count = len(tokens) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(BASE) + tokens[k:k + count]
        total ^= total >> np.uint64(29)
    return total


def literal_counts(literal: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(literal)])
    return sums[width:] - sums[:-width] if len(literal) >= width else np.zeros(0, np.int64)


def readings(tokens: Tokens) -> tuple[np.ndarray, ...]:
    """The two readings of capitals at sentence starts, as words and as names; one if they are the same."""
    return (tokens.plain,) if np.array_equal(tokens.plain, tokens.named) else (tokens.plain, tokens.named)


def usable(tokens: Tokens, width: int) -> np.ndarray:
    """For each place whether a window begins there: within one text and with enough literals."""
    count = len(tokens.text) - width + 1
    if count <= 0:
        return np.zeros(0, bool)
    return (tokens.text[:count] == tokens.text[width - 1:]) & (
        literal_counts(tokens.literal, width) >= min(LEAST_LITERALS, (width + 1) // 2))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, item_id, i_place, width, n_tokens, slots, i_values) of every item's template windows.

    slots has the hash of the placeholder at each place, 0 at a literal; i_values what stands there.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = templates.tokens([text])
                if (count := len(tokens.text)) < LEAST_TOKENS:
                    continue
                width = min(window, count)
                good = np.flatnonzero(usable(tokens, width))
                for reading in readings(tokens):
                    hashes = window_hashes(reading, width).view(np.int64)
                    slots = np.where(np.isin(reading, SLOTS), reading, np.uint64(0)).view(np.int64)
                    for p in good.tolist():
                        rows.append(row)
                        out.append((int(hashes[p]), p, width, count, slots[p:p + width].tolist(), tokens.values(p, width)))
            h, place, width, count, slots, values = zip(*out) if out else ((),) * 6
            rows = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [pa.array(h, pa.int64()), batch.column("item_id").take(rows), pa.array(place, pa.int32()),
                 pa.array(width, pa.int32()), pa.array(count, pa.int32()), pa.array(slots, pa.list_(pa.int64())),
                 pa.array(values, pa.list_(pa.string()))],
                names=["h", "item_id", "i_place", "width", "n_tokens", "slots", "i_values"])

    schema = (f"h long, item_id {kind_of(benchmark, 'item_id')}, i_place int, width int, n_tokens int, slots array<long>, "
              "i_values array<string>")
    return benchmark.select("item_id", "text").mapInArrow(build, schema)


def window_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits set for the windows' hashes, at most bits / 64 words: a filter that misses none and is only there to spare
    the join; a benchmark so large that it fills up costs rows, not matches."""
    place = F.pmod("h", F.lit(bits))
    words = windows.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def consistent(slots: list[int], item: list[str], doc: list[str], forth: dict, back: dict) -> bool:
    """Whether a window's literals are equal and its slots still map one to one; if so the maps are extended."""
    new_forth, new_back = {}, {}
    for slot, a, b in zip(slots, item, doc):
        if not slot:
            if a != b:
                return False
            continue
        if forth.get((slot, a), new_forth.setdefault((slot, a), b)) != b:
            return False
        if back.get((slot, b), new_back.setdefault((slot, b), a)) != a:
            return False
    forth.update(new_forth)
    back.update(new_back)
    return True


def best_alignment(hits: list[dict], run: int = RUN) -> tuple[float, bool, bool]:
    """(share of the item's tokens covered, whether a slot has another value, whether an excerpt is held) of the alignments.

    The first two are those of the alignment that covers most. An excerpt is `run` tokens in a row that any alignment
    covers, RUN_LITERALS of them no placeholders.
    """
    by_shift: dict[int, list[dict]] = {}
    for hit in hits:
        by_shift.setdefault(hit["d_place"] - hit["i_place"], []).append(hit)
    best, excerpt = (0.0, False), False
    for aligned in by_shift.values():
        forth: dict = {}
        back: dict = {}
        covered: dict[int, bool] = {}  # place: whether it is no placeholder
        for hit in sorted(aligned, key=lambda x: (x["i_place"], x["slots"])):
            if consistent(hit["slots"], hit["i_values"], hit["d_values"], forth, back):
                for place, slot in enumerate(hit["slots"], hit["i_place"]):
                    covered[place] = not slot or covered.get(place, False)
        best = max(best, (len(covered) / aligned[0]["n_tokens"], any(a != b for (_, a), b in forth.items())))
        excerpt = excerpt or holds_run(covered, run)
    return *best, excerpt


def holds_run(covered: dict[int, bool], run: int) -> bool:
    """Whether `run` places in a row are covered and at least RUN_LITERALS of them (a like share of another run) are literals."""
    least, literals = -(-run * RUN_LITERALS // RUN), []
    for place in sorted(covered):
        if place - 1 not in covered:
            literals = []
        literals.append(covered[place])
        if len(literals) >= run and sum(literals[-run:]) >= least:
            return True
    return False


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
            run: int = RUN) -> DataFrame:
    """doc_id, item_id, coverage, changed_slots for every document (doc_id, text) that holds a benchmark item
    (item_id, text), with other numbers, names or units or the same.

    Documents are read once; only windows that the filter lets pass, a few per leak, go on to the hash join with the
    benchmark's windows, so a passage in a third of all documents joins one window row each. Hits are gathered
    per document and item, which a document's own length bounds. In each alignment of the two, windows count as
    far as their slots map one to one; one alignment must cover `coverage` of the item's tokens, or `run` of them in a row
    with enough literals, which counts excerpts of items of any length.

    Null and empty texts match nothing; items below LEAST_TOKENS tokens are not looked for; repeated rows count
    once; a null doc_id is reported as null. Empty tables give an empty result. Further columns are ignored.
    """
    spark, id_kind = docs.sparkSession, kind_of(docs, "doc_id")
    windows = stage(benchmark_windows(benchmark, window), "benchmark-windows")
    known = spark.sparkContext.broadcast(window_filter(windows.select("h")))
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most `window` values

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bits = Templates(), known.value
        size = np.uint64(64 * len(bits) - 1)
        for batch in batches:
            rows, out = [], []
            for begin, texts in batches_of(batch.column("text").to_pylist()):
                tokens = templates.tokens(texts)
                for width in widths:
                    good = usable(tokens, width)
                    for reading in readings(tokens):
                        h = window_hashes(reading, width)
                        at = h & size
                        passed = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                        for p in np.flatnonzero(good & passed.astype(bool)).tolist():
                            rows.append(begin + int(tokens.text[p]))
                            out.append((int(h[p].view(np.int64)), p, tokens.values(p, width)))
            h, place, values = zip(*out) if out else ((),) * 3
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(h, pa.int64()),
                 pa.array(place, pa.int32()), pa.array(values, pa.list_(pa.string()))],
                names=["doc_id", "h", "d_place", "d_values"])

    hits = docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {id_kind}, h long, d_place int, d_values array<string>").join(windows, "h")
    gathered = hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct(
        "d_place", "i_place", "n_tokens", "slots", "i_values", "d_values")).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_alignment(x, run) for x in batch.column("hits").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("item_id"), pa.array([x[0] for x in found], pa.float64()),
                 pa.array([x[1] for x in found], pa.bool_()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "item_id", "coverage", "changed_slots", "excerpt"])

    schema = f"doc_id {id_kind}, item_id {kind_of(benchmark, 'item_id')}, coverage double, changed_slots boolean, excerpt boolean"
    return gathered.mapInArrow(judge, schema).where((F.col("coverage") >= coverage) | F.col("excerpt")).drop("excerpt")


def without_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES,
                  **options) -> DataFrame:
    """Drops every document that holds a benchmark item; columns as they came. Rows without a doc_id stay.

    The leaked ids are written first, so their size is measured, not guessed: up to `broadcast_bytes` they go to every
    task and the texts stay where they are; a larger set is joined by shuffling both sides.
    """
    leaked = stage(matches(docs, benchmark, **options).select("doc_id").where(F.col("doc_id").isNotNull()).distinct(),
                   "leaked-ids")
    if staged_bytes(leaked) <= broadcast_bytes:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
