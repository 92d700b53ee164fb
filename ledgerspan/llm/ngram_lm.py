"""Scores of a bigram language model from Elias-Fano tries (operator 9).

The model has the counts of all training words and word pairs. No single machine holds it: documents are dealt
into blocks of bounded text; each block asks for the counts of its own n-grams, gets them from the parts of the hash range
that sum the counts of all blocks, and scores its texts from a trie of just these n-grams. The trie's levels are compact
(monotone sequences in Elias-Fano code, probabilities quantised to 16 bits) and memory-mapped.

p(w | u) = (c(u w) + PRIOR * p(w)) / (c(u) + PRIOR), with the smoothed word probability p(w) below it: both sum to one
over the training vocabulary and one unknown word.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspan.llm.common import LOWER_BYTES, SPACE, crc_fold, kind_of
from ledgerspan.llm.repeats import Hashes, _scramble

#: Bytes of text of a block on average; bounds what a task holds, so blocks grow in number with the corpus.
BLOCK_BYTES = 5_000_000
PRIOR, ADD = 100.0, 0.1
#: Bytes of a word's and of a pair's hash that travel besides the number of the part.
KEY_BYTES = {1: 8, 2: 5}
#: Quantised log10 probabilities are multiples of 1 / STEPS down to -65535 / STEPS.
STEPS = 4000
START, END = (int(x) for x in _scramble(np.array([11, 12], np.uint64)))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and of one end token."""
    data = (text or "").encode().translate(LOWER_BYTES)
    space = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.array([END], np.uint64)
    return np.append(Hashes(data, 1).between(begin, end, 0), np.uint64(END))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of (word before, word) for each token of one text; the first follows the start."""
    before = np.concatenate([np.array([START], np.uint64), words[:-1]])
    return _scramble(before * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


# --- Elias-Fano levels ----------------------------------------------------------------------------------------------

class Monotone:
    """A non-decreasing sequence in Elias-Fano code: low bits packed, high bits in unary with ranks every 64 bits."""

    def __init__(self, low_bits: int, count: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.low_bits, self.count, self.low, self.high, self.ranks = low_bits, count, low, high, ranks

    @staticmethod
    def encode(values: np.ndarray) -> "Monotone":
        values = values.astype(np.int64)
        count = len(values)
        top = int(values[-1]) if count else 0
        low_bits = max(int(top // max(count, 1)).bit_length() - 1, 0)
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        unary = np.zeros(((top >> low_bits) + count) // 64 * 64 + 64, np.uint8)
        unary[(values >> low_bits) + np.arange(count)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)
        return Monotone(low_bits, count, np.concatenate([low, np.zeros(8, np.uint8)]), high, ranks)

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        """Values at the places: the place-th set bit of the high part, and the low bits beside it."""
        word = np.searchsorted(self.ranks, places, side="right") - 1
        left = places - self.ranks[word]
        bits, base = self.high[word].copy(), np.zeros(len(places), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = left >= ones
            left = np.where(beyond, left - ones, left)
            bits = np.where(beyond, bits >> np.uint64(width), bits)
            base += np.where(beyond, width, 0)
        high = word * 64 + base - places
        if not self.low_bits:
            return high
        first = places * self.low_bits
        byte = first >> 3
        window = np.zeros(len(places), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            window |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        low = (window >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return (high << self.low_bits) | low.astype(np.int64)


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * STEPS), 0, 65535).astype(np.uint16)


class Trie:
    """Two levels: words with log10 probability and back-off weight; successors of each word with log10 probability.

    Successors are numbers of words. To make the whole level monotone, a context's successors are stored relative to the
    last value of the contexts before it; `pointers` says where each context begins. Levels lie in one
    unlinked file that is mapped into memory.
    """

    def __init__(self, words: np.ndarray, backoff: np.ndarray, context: np.ndarray, successor: np.ndarray,
                 logs: np.ndarray) -> None:
        """context, successor: word numbers of the seen pairs, ordered by both; words: log10 p, backoff: log10 weight."""
        pointers = np.searchsorted(context, np.arange(len(words) + 1))
        values = successor.astype(np.int64)
        if len(values):
            size = np.diff(pointers)
            last = np.where(size > 0, values[np.maximum(pointers[1:] - 1, 0)], 0)
            values = values + np.concatenate([[0], np.cumsum(last)[:-1]])[context]
        self.arrays: dict[str, np.ndarray] = {}
        self.pointers, self.level = Monotone.encode(pointers), Monotone.encode(values)
        self._map({"words": quantise(words), "backoff": quantise(backoff), "pairs": quantise(logs),
                   "p.low": self.pointers.low, "p.high": self.pointers.high, "p.ranks": self.pointers.ranks,
                   "l.low": self.level.low, "l.high": self.level.high, "l.ranks": self.level.ranks})
        for prefix, sequence in (("p", self.pointers), ("l", self.level)):
            sequence.low, sequence.high, sequence.ranks = (self.arrays[f"{prefix}.{x}"] for x in ("low", "high", "ranks"))

    def _map(self, arrays: dict[str, np.ndarray]) -> None:
        with tempfile.TemporaryFile() as file:
            places = {}
            for name, x in arrays.items():
                file.write(bytes(-file.tell() % 8))
                places[name] = (file.tell(), x.dtype, len(x))
                file.write(x.tobytes())
            file.write(bytes(8))
            file.flush()
            self.mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        for name, (begin, kind, count) in places.items():
            self.arrays[name] = np.frombuffer(self.mapped, kind, count, begin)

    def log_probability(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context), by binary search for the word among the context's successors."""
        low, high = self.pointers[context], self.pointers[context + 1]
        begin = low.copy()
        base = np.zeros(len(context), np.int64)
        later = np.flatnonzero(low > 0)
        base[later] = self.level[low[later] - 1]
        target, end = base + word, high.copy()
        active = np.flatnonzero(low < end)
        while len(active):
            middle = (low[active] + end[active]) // 2
            below = self.level[middle] < target[active]
            low[active] = np.where(below, middle + 1, low[active])
            end[active] = np.where(below, end[active], middle)
            active = active[low[active] < end[active]]
        found = np.flatnonzero((low < high) & (low >= begin))
        found = found[self.level[low[found]] == target[found]]
        logs = -(self.arrays["words"][word].astype(np.float64) + self.arrays["backoff"][context]) / STEPS
        logs[found] = -self.arrays["pairs"][low[found]].astype(np.float64) / STEPS
        return logs


# --- blocks and parts ------------------------------------------------------------------------------------------------

class Block:
    """The n-grams of a block's texts: sorted distinct hashes, and for every token its places in them."""

    def __init__(self, texts: list, train: np.ndarray) -> None:
        words = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        tokens = np.concatenate(words)
        pairs = np.concatenate([pair_hashes(w) for w in words])
        self.train = np.repeat(train, self.sizes)
        # the start and end tokens are words of every block, so that their counts come along
        self.words, place = np.unique(np.concatenate([tokens, np.array([END, START], np.uint64)]), return_inverse=True)
        self.token, self.start = place[:-2], int(place[-1])
        self.end = int(place[-2])
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def requests(self, block: int, parts: int) -> pd.DataFrame:
        """One row per part and order: the block's hashes there and how often its training texts have them."""
        bits, rows = parts.bit_length() - 1, []
        for order, hashes, place in ((1, self.words, self.token), (2, self.pairs, self.pair)):
            counts = np.bincount(place[self.train], minlength=len(hashes)).astype(np.uint64)
            part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            edges = np.searchsorted(part, np.arange(parts + 1))
            keys = pack_keys(hashes, bits, KEY_BYTES[order])
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                rows.append((2 * p + order - 1, block, keys[a:b].tobytes(), planes(counts[a:b])))
        return pd.DataFrame(rows, columns=["part", "block", "hashes", "counts"])


def pack_keys(hashes: np.ndarray, bits: int, size: int) -> np.ndarray:
    """The `size` bytes of each hash that follow its first `bits` bits, which the part's number has already."""
    if size == 8:
        return hashes.view(np.uint8).reshape(-1, 8)
    shifted = (hashes << np.uint64(bits)) >> np.uint64(64 - 8 * size)
    return shifted.view(np.uint8).reshape(-1, 8)[:, :size]


def unpack_keys(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def planes(counts: np.ndarray) -> bytes:
    """The counts' lowest bytes, then the next ones, and so on: most are zero and take no room when compressed.
    Counts are 64 bits wide, so no word is frequent enough to be cut."""
    return counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def answer(requests: pd.DataFrame) -> pd.DataFrame:
    """Sums the counts of one part over all blocks and gives each block those of its hashes, in its order."""
    size = KEY_BYTES[int(requests["part"].iloc[0]) % 2 + 1]
    keys = [unpack_keys(x, size) for x in requests["hashes"]]
    counts = np.concatenate([from_planes(x) for x in requests["counts"]])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    # summed in 64-bit integers: a float sum would round beyond 2^53
    order = np.argsort(place, kind="stable")
    sums = np.add.reduceat(counts[order], np.searchsorted(place[order], np.arange(len(distinct))))[place]
    edges = np.cumsum([0] + [len(k) for k in keys])
    replies = [planes(sums[a:b]) for a, b in zip(edges, edges[1:])]
    return pd.DataFrame({"block": requests["block"], "part": requests["part"], "counts": replies})


def score_block(block: Block, replies: pd.DataFrame, total: int, distinct: int, prior: float) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of the block."""
    counts = []
    for order in (0, 1):
        own = replies[replies["part"] % 2 == order].sort_values("part")
        counts.append(np.concatenate([from_planes(x) for x in own["counts"]]).astype(np.float64))
    words, pairs = counts
    floor = total + ADD * (distinct + 1)
    unigram = np.log10((words + ADD) / floor)
    context_count = words.copy()
    context_count[block.start] = words[block.end]  # as many starts as ends
    # each distinct pair once, in the trie's order so that searches read it from end to end
    first = np.zeros(len(block.sizes), np.int64)
    first[1:] = np.cumsum(block.sizes)[:-1]
    before = np.empty(len(block.token), np.int64)
    before[1:] = block.token[:-1]
    before[first] = block.start
    context, word = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    context[block.pair], word[block.pair] = before, block.token
    order = np.argsort(context * len(words) + word)
    seen = order[pairs[order] > 0]
    lower = (words[word[seen]] + ADD) / floor
    logs = np.log10((pairs[seen] + prior * lower) / (context_count[context[seen]] + prior))
    trie = Trie(unigram, np.log10(prior / (context_count + prior)), context[seen], word[seen], logs)
    of_pair = np.empty(len(pairs))
    of_pair[order] = trie.log_probability(context[order], word[order])
    each = of_pair[block.pair]
    add = lambda x: np.add.reduceat(x, first)
    return {"n_tokens": block.sizes, "n_known": add((words[block.token] > 0).astype(np.int64)),
            "base_score": add(unigram[block.token]), "score": add(each)}


def training_size(docs: DataFrame) -> tuple[int, int]:
    """(tokens, distinct tokens) of the training texts (text, train)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t.as_py()) for t in batch.column("text")] or [np.zeros(0, np.uint64)]
            distinct, n = np.unique(np.concatenate(words), return_counts=True)
            yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = docs.where("train").select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return int(row[0]), int(row[1])


def score_texts(docs: DataFrame, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Folds by crc32(doc_id as text) mod 10; fold 0 is held out of training. Texts are dealt to blocks by a hash of doc_id and
    text; the same exchange feeds counting and scoring. A block's distinct n-grams are counted in the block before
    they travel, so a frequent word or a text with thousands of copies is one entry per block.

    Null and empty texts are one end token; without training texts every token is unknown (base: log10 0.1 / 0.1).
    Repeated rows each count and each get a row; a null doc_id is in fold 0 (crc32 of the empty text). An empty
    table gives an empty result.
    """
    id_kind = kind_of(docs, "doc_id")
    held = crc_fold(F.col("doc_id"), 10) == 0
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~held).alias("train"))
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = training_size(read)
    blocks = max(1, -(-int(size[0]) // block_bytes))
    parts = 1 << max(0, (blocks - 1).bit_length())
    dealt = read.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(texts: pd.DataFrame) -> pd.DataFrame:
        block = Block(texts["text"].tolist(), texts["train"].to_numpy(bool))
        return block.requests(int(texts["block"].iloc[0]), parts)

    def score(key: tuple, texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        train = texts["train"].to_numpy(bool)
        found = score_block(Block(texts["text"].tolist(), train), replies, total, distinct, prior)
        return pd.DataFrame({"doc_id": texts["doc_id"], "held_out": ~train} | found).assign(train_tokens=total)[
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    requests = dealt.groupBy("block").applyInPandas(ask, "part long, block int, hashes binary, counts binary")
    replies = requests.groupBy("part").applyInPandas(answer, "block int, part long, counts binary")
    schema = (f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(score, schema)
