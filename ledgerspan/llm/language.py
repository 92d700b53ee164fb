"""Language identification by word-first backoff (operator 8).

Known words score by their log frequency in each language; a word that training has not seen falls back to its
character n-grams, from the longest length at which any is known to shorter ones.
"""

from __future__ import annotations


import regex
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerspan.llm.common import crc_fold, kind_of

#: Documented bounds of the training sample (documents per language, on average) and of the model: the most
#: frequent words, and n-grams of each length, of every language. No language is left out.
SAMPLE_PER_LANGUAGE = 4000
WORDS, GRAMS = 20_000, 10_000
LONGEST_GRAM = 4
SMOOTHING = 0.5
#: A text's log-likelihoods are scaled to so many words for the score, or it would be 1 for every longer text.
EVIDENCE_WORDS = 20
#: Scores of words kept per Python worker before the memory is emptied.
REMEMBERED = 200_000
#: Words: a letter, then letters and combining marks; numbers such as ½, ² or Ⅷ are no letters.
RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Model(NamedTuple):
    languages: list[str]
    words: list[str]
    word_logs: np.ndarray  # log frequency of each word in each language
    grams: list[str]
    gram_logs: np.ndarray
    usual: int  # the language with most training words


EMPTY = Model([], [], np.zeros((0, 0), np.float32), [], np.zeros((0, 0), np.float32), 0)


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i:i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, unit, n) of each batch: kind 0 are words, else the length of an n-gram."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(RUN.findall(text.lower()))
        rows = []
        for lang, counted in words.items():
            rows += [(lang, 0, word, n) for word, n in counted.items()]
            grams: Counter = Counter()
            for word, n in counted.items():
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, size):
                        grams[size, gram] += n
            rows += [(lang, size, gram, n) for (size, gram), n in grams.items()]
        langs, kinds, units, ns = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(units, pa.string()),
                               pa.array(ns, pa.int64())], names=["lang", "kind", "unit", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Fits the model on a sample of labelled rows (doc_id, text, lang), whole texts.

    Of each language a hash of doc_id and text picks `sample` documents on average, whatever the size of the
    corpus; the most frequent `words` words and `grams` n-grams of each length of every language are kept, ranked
    within each language, so a small language keeps its own words however many others come. The model grows with
    the number of languages only.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not sizes:
        return EMPTY
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(sample / r["n"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < share).select("lang", "text")
    counts = chosen.mapInArrow(count_units, "lang string, kind int, unit string, n long").groupBy(
        "kind", "unit", "lang").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "unit")))
    kept = ranked.where(F.col("rank") <= F.when(F.col("kind") == 0, words).otherwise(grams)).select("kind", "unit").distinct()
    units = counts.join(kept, ["kind", "unit"]).groupBy("kind", "unit").agg(F.sum("n").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by"))  # one entry per language
    units = units.persist()
    totals = {r["lang"]: r["n"] for r in counts.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        units.unpersist()
        return EMPTY
    in_order = F.transform(F.array(*map(F.lit, languages)), lambda lang: F.coalesce(F.element_at("by", lang), F.lit(0)))
    names: list[list[str]] = [[], []]
    logs: list[list[np.ndarray]] = [[], []]
    for kind in range(LONGEST_GRAM + 1):
        top = units.where(F.col("kind") == kind).orderBy(F.desc("total"), "unit").select(
            "unit", in_order.alias("n")).collect()
        raw = np.array([r["n"] for r in top], dtype=float).reshape(len(top), len(languages))
        logs[kind > 0].append(np.log((raw + SMOOTHING) / (raw.sum(0) + SMOOTHING * (len(top) + 1))).astype(np.float32))
        names[kind > 0] += [r["unit"] for r in top]
        del top, raw
    units.unpersist()
    return Model(languages, names[0], np.concatenate(logs[0]), names[1], np.concatenate(logs[1]),
                 max(range(len(languages)), key=lambda k: (totals[languages[k]], -k)))


class Scorer:
    """The model as tables of a Python worker; remembers the scores of unseen words in rows behind those of known ones."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known = dict(zip(model.words, range(len(model.words))))
        self.grams = dict(zip(model.grams, map(tuple, model.gram_logs.tolist())))
        self.table = np.zeros((len(model.words) + REMEMBERED, len(model.languages)), np.float32)
        self.table[:len(model.words)] = model.word_logs
        self.memory: dict[str, int] = {}

    def word_scores(self, word: str) -> list[float]:
        """Of an unseen word: the mean over its n-grams of the longest length with a known one; else no evidence."""
        table = self.grams
        for n in range(LONGEST_GRAM, 0, -1):
            known = [table[g] for g in grams_of(word, n) if g in table]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(self.model.languages)

    def row(self, word: str) -> int:
        if (row := self.memory.get(word)) is None:
            row = len(self.known) + len(self.memory)
            self.table[row] = self.word_scores(word)
            self.memory[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of one text."""
        counted = Counter(RUN.findall((text or "").lower()))
        languages = self.model.languages
        if not counted or not languages:
            return "und", 0.0
        total, words = np.zeros(len(languages)), sum(counted.values())
        items = iter(counted.items())
        while part := list(islice(items, REMEMBERED)):
            if len(self.memory) + len(part) > REMEMBERED:
                self.memory.clear()
            known = self.known
            rows = [known[w] if w in known else self.row(w) for w, _ in part]
            total += np.array([n for _, n in part], np.float64) @ self.table[rows]
        if not np.ptp(total):
            return languages[self.model.usual], 1.0 / len(total)
        scaled = total * min(1.0, EVIDENCE_WORDS / words)
        best = int(np.argmax(scaled))
        return languages[best], float(1.0 / np.exp(scaled - scaled[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row of docs (doc_id, text): one pass without a shuffle.

    A null text, and one without a letter, is `und` with score 0, as is any text if no language was learned.
    Letters that no n-gram knows give the most frequent language and the score of a guess. Ties go to the
    language first in code point order. Repeated rows each get a row; other columns are never looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in parts:
            found = [scorer.predict(text.as_py()) for text in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()),
                                   pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = f"doc_id {kind_of(docs, 'doc_id')}, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(batches, schema)


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, 4) == 2


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Trains on the labelled documents of folds 0, 1, 3 and predicts every document; adds held_out."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Drops documents without a language: no letters, or a score below least_score. Columns as they came."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in parts:
            found = [scorer.predict(text.as_py()) for text in batch.column("text")]
            yield batch.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
