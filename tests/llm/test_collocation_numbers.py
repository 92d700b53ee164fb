"""Phrases counted from numbered words: against direct counts, and with words that share a hash."""

import collections
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from ledgerspan.llm import collocations

TEXTS = [("red fox ran home. Red FOX\tran. the red fox", "en"), ("red fox ran far; the cat sat", "en"), ("the cat sat\tÉté", "fr"),
         ("RED fox ran home, Éa éa été", None), (None, "en"), (" \t.\t", "en")] * 3


def frame(spark):
    return spark.createDataFrame([(k, text, lang) for k, (text, lang) in enumerate(TEXTS)], "doc_id long, text string, lang string")


def direct():
    counts = collections.Counter()
    for text, lang in TEXTS:
        body = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", body):
            words = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for m in range(1, 5):
                for at in range(len(words) - m + 1):
                    counts[lang or "und", m, " ".join(words[at:at + m])] += 1
    return counts


def test_runs_of_numbers_equal_direct_counts(spark):
    docs, least = frame(spark), 4
    words, _ = collocations.frequent_words(docs, "text", "lang", least)
    numbers = [r.id for r in words.collect()]
    assert len(set(numbers)) == len(numbers) and None not in numbers
    places = collocations.numbered_places(docs, words, "text", "lang")
    assert [kind for _, kind in places.dtypes] == ["int"] * 4
    pairs = collocations.frequent_pairs(docs, words, "text", "lang", least, places=places)
    runs = collocations.frequent_runs(places, pairs, least)
    got = [((r.lang, r.m, r.g), r.c) for r in runs.collect()]
    want = {key: c for key, c in direct().items() if key[1] >= 3 and c >= least}
    assert len(got) == len(want) and dict(got) == want


def test_words_with_the_same_hash_are_told_apart(spark, monkeypatch):
    docs = frame(spark)
    poor = lambda *columns: F.length(F.col(columns[-1]) if isinstance(columns[-1], str) else columns[-1]).cast("long")
    con = duckdb.connect()
    con.register("docs_df", pd.DataFrame([(text, lang) for text, lang in TEXTS], columns=["text", "lang"]))
    con.sql("CREATE VIEW documents AS SELECT * FROM docs_df")
    want = {tuple(r) for r in con.sql(collocations.oracle_sql("documents", 2, 2000)).df().astype(str).itertuples(index=False)}
    columns = list(con.sql(collocations.oracle_sql("documents", 2, 2000)).df().columns)
    monkeypatch.setattr(F, "xxhash64", poor)
    for room in (1 << 20, 0):
        found = collocations.collocations(docs, least=2, broadcast_bytes=room).toPandas()[columns].astype(str)
        assert {tuple(r) for r in found.itertuples(index=False)} == want
