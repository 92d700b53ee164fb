"""What the counts of runs of three and four words read and send: one pass over the places, summed before it is dealt."""

import collections
import re

from ledgerspan.llm import collocations


def test_places_are_read_once_and_summed_before_they_travel(spark):
    texts = [("red fox ran home", "en")] * 6 + [("red fox ran far. the cat", "en"), ("red fox ran home now", "fr")] * 5
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "doc_id long, text string, lang string")
    words, _ = collocations.frequent_words(docs, "text", "lang", 5)
    places = collocations.numbered_places(docs, words, "text", "lang")
    pairs = collocations.frequent_pairs(docs, words, "text", "lang", 5, places=places)
    want = collections.Counter()
    for text, lang in texts:
        for piece in text.split(". "):
            w = piece.split(" ")
            want.update((lang, m, " ".join(w[k:k + m])) for m in (3, 4) for k in range(len(w) - m + 1))
    # run as it stands and with nothing broadcast; the plan is that which ran
    for room in (collocations.BROADCAST_BYTES, 0):
        runs = collocations.frequent_runs(places, pairs, 5, room)
        assert {(r.lang, r.m, r.g): r.c for r in runs.collect()} == want
        plan = runs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan.*i1:int,i2:int,i3:int,i4:int", plan)) == 1
        assert "REPARTITION_BY_COL" not in plan


def test_the_largest_numbers_pair_and_part(spark):
    top = (1 << collocations.NUMBER_BITS) - 1
    numbers = spark.createDataFrame([(0, 0), (0, top), (top, 0), (top, top), (5, 7)], "a int, b int")
    paired = numbers.select("a", "b", collocations._pair("a", "b").alias("p"))
    rows = paired.select("a", "b", "p", *collocations._unpaired("p", "x", "y")).collect()
    assert all((r.a, r.b) == (r.x, r.y) and r.p >= 0 for r in rows) and len({r.p for r in rows}) == 5
