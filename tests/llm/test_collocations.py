"""Phrase collocations against the same list in DuckDB SQL, over odd rows."""

import duckdb
import pandas as pd

from ledgerspan.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows():
    base = "the red fox ran. the red fox ran; The Red fox sat\nred fox ran home, a b c d e the red fox"
    out = [(1, base, "en", "x"), (2, base, "en", "x"), (2, base, "en", "x"), (3, None, "en", "y"), (4, "", None, "y"),
           (5, "Red FOX ran\tred fox ran", None, None), (6, "  \t ", "fr", "z"), (7, "é é é é. é é é é", "fr", "z"),
           (8, " ".join(["w"] * 5000), "de", "z"), (9, "x y x y x y x y x y", "de", None)]
    return out


def frame(spark, data):
    # extra columns whose names the operator might use inside
    return spark.createDataFrame([(i, t, g, s, "c", 1) for i, t, g, s in data],
                                 "doc_id long, text string, lang string, source string, phrase string, m int")


def oracle(data, least, top):
    con = duckdb.connect()
    con.register("docs_df", pd.DataFrame(data, columns=["doc_id", "text", "lang", "source"]))
    con.sql("CREATE VIEW documents AS SELECT * FROM docs_df")
    return con.sql(collocations.oracle_sql("documents", least, top)).df()


def same(got, want):
    got = got.sort_values(["lang", "rank"]).reset_index(drop=True)[COLUMNS].astype(str)
    want = want.sort_values(["lang", "rank"]).reset_index(drop=True)[COLUMNS].astype(str)
    pd.testing.assert_frame_equal(got, want)


def test_against_sql_on_odd_rows(spark):
    data = rows()
    for least, top in ((2, 2000), (3, 2000), (2, 3)):
        got = collocations.collocations(frame(spark, data), least=least, top=top).toPandas()
        assert len(got) > 0
        same(got, oracle(data, least, top))


def test_counts_are_node_flow_plus_piece_ends(spark):
    data = rows()
    got = {(r.lang, r.g): r.c for r in collocations.run_counts(collocations.graph(frame(spark, data))).collect()}
    # direct counts in plain Python
    want = {}
    for _, text, lang, _ in data:
        body = (text or "").translate({c: c + 32 for c in range(65, 91)})
        import re
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", body):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for m in range(1, 5):
                for s in range(len(w) - m + 1):
                    key = (lang or "und", " ".join(w[s:s + m]))
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).count() == 0


def test_sub_runs_of_a_frequent_longer_run_go(spark):
    data = [(k, "alpha beta gamma delta. alpha beta", "en", None) for k in range(40)]
    got = collocations.collocations(frame(spark, data)).toPandas()
    # "alpha beta" has 80 occurrences, the 4-word run 40: 100*40 < 80*80, so it stays; the inner runs of 40 go
    assert set(got.phrase) == {"alpha beta gamma delta", "alpha beta"}
    same(got, oracle(data, 30, 2000))


def test_rare_edges_do_not_travel_and_every_join_way_agrees(spark):
    data = rows() + [(100 + k, f"alpha beta gamma delta. u{k} v{k} alpha beta x{k} y{k}", "en", None) for k in range(40)]
    docs = frame(spark, data)
    known, total = collocations.frequent_words(docs, "text", "lang", 30)
    pairs = collocations.frequent_pairs(docs, known, "text", "lang", 30)
    assert {(r.lang, r.g): r.c for r in pairs.collect() if r.lang == "en"} == {
        ("en", "alpha beta"): 80, ("en", "beta gamma"): 40, ("en", "gamma delta"): 40}
    edges = [r for r in collocations.graph(docs, pairs=pairs).collect() if r.lang == "en"]
    assert sorted((r.g, r.c) for r in edges) == [("alpha beta gamma delta", 40), ("beta gamma delta", 40)]
    for room in (1 << 20, 0):
        same(collocations.collocations(docs, broadcast_bytes=room).toPandas(), oracle(data, 30, 2000))
