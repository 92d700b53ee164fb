"""Operators on texts against plain Python over small tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from ledgerspan.llm import decontaminate, language, mixing, ngram_lm, repeats, simhash, token_cache
from ledgerspan.llm.common import crc_fold, scratch_path, stage
from ledgerspan.llm.components import connected_components

LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, th string, fp string"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "h", "th", "fp") for i, t, lang, s in rows],
                                 SCHEMA)


def prose(seed, words):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeioubcdfgl"), rng.integers(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def odd_rows():
    passage, shared = prose(1, 200), prose(2, 60)
    rows = [(k, prose(100 + k, 120), "en", f"s{k % 3}") for k in range(12)]
    rows += [(20, passage, "en", "s0"), (21, passage, "en", "s0"), (22, passage + " x", "fr", None), (22, passage + " x", "fr", None)]
    rows += [(30 + k, f"{prose(200 + k, 30)} {shared} {prose(300 + k, 30)}", "de", "s1") for k in range(5)]
    rows += [(40, "", "en", "s0"), (41, None, None, None), (42, "One", "en", "s2"), (43, "  \t\n", "en", None),
             (None, prose(7, 80), "fr", "s1"), (44, prose(8, 9) + " " + "ab " * 400, "en", "s0"), (45, "é" * 700, "fr", "s1"),
             (46, prose(9, 30000), "en", "s0"), (47, "123 456", None, "s0")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return stage(table(spark, odd_rows).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]


# --- repeats -------------------------------------------------------------------------------------------------------

def expected_repeats(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (i, *_), d in zip(rows, data):
        gone = np.zeros(len(d) + 2, np.int8)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k + 1:k + length + 1] = 1
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((str(i), len(d), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def short_rows(rows):
    return [r for r in rows if r[0] != 46]


@pytest.mark.parametrize("options", [{}, {"length": 60, "anchor": 30}, {"length": 60, "anchor": 30, "group_limit": 1}])
def test_repeats_match_brute_force(spark, odd_rows, options):
    rows = short_rows(odd_rows)
    near = prose(50, 60)
    rows = rows + [(60 + k, near[:k * 9] + "#" + near[k * 9:], "en", "s0") for k in range(1, 7)]
    got = repeats.repeat_report(table(spark, rows).repartition(2), **options).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected_repeats(rows, options.get("length", 400))


def test_repeats_leave_other_texts_and_columns(spark, odd, odd_rows, none):
    kept = repeats.without_repeats(odd)
    assert kept.schema == odd.schema and kept.count() == len(odd_rows)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[20] == "" and texts[41] is None and texts[3] == dict((r[0], r[1]) for r in odd_rows)[3]
    assert repeats.repeat_report(none).count() == 0


def test_intervals_of_a_suffix_array():
    text = b"banana$"
    order = sorted(range(len(text)), key=lambda k: text[k:])
    prefixes = [0] + [repeats.common(text[a:], text[b:]) for a, b in zip(order, order[1:])]
    found = {(text[order[a]:order[a] + d], b - a + 1) for d, a, b in repeats.prefix_intervals(prefixes, 1)}
    assert found == {(b"a", 3), (b"ana", 2), (b"na", 2)}


# --- near duplicates -------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = words(text)
    parts = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    low = dict.fromkeys(nodes)
    for start in nodes:
        if low[start] is None:
            group, waiting = {start}, [start]
            while waiting:
                x = waiting.pop()
                for y in nodes:
                    if y not in group and linked(x, y):
                        group.add(y)
                        waiting.append(y)
            for x in group:
                low[x] = group
    return low


def test_simhash_matches_brute_force(spark, odd, odd_rows, none):
    got = simhash.near_duplicates(odd).collect()
    fp = [plain_fingerprint(t) for _, t, *_ in odd_rows]
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64)) for r in got) == sorted((str(r[0]), f) for r, f in zip(odd_rows, fp))
    groups = reachable(sorted(set(fp)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), f in zip(odd_rows, fp):
        for member in groups[f]:
            if i is not None:
                least[member] = min(i, least.get(member, i))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(r[0], least.get(f)) for r, f in zip(odd_rows, fp)}
    kept = simhash.keep_one_each(odd)
    assert kept.schema == odd.schema
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").distinct().collect()) == sorted(
        {str(r["doc_id"]) for r in got if r["doc_id"] is None or r["doc_id"] == r["component_id"]})
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_trees_find_every_link(spark, tree_nodes):
    rng = np.random.default_rng(3)
    points = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    points += [p ^ (1 << int(a)) ^ (1 << int(b)) for p in points for a, b in rng.integers(0, 64, (3, 2))]
    points = sorted({simhash.signed(p % (1 << 64)) for p in points} | {0, -1, 1, 3})
    tree = simhash.unpack_tree(simhash.pack_tree([p % (1 << 64) for p in points]))
    query = points[5] % (1 << 64)
    assert sorted(simhash.search_tree(tree, query, 2)) == sorted(
        p % (1 << 64) for p in points if (p % (1 << 64) ^ query).bit_count() <= 2)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in points], "fp long"), 2, tree_nodes)
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    groups = reachable(points, lambda a, b: (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 2)
    assert got == {p: min(g) for p, g in groups.items() if len(g) > 1}


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 500 for k in range(500, 560)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language model ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [9_000_000, 3_000])
def test_scores_match_brute_force(spark, odd, odd_rows, none, block_bytes):
    texts = [(i, words(t) + [None]) for i, t, *_ in odd_rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts]
    one, two = collections.Counter(), collections.Counter()
    for (_, w), out in zip(texts, held):
        if not out:
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w))
    total, starts = sum(one.values()), one[None]
    floor = total + 0.1 * (len(one) + 1)
    want = []
    for (i, w), out in zip(texts, held):
        base = sum(math.log10((one[x] + 0.1) / floor) for x in w)
        score = sum(math.log10((two[u, v] + ngram_lm.PRIOR * (one[v] + 0.1) / floor) / (
            (starts if u == "<s>" else one[u]) + ngram_lm.PRIOR)) for u, v in zip(["<s>", *w[:-1]], w))
        want.append((str(i), out, len(w), sum(one[x] > 0 for x in w), total, base, score))
    got = sorted((str(r[0]), *r[1:]) for r in ngram_lm.score_texts(odd, block_bytes=block_bytes).collect())
    for mine, theirs in zip(got, sorted(want), strict=True):
        assert mine[:5] == theirs[:5] and mine[5] == pytest.approx(theirs[5], abs=1e-6)
        assert mine[6] == pytest.approx(theirs[6], abs=2e-4 * theirs[2] + 1e-3)
    assert ngram_lm.score_texts(none).count() == 0


def test_monotone_sequences_round_trip():
    rng = np.random.default_rng(5)
    for top, count in ((10, 100), (10**9, 1000), (5, 1), (0, 7), (1 << 40, 300)):
        values = np.sort(rng.integers(0, top + 1, count))
        assert (ngram_lm.Monotone.encode(values)[np.arange(count)] == values).all()


# --- tokens, mixing, language, decontamination -----------------------------------------------------------------------------

def test_token_counts_equal_the_library_and_fill_the_cache(spark, odd, odd_rows, none):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    cache = scratch_path(spark, "cache")
    assert token_cache.count_tokens(none, path, cache).count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096)
                  for i, t, *_ in odd_rows)
    for _ in range(2):
        got = token_cache.count_tokens(odd, path, cache)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in odd_rows})
    assert stored.count() == stored.select("digest").distinct().count() + 1  # one row repeats id and text
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_cache.count_tokens(odd, other, cache).count() == len(odd_rows)


def test_mixing_equals_sql_and_repeats_documents(spark, odd, none, tmp_path):
    odd.write.parquet(f"file://{tmp_path}/docs")
    sql = mixing.MIXING_SQL.replace("{documents}", f"'{tmp_path}/docs/*.parquet'")
    want = sorted(duckdb.sql(sql).fetchall(), key=str)
    got = mixing.copies_per_document(odd).selectExpr(
        "doc_id", "__size", "__source_size", "__target", "__size * __copies").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(mixing.mix(odd).selectExpr("count(*)").first()) == sum(
        r[0] for r in mixing.copies_per_document(odd).selectExpr("sum(__copies)").collect())
    assert mixing.mix(odd).schema == odd.schema and mixing.copies_per_document(none).count() == 0


def test_language_by_words_and_by_grams(spark, odd, none):
    model = language.train(spark.createDataFrame(
        [(k, text, lang) for k in range(40) for text, lang in (("der hund und die katze", "de"), ("the dog and the cat", "en"))],
        "doc_id long, text string, lang string"))
    scorer = language.Scorer(model)
    assert scorer.predict("the cat")[0] == "en" and scorer.predict("Die Katzen!")[0] == "de"
    assert scorer.predict(None) == ("und", 0.0) and scorer.predict("12 ... 3") == ("und", 0.0)
    assert scorer.predict("щщщ") == ("de", 0.5)  # letters nobody knows
    got = {r["doc_id"]: r for r in language.identify_held_out(odd).collect()}
    assert got[41]["lang_pred"] == got[47]["lang_pred"] == got[43]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify_held_out(none).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(1, 0)).where("lang is null")
    assert {r["lang_pred"] for r in language.identify_held_out(unlabelled).collect()} == {"und"}
    kept = language.keep_identified(odd)
    assert kept.schema == odd.schema and not {41, 43, 47} & {r["doc_id"] for r in kept.collect()}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_decontamination_of_same_and_changed_questions(spark, odd, none):
    item = ("In 1998 the baker Anna sold 24 loaves of bread for 3 dollars each and the miller Boris bought "
            "24 more loaves that she had kept behind the counter.")
    changed = item.replace("1998", "2011").replace("Anna", "Clara").replace("Boris", "David").replace("24", "57")
    crossed = changed.replace("57 more", "58 more")
    bench = spark.createDataFrame([(1, item, "x"), (2, "too short", "x"), (3, "", "x"), (4, None, "x"), (5, prose(77, 6), "x")],
                                  "item_id long, text string, doc_id string")
    filler = prose(70, 40)
    docs = table(spark, [(1, f"{filler} {item} {filler}", "en", "s"), (2, f"{filler}\n{changed}", "en", "s"),
                         (3, f"{filler} {crossed}", "en", "s"), (4, filler, "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"),
                         (7, item.upper().lower(), "en", "s"), (7, item.lower(), "en", "s"), (8, prose(77, 6), "en", "s"),
                         (9, " ".join(item.split()[:9]), "en", "s")])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert {(1, 1), (2, 1), (8, 5)} <= set(got) and not {4, 5, 6, 9} & {d for d, _ in got}
    assert got[1, 1]["coverage"] == 1.0 and not got[1, 1]["changed_slots"] and got[2, 1]["changed_slots"]
    assert (3, 1) not in got or got[3, 1]["coverage"] < 1.0  # 24 stands for 57 and for 58
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.schema == docs.schema and {4, 5, 6, 9} <= {r["doc_id"] for r in kept.collect()}
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_of_long_excerpts(spark):
    item = prose(60, 200)
    parts = item.split()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [prose(61, 40) + " " + " ".join(parts[50:79]) + " " + prose(62, 40), prose(63, 40) + " " + " ".join(parts[50:62]),
             prose(64, 90), " ".join(parts[:150])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["coverage"] for r in decontaminate.matches(docs, bench).collect()}
    assert got == {0: pytest.approx(29 / 200), 3: pytest.approx(150 / 200)}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [1, 2]


def test_folds_of_null_keys(spark):
    frame = spark.createDataFrame([(None,), (5,)], "k long")
    assert [r[0] for r in frame.select(crc_fold(frame["k"], 10)).collect()] == [0, zlib.crc32(b"5") % 10]


def test_lm_counts_are_not_cut_at_32_bits():
    """Two blocks that each saw a word four billion times hear back eight billion, not 2^32 - 1."""
    size = ngram_lm.KEY_BYTES[1]
    hashes = np.array([0x1234_5678_9ABC_DEF0, 0xFEDC_BA98_7654_3210], np.uint64)
    keys = ngram_lm.pack_keys(hashes, 0, size).tobytes()
    requests = pd.DataFrame({"part": [0, 0], "block": [1, 2], "hashes": [keys, keys],
                             "counts": [ngram_lm.planes(np.array([4_000_000_000, 3], np.uint64)),
                                        ngram_lm.planes(np.array([4_000_000_000, 2**40], np.uint64))]})
    replies = ngram_lm.answer(requests)
    for data in replies["counts"]:
        assert ngram_lm.from_planes(data).tolist() == [8_000_000_000, 2**40 + 3]


def test_language_words_are_letters_and_marks():
    assert language.RUN.findall("½ ² Ⅷ 42") == []
    assert language.RUN.findall("नमस्ते café") == ["नमस्ते", "café"]
