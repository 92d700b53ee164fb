"""Operators on pages and vectors, and the pipeline."""

import math

import numpy as np
import pytest

import corpus_pipeline
from ledgerspan.llm import hnsw, html_text, url_filter
from ledgerspan.llm.queries import URL_RULES

PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><div id="cookie-notice">We use cookies &amp; more</div>
<ul class="main-menu"><li><a href="/">Home</a><li><a href="/b">About us</a></ul>
{open}<h1>Head &amp; line</h1><p><b>First words of a longer paragraph that says something.<br><p>Second&nbsp;paragraph
 with <i>in</i>line parts, 3 &lt; 4, and a good deal more to read than any menu has.</p>
<div class="ad">Buy now</div><form><label>Mail</label><input></form><p>Short.</p>
<table><tr><td>cell one<td>cell two</table>{close}
<aside>Side</aside><div class="comments"><p>A reader thinks that this comment is long enough to look like text.</p></div>
<footer>&copy; 2020</footer>"""
TEXT = ("Head & line First words of a longer paragraph that says something. Second paragraph with inline parts, 3 < 4, "
        "and a good deal more to read than any menu has. Short. cell one cell two")


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html_text.main_text(PAGE.format(open=f"<{tag}>", close=f"</{tag}>")) == TEXT


def test_main_text_of_odd_pages():
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "<script>x</script>", "<nav>menu</nav>")] == [""] * 5
    assert html_text.main_text("plain  text\n here") == "plain text here"
    assert html_text.main_text("<p>cut &am") == "cut &am"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_extract_text_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.format(open="<article>", close="</article>"), "t"), (1, "u", None, "t"),
                                   (None, None, "", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted(
        [("1", TEXT, len(TEXT)), ("1", "", 0), ("None", "", 0)])
    assert html_text.extract_text(pages.limit(0)).count() == 0


# --- URLs -----------------------------------------------------------------------------------------------------------------

def test_hosts_paths_and_rules(spark):
    cases = {
        "https://WWW.Example.COM/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://b.com": ("b.com", "", None, None), "http://b.com/": ("b.com", "/", "com/", "allow"),
        "http://notcom/": ("notcom", "/", None, None), "x://y.net/es/?a=://q": ("y.net", "/es/", "net/es/", "block"),
        "no scheme": ("", "", None, None), "": ("", "", None, None), "a://": ("", "", None, None),
        "http://c.net?d=/es/": ("c.net", "", None, None), "http://e.net#/fr/": ("e.net", "", None, None)}
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*cases, None, *cases])],
                                  "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, URL_RULES, orders=3).collect()
    assert len(got) == 2 * len(cases) + 1
    urls = [*cases, None, *cases]
    for r in got:
        host, path, rule, verdict = cases.get(urls[r["page_id"]], ("", "", None, "block"))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_filter.judge_urls(pages.limit(0), URL_RULES, orders=2).count() == 0


def test_scores_equal_the_likelihood_ratio_of_two_markov_models(spark):
    rows = [("^good.site/a", 1), ("^good.site/b", 1), ("^bad.site/x", 0), ("^bad.site/yy", 0), ("^bad.site/x", 0)]
    orders, table = 3, {}
    for s, y in rows:
        for i in range(1, len(s)):
            for o in range(1, min(orders, i + 1) + 1):
                table.setdefault(s[i - o + 1:i + 1], [0, 0])[1 - y] += 1

    def probability(gram, kind):
        if not gram:
            return 1 / url_filter.ALPHABET
        context = sum(v[kind] for g, v in table.items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (table.get(gram, [0, 0])[kind] + url_filter.PRIOR * probability(gram[1:], kind)) / (context + url_filter.PRIOR)

    def score(s):
        total = 0.0
        for i in range(1, len(s)):
            gram = s[max(0, i - orders + 1):i + 1]
            total += math.log(probability(gram, 0) / probability(gram, 1))
        return total / max(len(s) - 1, 1)

    counts = url_filter.gram_counts(spark.createDataFrame(rows, "s string, accepted long"), orders)
    model, totals = url_filter.smoothed(counts, orders), url_filter.context_totals(counts)
    asked = ["^good.site/b", "^bad.site/zz", "^", "", "^new", "^" + "good" * 300, "^goox", "^bad.site/x"]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(asked * 2)], "k int, s string")
    got = {r["k"]: r["score"] for r in url_filter.with_score(frame, model, totals, orders).collect()}
    assert len(got) == 2 * len(asked)
    assert [got[k] for k in range(2 * len(asked))] == pytest.approx([score(s) for s in asked * 2], abs=1e-9)


def test_threshold_parts_the_classes(spark):
    rows = [(-2.0, 0), (-1.0, 0), (-0.5, 0), (0.5, 1), (3.0, 1)]
    found = url_filter.threshold_of(spark.createDataFrame(rows, "score double, accepted long")).first()[0]
    assert -0.5 < found <= 0.5
    assert url_filter.threshold_of(spark.createDataFrame(rows[:3], "score double, accepted long")).first()[0] == 0


# --- vectors ------------------------------------------------------------------------------------------------------------

def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 16)))]
    for group in range(6):  # groups of near copies, one of them larger than a beam
        centre = rng.normal(size=16)
        rows += [(1000 + 200 * group + k, (centre + rng.normal(size=16) * 0.05).tolist()) for k in range(120 if not group else 8)]
    rows += [(5000 + k, rows[3][1]) for k in range(40)] + [(6000, [2 * x for x in rows[3][1]])]
    odd = [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [1.0, None] * 8),
           (7005, [float("inf")] + [1.0] * 15), (7006, [1.0, 0.0]), (7007, [1.0, 0.01])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, n string")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(frame).collect()}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = np.array([i for i, _ in good])
    low = ids.copy()
    while True:
        after = np.array([min(low[k], *low[linked[k]]) if linked[k].any() else low[k] for k in range(len(low))])
        if (after == low).all():
            break
        low = after
    for i, n, c in zip(ids.tolist(), linked.sum(1).tolist(), low.tolist()):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c)
    for i, _ in odd[:6]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[7006]["n_links"] == 1 and got[7007]["component_id"] == 7006
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def rare_pairs():
    rng = np.random.default_rng(5)
    lone = rng.normal(size=(3000, 32))
    near = lone[:50] + rng.normal(size=(50, 32)) * 0.2
    rows = np.concatenate([lone, near])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return rows, (unit @ unit.T >= 0.9).sum(1) - 1


@pytest.mark.parametrize("options", [{"audit": 4, "recall": 1.0}, {"recall": 1.0, "widenings": 0}])
def test_vectors_with_rare_links_are_audited_and_found(spark, options):
    rows, expected = rare_pairs()
    assert 0 < (expected > 0).sum() < hnsw.LINKED
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(frame, beam=1, least_shards=2, **options).collect()}
    assert [got[k] for k in range(len(rows))] == expected.tolist()


def test_pairs_count_for_both_ends():
    pairs = hnsw.Pairs(3, 10, False)
    pairs.add(1, np.array([2, 9]))
    pairs.add_back(9, np.array([1, 2]))
    assert [(r, p.tolist()) for r, p in pairs] == [(1, [2, 9]), (2, [9])]
    pairs = hnsw.Pairs(4, 4, True)
    pairs.add(0, np.array([0, 3]))
    assert [(r, p.tolist()) for r, p in pairs] == [(0, [3]), (3, [0])]


# --- pipeline -----------------------------------------------------------------------------------------------------------

def test_pipeline_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stage(function(spark, kept, sf), f"test-{name}")
        assert kept.schema == docs.schema
    assert 0 < kept.count() < docs.count()
    assert corpus_pipeline.run(spark, sf).count() >= kept.count()
    nothing = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, nothing, sf).count() == 0


def test_html_region_keeps_title_lead_end_and_every_article():
    body = "".join(f"<p>Paragraph {k} of the story goes on with plenty of words in it.</p>" for k in range(30))
    page = ("<html><body><nav><a href='/'>Home</a></nav><div class='post'><h1>The Title</h1><p>A short lead.</p>"
            f"<div class='body'>{body}</div><p>The end.</p></div><footer>(c) site</footer></body></html>")
    text = html_text.main_text(page)
    assert text.startswith("The Title A short lead. Paragraph 0") and text.endswith("Paragraph 29 of the story goes on "
                                                                                     "with plenty of words in it. The end.")
    assert "Home" not in text and "(c) site" not in text
    two = ("<body><article><p>" + "Long first article text here. " * 40 + "</p></article>"
           "<article><p>Second, short article.</p></article></body>")
    assert html_text.main_text(two).endswith("Second, short article.")
