"""Phrase collocation mining over a weighted de Bruijn graph of words (operator 12, DataFrame functions only).

Nodes are runs of three words, edges the four-word runs that join two overlapping nodes; only the edges are
counted from the text. The count of a shorter run is the flow out of its node plus the runs that end a piece
(piece-end corrections): f(w1..wk) = sum of f(w1..wk w) over all w, plus the pieces that end in w1..wk. So the
text is read as one edge per word position and three tails per piece, and every count is exact.

The list only needs runs of `LEAST` or more, and a run is no more frequent than any pair of neighbours in it. So
words are counted first, then pairs of frequent words, both as partial sums in the tasks that read them, and
only the edges and tails whose pairs are all frequent travel; the others cannot reach the floor. Frequent words get
numbers, and the text is written once more as places: the numbers of a word and the three behind it. Pairs and edges are counted
from these numbers as partial sums too, and words are put back into what reaches the floor. The frequent words and pairs are staged
and broadcast below a measured size; beyond it the same joins shuffle.

Unary paths (a node with one edge in and one edge out, of equal weight) are compacted: such a node's three-word
run only ever occurs inside one longer run, so it is marked; `unitigs` returns the compacted paths of the
candidate graph as a report of phrases that are always said together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspan.llm.common import LOWER, UPPER, discard, stage, staged_bytes

#: Fixed values of the contract: piece separators (words: blank and tab), the floor of a candidate, the score's scale, the
#: share of a longer candidate that makes a shorter one go, and the size of each language's list.
PIECE_MARKS = ".,;:!?\n\x0B\x0C\r"
LEAST = 30
SCALE = 2_000_000
COVERED_PERCENT = 80
TOP = 2000
#: Rows of one language are first ranked in this many hashed parts, so that no window holds a language whole.
RANK_PARTS = 64
LONGEST = 4
#: Parts per pair of first words: runs with the same two first words are dealt by a hash of their third.
SALTS = 8
#: Frequent words are numbered within this many hashed parts, so that no window holds all; a part has room for 2^31 / ID_PARTS.
ID_PARTS = 1024
#: Bits of such a number; two of them are one positive long.
NUMBER_BITS = 31
#: Staged bytes of frequent words or pairs up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def _pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, w): the words of each piece, none for a blank one; null lang is 'und', null text has no piece."""
    # a text of ASCII alone has no other capitals than A-Z; a translation goes through its characters one by one
    body = F.coalesce(F.col(text), F.lit(""))
    body = F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))
    body = F.replace(body, F.lit("\t"), F.lit(" "))
    pieces = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                         F.explode(F.split(body, f"[{PIECE_MARKS}]")).alias("piece")).where(F.col("piece") != "")
    return pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("w"))


def _run(w: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(w, start, length), " ")


def _events(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, k, g): every four-word edge (k = 4) and the last k = 1..3 words of every piece (its tails)."""
    pieces = _pieces(docs, text, lang)
    positions = F.when(F.size("w") >= LONGEST, F.sequence(F.lit(1), F.size("w") - (LONGEST - 1))) \
        .otherwise(F.array().cast("array<int>"))
    edges = F.transform(positions, lambda i: F.struct(F.lit(LONGEST).alias("k"), _run(F.col("w"), i, LONGEST).alias("g")))
    tails = F.filter(F.array(*[F.when(F.size("w") >= k, F.struct(F.lit(k).alias("k"), _run(F.col("w"), F.lit(-k), k).alias("g")))
                               for k in range(1, LONGEST)]), lambda t: t.isNotNull())
    return pieces.select("lang", F.explode(F.concat(edges, tails)).alias("e")).select("lang", "e.k", "e.g")


def _small(runs: DataFrame, broadcast_bytes: int) -> DataFrame:
    return F.broadcast(runs) if staged_bytes(runs) <= broadcast_bytes else runs


def _ahead(w: str, count: int) -> Column:
    """For each place of `w` the words w1..w<count> from there on, null behind the end of the piece."""
    shifted = [F.col(w) if k == 1 else F.slice(w, F.lit(k), F.size(w)) for k in range(1, count + 1)]
    return F.explode(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(shifted, start=1)])).alias("x")


def frequent_words(docs: DataFrame, text: str, lang: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, g, c, id) of the words from `least` on, id a number of its own for each, and (lang, n) with all word occurrences."""
    pieces = _pieces(docs, text, lang)
    words = pieces.select("lang", F.explode("w").alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("c"))
    rest = F.when(F.col("c") >= least, F.col("g"))
    # the words below the floor are summed up in one row a language, so one pass gives both tables
    words = words.groupBy("lang", rest.alias("g")).agg(F.sum("c").alias("c")) \
        .withColumn("part", F.pmod(F.xxhash64("lang", "g"), F.lit(ID_PARTS)).cast("int"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "g")) - 1
    words = words.withColumn("place", place).select("lang", "g", "c", F.when(
        F.col("place") < (1 << 31) // ID_PARTS, F.col("place") * ID_PARTS + F.col("part")).otherwise(
        F.raise_error(F.lit("more frequent words than numbers")).cast("int")).alias("id"))
    words = stage(words, "collocation-words")
    return words.where(F.col("g").isNotNull()), words.groupBy("lang").agg(F.sum("c").alias("n"))


def numbered_places(docs: DataFrame, words: DataFrame, text: str, lang: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(i1, i2, i3, i4): for each place in the text that begins with two of `words` (lang, g, id) the numbers of the four
    words from there on; null for i3 and i4 that are none of them or behind the end of the piece. Numbers differ by language.

    Words meet by 64 bits of their hash, which is a much faster key than two strings, and are then compared themselves (as
    ranges, since an equality would become part of the key), so words with the same hash are told apart."""
    known = _small(words, broadcast_bytes)
    places = _pieces(docs, text, lang).select("lang", _ahead("w", LONGEST)).select("lang", "x.*").where(F.col("w2").isNotNull())
    for k in range(1, LONGEST + 1):
        numbers = known.select(F.xxhash64("lang", "g").alias(f"h{k}"), F.col("lang").alias(f"l{k}"), F.col("g").alias(f"g{k}"),
                               F.col("id").alias(f"i{k}"))
        same = (F.xxhash64("lang", f"w{k}") == F.col(f"h{k}")) & F.col(f"w{k}").between(F.col(f"g{k}"), F.col(f"g{k}")) \
            & F.col("lang").between(F.col(f"l{k}"), F.col(f"l{k}"))
        places = places.join(numbers, same, "inner" if k <= 2 else "left")
    return stage(places.select(*[f"i{k}" for k in range(1, LONGEST + 1)]), "collocation-places", compression="zstd")


def _pair(first: str, second: str) -> Column:
    """Two numbers of words as one long, which is a shorter key to count and to deal than two integers."""
    return F.shiftleft(F.col(first).cast("long"), NUMBER_BITS).bitwiseOR(F.col(second).cast("long"))


def _unpaired(pair: str, first: str, second: str) -> list[Column]:
    low = F.col(pair).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    return [F.shiftright(pair, NUMBER_BITS).cast("int").alias(first), low.cast("int").alias(second)]


def frequent_pairs(docs: DataFrame, words: DataFrame, text: str, lang: str, least: int,
                   broadcast_bytes: int = BROADCAST_BYTES, places: DataFrame | None = None) -> DataFrame:
    """(lang, g, c, i1, i2) of the pairs from `least` on, counted among pairs of frequent words only; i1, i2: their numbers.
    `places` are the numbered places of docs, if they are there already."""
    if places is None:
        places = numbered_places(docs, words, text, lang, broadcast_bytes)
    counted = places.groupBy(_pair("i1", "i2").alias("p")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least) \
        .select(*_unpaired("p", "i1", "i2"), "c")
    first = words.select("lang", F.col("g").alias("w1"), F.col("id").alias("i1"))
    second = words.select(F.col("g").alias("w2"), F.col("id").alias("i2"))
    named = counted.join(first, "i1").join(second, "i2")
    return stage(named.select("lang", F.concat_ws(" ", "w1", "w2").alias("g"), "c", "i1", "i2"), "collocation-pairs")


def _frequent_edges(places: DataFrame, pairs: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(p, i3, i4, c), p the first two as one long: the longest run of three (null i4) or four words whose pairs are all
    frequent, from each place on. Counted in the tasks that read the places, so a run that comes again there travels once."""
    known = _small(pairs, broadcast_bytes).select("i1", "i2")
    chains = places.where(F.col("i3").isNotNull()).join(known, ["i1", "i2"]).join(known.toDF("i2", "i3"), ["i2", "i3"]) \
        .join(known.toDF("i3", "i4").withColumn("goes_on", F.lit(True)), ["i3", "i4"], "left")
    return chains.select(_pair("i1", "i2").alias("p"), "i3", F.when(F.col("goes_on"), F.col("i4")).alias("i4")) \
        .groupBy("p", "i3", "i4").agg(F.count(F.lit(1)).alias("c"))


def _named(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, g, c): runs of three or four numbers (p, i3, i4, c) as words, put together from their pairs."""
    named = runs.select(*_unpaired("p", "i1", "i2"), "i3", "i4", "c") \
        .join(pairs.select("lang", F.col("g").alias("p1"), "i1", "i2"), ["i1", "i2"])
    for k in (2, 3):
        ahead = pairs.select(F.substring_index("g", " ", -1).alias(f"w{k + 1}"), F.col("i1").alias(f"i{k}"),
                             F.col("i2").alias(f"i{k + 1}"))
        named = named.join(ahead, [f"i{k}", f"i{k + 1}"], "inner" if k == 2 else "left")
    return named.select("lang", F.concat_ws(" ", "p1", "w3", "w4").alias("g"), "c")


def frequent_runs(places: DataFrame, pairs: DataFrame, least: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, m, g, c) for the runs of m = 3 or 4 words from `least` on, as run_counts gives them: a node's count is the flow
    of the edges leaving it plus the chains ending in it. Both are summed by number; only what reaches `least` gets words."""
    edges = _frequent_edges(places, pairs, broadcast_bytes)
    nodes = edges.groupBy("p", "i3").agg(F.sum("c").alias("c")).withColumn("i4", F.lit(None).cast("int")).where(F.col("c") >= least)
    # one condition on both columns: a test of i4 alone would be moved below the count, which would then differ from the
    # nodes' count, and the places would be read and dealt twice
    fours = edges.where(F.when(F.col("i4").isNotNull(), F.col("c")).otherwise(F.lit(0)) >= F.greatest(F.lit(least), F.lit(1)))
    runs = nodes.unionByName(fours)
    return _named(runs, pairs).select("lang", F.size(F.split("g", " ")).alias("m"), "g", "c")


def graph(docs: DataFrame, text: str = "text", lang: str = "lang", pairs: DataFrame | None = None,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, p2, s, k, g, c): the weighted edges (k = 4) and piece tails (k < 4) with their counts.

    With `pairs` (lang, g, i1, i2), the frequent ones, only edges of frequent pairs and the ends of such chains are there, from
    which the counts of runs of three and four words follow.

    Without pairs, the one exchange of the text deals rows by their first two words and a hash of the third (SALTS parts),
    so an edge, and every node of three words with all edges leaving it, meet in one task. Only (lang, g) travel:
    the part and k are computed from g on both sides."""
    p2 = F.substring_index("g", " ", 2)
    part = F.pmod(F.xxhash64(F.coalesce(F.try_element_at(F.split("g", " "), F.lit(3)), F.lit(""))), F.lit(SALTS))
    if pairs is None:
        events = _events(docs, text, lang).select("lang", "g")
        counted = events.repartition("lang", p2, part).groupBy("lang", p2, part, "g").agg(F.count(F.lit(1)).alias("c"))
    else:
        ends = [pairs.select("lang", F.substring_index("g", " ", at).alias("g"), F.col(number).alias("id"))
                for at, number in ((1, "i1"), (-1, "i2"))]
        places = numbered_places(docs, ends[0].union(ends[1]).distinct(), text, lang, broadcast_bytes)
        counted = _named(_frequent_edges(places, pairs, broadcast_bytes), pairs).select("lang", p2, part, "g", "c")
    return counted.toDF("lang", "p2", "s", "g", "c").withColumn("k", F.size(F.split("g", " ")))


def run_counts(edges: DataFrame, least: int = 1) -> DataFrame:
    """(lang, m, g, c) for runs of m = 1..4 words. A node's count is the flow of the edges leaving it plus the
    pieces ending in it, f(x) = sum f(x w) + tails(x); unrolled, every edge and tail adds its count to each of
    its prefixes. Runs of three and four words are complete in their task, so those below `least` are left out
    there; the sums of one and two words are partial (their edges went to several parts) and are added up in a
    second exchange, reduced map-side. Runs of one word are all returned; longer ones only from `least` on."""
    prefixes = edges.select("lang", "p2", "s", "c", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("k")), lambda m: F.struct(m.alias("m"), _run(F.split("g", " "), F.lit(1), m).alias("x")))).alias("x"))
    local = prefixes.groupBy("lang", "p2", "s", F.col("x.m").alias("m"), F.col("x.x").alias("g")).agg(F.sum("c").alias("c"))
    reduced = local.where((F.col("m") <= 2) | (F.col("c") >= least))
    counts = reduced.groupBy("lang", "m", "g").agg(F.sum("c").alias("c"))
    return counts.where((F.col("m") == 1) | (F.col("c") >= least)).select(
        "lang", F.col("m").cast("int").alias("m"), "g", F.col("c").cast("long").alias("c"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each language's `top` phrases of 2 to 4 words by the score of their weakest cut.

    a = f(phrase) >= least; a cut after k words scores floor(SCALE * a / (f(left) + f(right))), exactly (decimal
    products); the lowest score counts, ties to the smallest k. A candidate whose words lie contiguously inside a
    longer candidate of at least COVERED_PERCENT % of its count goes. Returns lang, rank, phrase, a, l, r, n, score.

    Odd rows: null text is empty, null lang is 'und'; a language without a candidate has no row; repeated rows
    count each time; equal scores are ordered by a, then phrase in UTF-8 byte order; only the text and lang
    columns are read, so other columns of any name are ignored. An empty table gives an empty result.
    """
    # the frequent runs: one small table, staged so that the text is dealt once
    known, words = frequent_words(docs, text, lang, least)
    places = numbered_places(docs, known, text, lang, broadcast_bytes)
    pairs = frequent_pairs(docs, known, text, lang, least, broadcast_bytes, places)
    longer = frequent_runs(places, pairs, least, broadcast_bytes)
    shorter = [runs.select("lang", F.lit(m).alias("m"), "g", "c") for m, runs in ((1, known), (2, pairs))]
    frequent = stage(shorter[0].unionByName(shorter[1]).unionByName(longer), "collocation-counts")
    discard(places)
    candidates = frequent.where(F.col("m") >= 2).select("lang", "m", F.col("g").alias("phrase"), F.col("c").alias("a"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("right", F.expr("substring_index(phrase, ' ', k - m)"))
    part = frequent.select("lang", "g", "c")
    cuts = cuts.join(part.withColumnRenamed("g", "left").withColumnRenamed("c", "l"), ["lang", "left"]) \
        .join(part.withColumnRenamed("g", "right").withColumnRenamed("c", "r"), ["lang", "right"])
    score = F.expr(f"cast(cast(a as decimal(38,0)) * {SCALE} div cast(l + r as decimal(38,0)) as long)")
    best = cuts.groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")) \
        .select("lang", "phrase", "m", "a", "b.score", "b.l", "b.r")

    # the shorter runs inside each longer candidate, with that candidate's count
    sub = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("m") - size + 1), lambda s: _run(F.split("phrase", " "), s, size))))
    inside = candidates.where(F.col("m") >= 3).select("lang", F.explode(F.array_distinct(sub)).alias("phrase"),
                                                      F.col("a").alias("outer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(inside, ["lang", "phrase"], "left") \
        .where(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * COVERED_PERCENT)).drop("outer")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part_key = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("__p", F.row_number().over(Window.partitionBy("lang", part_key).orderBy(*order))) \
        .where(F.col("__p") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def unitigs(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Compacted unary paths of the graph of frequent four-word edges: (lang, node, unary) where unary says the
    node's three words have one frequent edge in, one out, and occur nowhere else (its count equals the edge's).
    Such nodes are interior to a longer run and can be merged away without changing any count."""
    edges = counts.where((F.col("m") == LONGEST) & (F.col("c") >= least))
    nodes = counts.where(F.col("m") == LONGEST - 1).select("lang", F.col("g").alias("node"), F.col("c").alias("f"))
    outs = edges.groupBy("lang", F.substring_index("g", " ", LONGEST - 1).alias("node")) \
        .agg(F.count(F.lit(1)).alias("d_out"), F.max("c").alias("w_out"))
    ins = edges.groupBy("lang", F.substring_index("g", " ", 1 - LONGEST).alias("node")) \
        .agg(F.count(F.lit(1)).alias("d_in"), F.max("c").alias("w_in"))
    joined = nodes.join(outs, ["lang", "node"]).join(ins, ["lang", "node"])
    unary = (F.col("d_in") == 1) & (F.col("d_out") == 1) & (F.col("w_in") == F.col("f")) & (F.col("w_out") == F.col("f"))
    return joined.select("lang", "node", "f", unary.alias("unary"))


def oracle_sql(documents: str = "documents", least: int = LEAST, top: int = TOP) -> str:
    """The same list in DuckDB SQL, counting every run of 1 to 4 words directly."""
    upper = "".join(chr(c) for c in range(65, 91))
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t
           FROM {documents}),
p AS (SELECT lang, row_number() OVER () AS pid, piece
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
pw AS (SELECT lang, pid, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
ws AS (SELECT lang, pid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM pw),
seq AS (SELECT lang, word AS w1, lead(word, 1) OVER win AS w2, lead(word, 2) OVER win AS w3, lead(word, 3) OVER win AS w4
        FROM ws WINDOW win AS (PARTITION BY pid ORDER BY s)),
g AS (SELECT lang, 1 AS m, w1 AS phrase FROM seq
      UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM seq WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM seq WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM seq WHERE w4 IS NOT NULL),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
nn AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a FROM counts WHERE m >= 2 AND f >= {least}),
cuts AS (SELECT c.lang, c.phrase, c.m, c.a, k,
                array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS lp,
                array_to_string(string_split(c.phrase, ' ')[k + 1:c.m], ' ') AS rp
         FROM cand c JOIN (VALUES (1), (2), (3)) AS ks(k) ON k < c.m),
scored AS (SELECT u.lang, u.phrase, u.m, u.a, u.k, lc.f AS l, rc.f AS r,
                  CAST((CAST(u.a AS HUGEINT) * {SCALE}) // (lc.f + rc.f) AS BIGINT) AS score
           FROM cuts u JOIN counts lc ON lc.lang = u.lang AND lc.phrase = u.lp
                       JOIN counts rc ON rc.lang = u.lang AND rc.phrase = u.rp),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM scored) WHERE q = 1),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (
           SELECT 1 FROM cand o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.a >= {COVERED_PERCENT} * b.a
             AND strpos(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') > 0)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(nn.n AS BIGINT) AS n, score
FROM ranked JOIN nn ON nn.lang = ranked.lang WHERE rank <= {top}
"""
