"""URL filter by the ratio of two character language models (operator 1, DataFrame functions only).

Two variable-order Markov models over URL characters, one of accepted and one of rejected URLs, are trained on
the URLs that a list of rules decides. Every URL without a rule is judged by the difference of the two
log-likelihoods per character against a calibrated threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspan.llm.common import ascii_lower, stage, staged_bytes

ORDERS = 6
#: Weight of the shorter context in a smoothed probability, and the size of the alphabet below all contexts.
PRIOR, ALPHABET = 2.0, 256
#: Gram values, as written, up to which they go to every task; beyond it positions and grams meet in a shuffle.
BROADCAST_BYTES = 64 << 20
#: One labelled URL in so many is held out of training for the threshold.
CALIBRATION_FOLD = 5
#: Scores per character are counted in bins of 1 / BINS for the threshold, within -LIMIT to LIMIT.
BINS, LIMIT = 200, 10


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest fitting rule, or null. rules: (verdict, host/path)."""
    fits = []
    for verdict, rule in rules:
        rule_host, slash, rest = rule.partition("/")
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(fit, found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def spelling(url: Column) -> Column:
    """What the models read: the URL behind its scheme, lower-case, digits as one, with a start mark."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[\s\S]*?://", "")
    return F.concat(F.lit("^"), F.translate(rest, "123456789", "000000000"))


def gram_counts(labelled: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(gram, order, na, nr): how often accepted and rejected URLs hold each gram that ends at a character."""
    ends = labelled.select("s", "accepted", F.explode(F.sequence(F.lit(2), F.greatest(F.length("s"), F.lit(2)))).alias("i"))
    ends = ends.where(F.col("i") <= F.length("s"))
    gram = F.explode(F.array(*[F.when(F.col("i") >= o, F.expr(f"substring(s, i - {o - 1}, {o})"))
                               for o in range(1, orders + 1)]))
    return ends.select("accepted", gram.alias("gram")).where("gram is not null").groupBy("gram").agg(
        F.sum("accepted").alias("na"), F.sum(1 - F.col("accepted")).alias("nr")).withColumn("order", F.length("gram"))


def context_totals(counts: DataFrame) -> DataFrame:
    """(context, ta, tr): how often accepted and rejected URLs hold each context, the empty one included."""
    context = F.substring("gram", 1, F.col("order") - 1)
    return counts.groupBy(context.alias("context")).agg(F.sum("na").alias("ta"), F.sum("nr").alias("tr"))


def smoothed(counts: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(gram, order, seen, llr): log ratio of the smoothed probabilities of a gram's last character after the others.

    p(c | context) = (n(context c) + PRIOR * p(c | shorter context)) / (n(context) + PRIOR), down to a uniform
    distribution over ALPHABET characters.
    """
    context = F.substring("gram", 1, F.col("order") - 1)
    all_ = counts.withColumn("context", context).join(context_totals(counts), "context")

    def with_lower(level: DataFrame, lower_a: Column, lower_r: Column) -> DataFrame:
        return level.select(
            "gram", "order", (F.col("na") + F.col("nr")).alias("seen"),
            ((F.col("na") + PRIOR * lower_a) / (F.col("ta") + PRIOR)).alias("pa"),
            ((F.col("nr") + PRIOR * lower_r) / (F.col("tr") + PRIOR)).alias("pr"))

    level = with_lower(all_.where("order = 1"), F.lit(1.0 / ALPHABET), F.lit(1.0 / ALPHABET))
    levels = [level]
    for order in range(2, orders + 1):
        below = level.select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        here = all_.where(F.col("order") == order).withColumn("suffix", F.expr(f"substring(gram, 2, {order - 1})"))
        level = stage(with_lower(here.join(below, "suffix"), F.col("la"), F.col("lr")), "url-level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select("gram", "order", "seen", F.log(F.col("pa") / F.col("pr")).alias("llr"))


def gram_values(ends: DataFrame, model: DataFrame, totals: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(g, value) for each distinct g of ends: the log ratio of both models for g's last character after the rest.

    Every gram of the model is there, none is dropped. Seen grams are closed under suffixes, so the longest seen
    suffix of g gives the smoothed ratio, and each longer suffix that neither model has multiplies both probabilities
    by PRIOR / (n(its context) + PRIOR), which is 1 for an unseen context. A character unseen in both models backs
    off from the uniform distribution, whose ratio is 0.
    """
    grams = ends.select("g").distinct()
    suffixes = grams.select("g", F.explode(F.sequence(F.lit(1), F.length("g"))).alias("order")).withColumn(
        "gram", F.expr("substring(g, length(g) - order + 1, order)")).withColumn(
        "context", F.expr("substring(gram, 1, order - 1)"))
    found = suffixes.join(model.select("gram", "llr"), "gram", "left").join(totals, "context", "left")
    hit = F.col("llr").isNotNull()
    weight = F.log((F.coalesce("tr", F.lit(0)) + PRIOR) / (F.coalesce("ta", F.lit(0)) + PRIOR))
    return found.groupBy("g").agg(
        (F.coalesce(F.max_by(F.when(hit, F.col("llr")), F.when(hit, F.col("order"))), F.lit(0.0))
         + F.coalesce(F.sum(F.when(~hit, weight)), F.lit(0.0))).alias("value"))


def with_score(urls: DataFrame, model: DataFrame, totals: DataFrame, orders: int = ORDERS,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """urls (s, ...) with `score`: the mean log ratio per character after the first, each character read after up to
    orders - 1 characters before it. The distinct grams of the URLs are valued once, against the whole model."""
    keyed = stage(urls.withColumn("__row", F.monotonically_increasing_id()), "url-rows")
    place = F.explode(F.when(F.length("s") >= 2, F.sequence(F.lit(2), F.length("s"))).otherwise(F.array().cast("array<int>")))
    ends = keyed.select("__row", "s", place.alias("i")).select(
        "__row", F.expr(f"substring(s, greatest(1, i - {orders - 1}), least(i, {orders}))").alias("g"))
    values = stage(gram_values(ends, model, totals, orders), "url-gram-values")
    if staged_bytes(values) <= broadcast_bytes:
        values = F.broadcast(values)
    sums = ends.join(values, "g").groupBy("__row").agg(F.sum("value").alias("__total"))
    per_char = F.coalesce(F.col("__total"), F.lit(0.0)) / F.greatest(F.length("s") - 1, F.lit(1))
    return keyed.join(sums, "__row", "left").withColumn("score", per_char).drop("__row", "__total")


def threshold_of(scored: DataFrame) -> DataFrame:
    """One row, `threshold`: the bin edge with the best balanced accuracy on (score, accepted); 0 if one class is missing.

    Among equally good edges the middle one counts. Scores are counted in at most 2 * BINS * LIMIT + 1 bins.
    """
    bin_ = F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(-BINS * LIMIT)), F.lit(BINS * LIMIT))
    bins = scored.groupBy(bin_.alias("bin")).agg(F.sum("accepted").alias("na"), F.sum(1 - F.col("accepted")).alias("nr"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    rated = bins.select(
        "bin", F.sum("na").over(all_).alias("ta"), F.sum("nr").over(all_).alias("tr"),
        F.coalesce(F.sum("na").over(below), F.lit(0)).alias("ba"), F.coalesce(F.sum("nr").over(below), F.lit(0)).alias("br"),
        F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin")).alias("last"))
    gain = F.round(1 - F.col("ba") / F.col("ta") + F.col("br") / F.col("tr"), 9)
    edge = (F.col("bin") + F.col("last") + 1) / F.lit(2.0 * BINS)
    best = rated.where("ta > 0 and tr > 0").agg(F.max_by(edge, F.struct(gain, -F.abs("bin"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(0.0)).alias("threshold"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], orders: int = ORDERS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url).

    The rules are a short list of the caller's. Training counts grams in a partial aggregate, so a host with a
    third of all rows costs no more than others; the whole model is kept, and each distinct gram of the URLs is
    valued once in a join with it. A null or empty URL has neither rule nor likelihood and is blocked. Repeated
    rows each get a row. Without labelled URLs of both kinds the threshold is 0, and a score of 0 allows.
    """
    url = F.col("url")
    read = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    read = read.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("s", spelling(url))
    labelled = read.where("found is not null").select(
        "s", (F.col("found.verdict") == "allow").cast("long").alias("accepted"),
        (F.pmod(F.xxhash64("s"), F.lit(CALIBRATION_FOLD)) == 0).alias("held"))
    counts = stage(gram_counts(labelled.where(~F.col("held")), orders), "url-grams")
    model = stage(smoothed(counts, orders), "url-model")
    totals = stage(context_totals(counts), "url-contexts")
    rated = with_score(labelled.where("held").select("accepted", "s"), model, totals, orders)
    threshold = stage(threshold_of(rated), "url-threshold")
    scored = with_score(read, model, totals, orders)
    allowed = (F.length("s") > 1) & (F.col("score") >= threshold.scalar())
    verdict = F.coalesce(F.col("found.verdict"), F.when(allowed, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
