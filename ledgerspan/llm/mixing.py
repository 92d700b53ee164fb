"""Mixing sources to target weights (operator 7, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspan.llm.common import WORD_PATTERN

WEIGHTS = (5, 2, 1)
SHARE, LIMIT, SEED = 1.5, 2.0, 7


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by key and seed: the first 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source: source_size, target and rate.

    Sources in code point order, null last, weigh `weights` in turn. Together they take `share` of all words;
    no target is above `limit` times its source's size. The excess goes to the others by weight, which ends at
    one level for all that are not full: in order of limit * size / weight, a source is full if the level
    left by those before it reaches its own. Windows only see one row per source.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("room", limit * F.col("source_size"))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
             ) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level)
    common = F.max(F.when(F.col("level") < F.col("room") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("room"), F.coalesce(common * F.col("weight"), F.col("room")))
    return leveled.withColumn("target", target).select(
        F.col("source").alias("__source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies_per_document(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT,
                        seed: int = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __copies = floor(rate) plus one hash-seeded Bernoulli copy.

    Nulls: a null text has size 0, null sources are one source, a null doc_id draws like the empty text.
    Repeated rows each count and draw alike. An empty table stays empty. Other columns pass through.
    """
    sized = docs.withColumn("__size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col("__size").alias("size")), weights, share, limit)
    whole = F.floor("rate")
    draw = (hash_uniform(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["__source"]))
    return joined.select(*[sized[c] for c in docs.columns], "__size", F.col("source_size").alias("__source_size"),
                         F.col("target").alias("__target"), (whole + draw).cast("int").alias("__copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as copies_per_document says, columns as they came."""
    counted = copies_per_document(docs, **options)
    return counted.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(
        *docs.columns)


#: The query's rows in DuckDB SQL over a table or subquery {documents}.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM {documents}
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS room,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sources
), leveled AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(room) OVER (ORDER BY room / weight, source ASC NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY room / weight, source ASC NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size,
         least(room, coalesce(max(CASE WHEN level < room / weight THEN level END) OVER () * weight, room)) AS target
  FROM leveled
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
           / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
