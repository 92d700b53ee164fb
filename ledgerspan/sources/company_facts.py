"""Filing-fact documents to the facts table.

A document nests taxonomy -> tag -> unit -> datapoints, with tags and units as object keys. Both
levels are read as maps and turned into rows with generators, so new tags need no schema change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspan.functions.numbers import known
from ledgerspan.schemas import COMPANY_FACTS, FACTS
from ledgerspan.settings import Settings


def read_documents(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Read a raw zone. `multi_line=False` takes one document per line, which splits inside files.

    A document that is not valid JSON stops the read: nothing is dropped silently.
    """
    return (spark.read.schema(COMPANY_FACTS)
            .option("multiLine", multi_line).option("mode", "FAILFAST").json(path))


def parse_documents(texts: DataFrame, column: str = "document") -> DataFrame:
    """The same documents from a text column."""
    parsed = F.from_json(column, COMPANY_FACTS, {"mode": "FAILFAST"})
    return texts.select(parsed.alias("parsed")).select("parsed.*")


def cik_text(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def flatten(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per datapoint with the dates still as text. Missing levels give no rows."""
    return (documents
            .select(cik_text(F.col("cik")).alias("cik"),
                    F.explode(F.col("facts")[settings.taxonomy]).alias("concept", "body"))
            .select("cik", "concept", F.explode("body.units").alias("unit", "points"))
            .select("cik", "concept", "unit", F.inline("points"))
            .select("cik", "concept", "unit",
                    F.col("start").alias("period_start"), F.col("end").alias("period_end"),
                    F.col("val").alias("value"), F.col("fy").alias("fiscal_year"),
                    F.col("fp").alias("fiscal_period"), "form", "filed", "frame", "accn"))


def typed(flat: DataFrame) -> DataFrame:
    """Dates parsed (unreadable ones become NULL), NaN amounts made NULL, length in days."""
    as_date = {name: F.try_to_date(F.col(name), "yyyy-MM-dd")
               for name in ("period_start", "period_end", "filed")}
    return (flat.withColumns({**as_date, "value": known(F.col("value"))})
            .withColumn("duration_days", F.datediff("period_end", "period_start"))
            .select(*FACTS.fieldNames()))


def facts_from(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return typed(flatten(documents, settings))


def companies_from(documents: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """The company dimension. Tickers are not part of the documents and may be joined in."""
    named = (documents.groupBy(cik_text(F.col("cik")).alias("cik"))
             .agg(F.max("entityName").alias("entity_name")))
    if tickers is None:
        return named.select("cik", F.lit(None).cast("string").alias("ticker"), "entity_name")
    return named.join(tickers.select("cik", "ticker"), "cik", "left").select(
        "cik", "ticker", "entity_name")


def to_documents(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Facts back to document text, one document per filing so that no document is unbounded.

    Facts are dealt once by filing; tags and documents are then put together where they lie. A tag has few units.
    """
    point = F.struct(
        F.date_format("period_start", "yyyy-MM-dd").alias("start"),
        F.date_format("period_end", "yyyy-MM-dd").alias("end"),
        F.col("value").alias("val"), "accn", F.col("fiscal_year").alias("fy"),
        F.col("fiscal_period").alias("fp"), "form",
        F.date_format("filed", "yyyy-MM-dd").alias("filed"), "frame")
    by_concept = (facts.repartition("cik", "accn").groupBy("cik", "accn", "concept")
                  .agg(F.collect_list(F.struct("unit", point.alias("point"))).alias("entries")))

    def points(unit: Column) -> Column:
        own = F.filter("entries", lambda entry: entry["unit"] == unit)
        return F.struct(unit.alias("unit"), F.transform(own, lambda entry: entry["point"]).alias("points"))

    units = F.map_from_entries(F.transform(F.array_distinct(F.col("entries.unit")), points))
    by_concept = by_concept.select("cik", "accn", "concept", units.alias("units"))
    by_filing = (by_concept.groupBy("cik", "accn")
                 .agg(F.map_from_entries(F.collect_list(
                     F.struct("concept", F.struct("units")))).alias("concepts")))
    document = F.to_json(F.struct(
        F.col("cik").cast("bigint").alias("cik"),
        F.concat(F.lit("Company "), F.col("cik")).alias("entityName"),
        F.create_map(F.lit(settings.taxonomy), F.col("concepts")).alias("facts")))
    return by_filing.select("cik", "accn", document.alias("document"))
