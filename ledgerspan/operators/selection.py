"""Predicates on facts and whole-table selections that do not depend on statement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.numbers import billions
from ledgerspan.functions.pick import latest_filed
from ledgerspan.settings import SAMPLE_CONCEPTS, Settings


def in_unit(facts: DataFrame, settings: Settings) -> DataFrame:
    return facts if settings.unit is None else facts.filter(F.col("unit") == settings.unit)


def is_annual_filing() -> Column:
    return (F.col("form") == "10-K") & (F.col("fiscal_period") == "FY")


def is_periodic_filing() -> Column:
    return F.col("form").isin("10-Q", "10-K")


def is_instant() -> Column:
    return F.col("period_start").isNull()


def spans_full_year(settings: Settings) -> Column:
    days = F.col("duration_days")
    return days.isNull() | (days >= settings.annual_min_days)


def dedup_facts(facts: DataFrame) -> DataFrame:
    """Last filed version per (tag, unit, start, end); missing starts are equal to each other.

    A version without a filing date counts as the newest here.
    """
    keys = ["concept", "cik", "period_end", "unit", "period_start"]
    rest = [name for name in facts.columns if name not in keys]
    return latest_filed(facts, keys, rest, missing_date_wins=True).select(*facts.columns)


def annual_facts_by_tag(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Full-year facts whose *filing year tag* is among the company's last N distinct tags.

    Only the distinct (company, tag) pairs are ranked, never the facts.
    """
    annual = facts.filter(is_annual_filing() & spans_full_year(settings))
    newest = Window.partitionBy("cik").orderBy(F.desc("fiscal_year"))
    kept = (annual.filter(F.col("fiscal_year").isNotNull()).select("cik", "fiscal_year").distinct()
            .withColumn("place", F.row_number().over(newest))
            .filter(F.col("place") <= settings.years_history).select("cik", "fiscal_year"))
    return annual.join(kept, ["cik", "fiscal_year"], "left_semi").select(*facts.columns)


def headline_sample(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Allow-listed tags per calendar year of the period end, in billions."""
    sample = annual_facts_by_tag(dedup_facts(facts), settings).filter(
        F.col("concept").isin(*SAMPLE_CONCEPTS))
    last = F.max_by("value", F.struct("period_end", "filed", "accn", "unit", "period_start"))
    return (sample.groupBy("cik", "concept", F.year("period_end").alias("year"))
            .agg(last.alias("value"))
            .select("cik", "concept", "year", billions(F.col("value")).alias("value_billions")))


def ingest_summary(facts: DataFrame) -> DataFrame:
    """Per company: distinct tags and fact rows."""
    return facts.groupBy("cik").agg(F.countDistinct("concept").alias("n_concepts"),
                                    F.count("*").alias("n_facts"))
