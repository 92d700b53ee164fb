"""Standalone quarters from year-to-date filings, the quarter spine and quarterly lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.labels import quarter_label
from ledgerspan.functions.pick import latest_filed
from ledgerspan.operators.mapping import map_to_lines
from ledgerspan.operators.selection import in_unit, is_instant, is_periodic_filing
from ledgerspan.settings import Settings

DAYS_PER_QUARTER = 91.3


def fy_starts(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Dates on which a fiscal year starts: only those carry a fact of half a year or longer."""
    return (facts.filter(F.col("period_start").isNotNull() & is_periodic_filing()
                         & (F.col("duration_days") >= settings.fiscal_start_min_days))
            .select("cik", "period_start").distinct())


def flow_cumulative(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Year-to-date amounts, last filed version per (tag, start, end).

    Versions are reduced before the fiscal-year-start test. The starts are distinct, so an inner
    join equals a semi join, and unlike one it is not moved below the aggregation, where it would
    shuffle every version.
    """
    candidates = in_unit(facts, settings).filter(
        is_periodic_filing() & F.col("period_start").isNotNull()
        & F.col("duration_days").between(settings.ytd_min_days, settings.ytd_max_days))
    keys = ["concept", "cik", "period_end", "period_start"]
    return (latest_filed(candidates, keys, ["value"])
            .join(fy_starts(facts, settings), ["cik", "period_start"])
            .select("cik", "concept", "period_start", "period_end", "value"))


def fiscal_year_of_start(settings: Settings) -> Column:
    start = F.col("period_start")
    if settings.fiscal_year_rule == "year_end":
        return F.year(F.date_add(start, 364))
    return F.year(start) + 1


def flow_standalone(cumulative: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Quarter = year to date minus the year to date before it.

    `qnum` is the position inside the fiscal year. Where a year-to-date point was never filed, the
    position is not the calendar quarter; `duration_q` and `gap` let callers see that. A window
    holds one tag's points of one year: at most one per day of the accepted duration range.
    """
    points = Window.partitionBy("cik", "concept", "period_start").orderBy("period_end")
    days = F.datediff("period_end", "period_start")
    return (cumulative
            .withColumns({"before": F.lag("value").over(points),
                          "qnum": F.row_number().over(points)})
            .select("cik", "concept", "period_start", "period_end",
                    (F.col("value") - F.coalesce("before", F.lit(0.0))).alias("value"), "qnum",
                    fiscal_year_of_start(settings).alias("fiscal_year"),
                    F.round(days / DAYS_PER_QUARTER).cast("int").alias("duration_q"))
            .withColumn("gap", F.col("duration_q") != F.col("qnum")))


def quarter_spine(standalone: DataFrame, annual_lines: DataFrame,
                  settings: Settings = Settings()) -> DataFrame:
    """Every quarter of the reference series from the first year of the annual window on.

    One row per company and quarter end, whole years only by construction, never a row count.
    """
    first_years = annual_lines.groupBy("cik").agg(F.min("fiscal_year").alias("first_year"))
    chosen = F.max(F.struct("fiscal_year", "qnum"))
    return (standalone.filter(F.col("concept") == settings.spine_concept)
            .groupBy("cik", "period_end").agg(chosen.alias("quarter"))
            .select("cik", "period_end", "quarter.*")
            .join(first_years, "cik")
            .filter(F.col("fiscal_year") >= F.col("first_year"))
            .select("cik", "period_end", "fiscal_year", "qnum",
                    quarter_label(F.col("fiscal_year"), F.col("qnum")).alias("label")))


def quarterly_facts(facts: DataFrame, standalone: DataFrame, spine: DataFrame,
                    settings: Settings = Settings()) -> DataFrame:
    """Derived flows and quarter-end balances on the spine's dates."""
    instants = in_unit(facts, settings).filter(is_instant() & is_periodic_filing())
    columns = ["cik", "concept", "period_end", "value"]
    balances = latest_filed(instants, ["concept", "cik", "period_end"], ["value"])
    return (standalone.select(*columns).unionByName(balances.select(*columns))
            .join(spine.select("cik", "period_end"), ["cik", "period_end"])
            .select(*columns))


def quarterly_statement_lines(quarter_values: DataFrame,
                              settings: Settings = Settings()) -> DataFrame:
    """Per line and quarter end, the best tag that has a row."""
    best = F.max_by("value", F.struct(-F.col("priority"), F.col("value")))
    return (map_to_lines(quarter_values, settings)
            .groupBy("cik", "statement", "line_label", "line_order", "period_end")
            .agg(best.alias("value")))


def quarterly_reconcile(standalone: DataFrame) -> DataFrame:
    """Number and sum of the derived quarters per tag and fiscal year."""
    return standalone.groupBy("cik", "concept", "fiscal_year").agg(
        F.count("*").alias("n_quarters"), F.sum("value").alias("sum_quarters"))


def visible_quarters(spine: DataFrame, settings: Settings = Settings(),
                     fiscal_year: int | None = None) -> DataFrame:
    """The spine's last quarters, or those of one fiscal year."""
    if fiscal_year is not None:
        return spine.filter(F.col("fiscal_year") == fiscal_year)
    newest = Window.partitionBy("cik").orderBy(F.desc("period_end"))
    return (spine.withColumn("place", F.row_number().over(newest))
            .filter(F.col("place") <= settings.visible_quarters).drop("place"))


def quarter_years(spine: DataFrame) -> DataFrame:
    """Fiscal years on the spine; a year with fewer than four quarters is partial."""
    return (spine.groupBy("cik", "fiscal_year").agg(F.count("*").alias("n_quarters"))
            .withColumn("partial", F.col("n_quarters") < 4))


def quarter_end_cash(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cash including restricted cash per date, last filed in any form; an undated filing wins."""
    instants = in_unit(facts, settings).filter(
        (F.col("concept") == settings.cash_concept) & is_instant())
    return (latest_filed(instants, ["cik", "period_end"], ["value"], missing_date_wins=True)
            .withColumnRenamed("value", "ending_cash"))
