"""Annual facts, statement lines and the marts that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.numbers import BILLION, billions, ratio
from ledgerspan.functions.pick import latest_filed
from ledgerspan.functions.text import money, page_number, page_percent
from ledgerspan.operators.mapping import map_to_lines
from ledgerspan.operators.selection import (
    in_unit, is_annual_filing, is_instant, spans_full_year)
from ledgerspan.settings import (
    BASE_LINE, METRIC_LINES, RATIO_FORMATS, VARIANCE_METRICS, Settings)


def last_annual_year(facts: DataFrame) -> DataFrame:
    """Per company, the calendar year of its newest annual filing, whatever the period length."""
    return (facts.filter(is_annual_filing())
            .groupBy("cik").agg(F.year(F.max("period_end")).alias("last_year")))


def annual_facts(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One value per (company, tag, fiscal year end): the last filed, inside the year window.

    Annual filings are filtered before versions are chosen, so a later quarterly filing cannot hide
    an annual one. The year is that of the period end; the filing's own tag is unreliable.
    """
    eligible = in_unit(facts, settings).filter(is_annual_filing() & spans_full_year(settings))
    newest = latest_filed(eligible, ["concept", "cik", "period_end"], ["value"])
    return (newest.withColumn("fiscal_year", F.year("period_end"))
            .join(last_annual_year(facts), "cik")
            .filter(F.col("fiscal_year") > F.col("last_year") - settings.years_history)
            .select("cik", "concept", "fiscal_year", "period_end", "value"))


def statement_lines(annual: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per line and year, the best tag that has a row; of two year ends in a year, the later."""
    best = F.max_by("value", F.struct(-F.col("priority"), F.col("period_end")))
    return (map_to_lines(annual, settings)
            .groupBy("cik", "statement", "line_label", "line_order", "fiscal_year")
            .agg(best.alias("value")))


def one_statement(lines: DataFrame, statement: str) -> DataFrame:
    return (lines.filter(F.col("statement") == statement)
            .select("cik", "line_order", "line_label", "fiscal_year", "value"))


def metrics(lines: DataFrame) -> DataFrame:
    """One row per company and year with the headline amounts as columns."""
    return lines.groupBy("cik", "fiscal_year").agg(*[
        F.expr(f"max(value) FILTER (WHERE statement = '{statement}' AND line_label = '{label}')")
        .alias(name) for name, (statement, label) in METRIC_LINES.items()])


def balance_check(metric_rows: DataFrame) -> DataFrame:
    funded = F.col("total_liabilities") + F.col("total_equity")
    return metric_rows.select(
        "cik", "fiscal_year", "total_assets", "total_liabilities", "total_equity",
        funded.alias("liabilities_plus_equity"),
        (F.col("total_assets") - funded).alias("balance_diff"))


def cash_anchor(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cash including restricted cash at every year end ever filed in an annual report."""
    instants = in_unit(facts, settings).filter(
        (F.col("concept") == settings.cash_concept) & (F.col("form") == "10-K") & is_instant())
    return (latest_filed(instants, ["cik", "period_end"], ["value"])
            .select("cik", F.year("period_end").alias("fiscal_year"), "period_end",
                    F.col("value").alias("ending_cash")))


def cash_reconciliation(metric_rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Beginning cash, the three flows and ending cash per year.

    The year before comes from a range frame over the company's year ends (one row per year), so a
    missing year gives NULL and no second join is needed.
    """
    year_before = Window.partitionBy("cik").orderBy("fiscal_year").rangeBetween(-1, -1)
    yearly = (anchors.groupBy("cik", "fiscal_year")
              .agg(F.max_by("ending_cash", "period_end").alias("ending_cash"))
              .withColumn("beginning_cash", F.first("ending_cash").over(year_before)))
    net_change = F.col("operating_cf") + F.col("investing_cf") + F.col("financing_cf")
    return metric_rows.join(yearly, ["cik", "fiscal_year"]).select(
        "cik", "fiscal_year", "beginning_cash", "operating_cf", "investing_cf", "financing_cf",
        net_change.alias("net_change"),
        (F.col("beginning_cash") + net_change).alias("computed_ending_cash"),
        F.col("ending_cash").alias("reported_ending_cash"),
        F.col("cash").alias("balance_sheet_cash"),
        (F.col("ending_cash") - F.col("cash")).alias("restricted_cash_residual"),
        "total_assets")


def ratio_columns() -> list[Column]:
    c = F.col
    return [
        ratio(c("gross_profit"), c("revenue")).alias("gross_margin"),
        ratio(c("operating_income"), c("revenue")).alias("operating_margin"),
        ratio(c("net_income"), c("revenue")).alias("net_margin"),
        ratio(c("net_income"), c("total_equity")).alias("roe"),
        ratio(c("current_assets"), c("current_liabilities")).alias("current_ratio"),
        (c("operating_cf") - c("capex")).alias("free_cash_flow"),
    ]


def ratios(metric_rows: DataFrame) -> DataFrame:
    return metric_rows.select("cik", "fiscal_year", *ratio_columns())


def common_size(lines: DataFrame) -> DataFrame:
    """Income lines over revenue and balance lines over total assets.

    The base is one of the company's own lines of the same year (20 rows at most), so a window
    finds it without joining the lines to their own pivot.
    """
    one_year = Window.partitionBy("cik", "fiscal_year")

    def base_of(statement: str):
        base_statement, label = BASE_LINE[statement]
        here = (F.col("statement") == base_statement) & (F.col("line_label") == label)
        return F.max(F.when(here, F.col("value"))).over(one_year)

    base = F.when(F.col("statement") == "income", base_of("income")).otherwise(base_of("balance"))
    return (lines.filter(F.col("statement").isin("income", "balance"))
            .select("cik", "statement", "line_order", "line_label", "fiscal_year", "value",
                    ratio(F.col("value"), base).alias("pct_of_base")))


def metrics_long(metric_rows: DataFrame) -> DataFrame:
    """Seven metrics as rows; a metric without a value keeps its row."""
    named = [F.col(column).alias(label) for label, column in VARIANCE_METRICS.items()]
    return metric_rows.select("cik", "fiscal_year", *named).unpivot(
        ["cik", "fiscal_year"], list(VARIANCE_METRICS), "metric", "value")


def variance_yoy(long_rows: DataFrame) -> DataFrame:
    """Change against the previous *available* year, relative to the signed prior value."""
    by_year = Window.partitionBy("cik", "metric").orderBy("fiscal_year")
    change = F.col("value") - F.col("prior_value")
    return (long_rows.withColumn("prior_value", F.lag("value").over(by_year))
            .select("cik", "fiscal_year", "metric", "value", "prior_value",
                    change.alias("delta_abs"),
                    ratio(change, F.col("prior_value")).alias("delta_pct")))


def pivot_statement(statement_rows: DataFrame, years: list[int]) -> DataFrame:
    """Lines by the given years, in billions."""
    wide = (statement_rows.groupBy("cik", "line_order", "line_label")
            .pivot("fiscal_year", years).agg(F.max("value")))
    return wide.select("cik", "line_order", "line_label",
                       *[billions(F.col(str(year))).alias(f"fy{year}") for year in years])


def pivot_window(statement_rows: DataFrame, width: int) -> DataFrame:
    """Lines by position in each company's window, in billions, in a shape that does not depend on the data.

    y<k> is the line's value in the company's k-th newest fiscal year of the statement (k = 0 newest), fy<k>
    that year; positions the company lacks are null. Positions are dense ranks of the company's years, so a
    window with a gap keeps all its years. One window per company and one pivot with a fixed value list: no
    driver round trip while the plan is built, and the rows stay partitioned by company.
    """
    position = F.dense_rank().over(Window.partitionBy("cik").orderBy(F.col("fiscal_year").desc())) - 1
    placed = statement_rows.withColumn("pos", position).where(F.col("pos") < width)
    years = (placed.groupBy("cik").pivot("pos", list(range(width))).agg(F.max("fiscal_year"))
             .select("cik", *[F.col(str(k)).cast("int").alias(f"fy{k}") for k in range(width)]))
    wide = (placed.groupBy("cik", "line_order", "line_label").pivot("pos", list(range(width)))
            .agg(F.max("value")))
    return wide.join(years, "cik").select(
        "cik", "line_order", "line_label", *[f"fy{k}" for k in range(width)],
        *[billions(F.col(str(k))).alias(f"y{k}") for k in range(width)])


def ratios_long(ratio_rows: DataFrame) -> DataFrame:
    """Six ratios as rows with their label, display format and display text."""
    columns = [column for column, _ in RATIO_FORMATS.values()]
    attributes = F.create_map(*[
        part for label, (column, form) in RATIO_FORMATS.items()
        for part in (F.lit(column), F.struct(F.lit(label).alias("label"), F.lit(form).alias("fmt")))])
    value, fmt = F.col("value"), F.col("fmt")
    text = F.when(value.isNull(), "–").when(fmt == "pct", page_percent(value)).when(
        fmt == "x", page_number(value, 2)).otherwise(money(value))
    return (ratio_rows.unpivot(["cik", "fiscal_year"], columns, "ratio", "value")
            .withColumn("shown", attributes[F.col("ratio")])
            .select("cik", "fiscal_year", "ratio", F.col("shown.label").alias("label"),
                    F.col("shown.fmt").alias("fmt"), "value")
            .withColumn("text", text))


def headline_series(metric_rows: DataFrame) -> DataFrame:
    """The multi-year chart feeds: amounts in billions, margins in percent, and the current ratio."""
    c = F.col
    amounts = ["revenue", "net_income", "total_assets", "total_liabilities", "total_equity", "cash",
               "operating_cf", "capex", "investing_cf", "financing_cf", "free_cash_flow"]
    shares = ["gross_margin", "operating_margin", "net_margin", "roe"]
    wide = metric_rows.select("*", *ratio_columns())
    feeds = wide.select("cik", "fiscal_year",
                        *[(c(name) / BILLION).alias(name) for name in amounts],
                        *[(c(name) * 100).alias(name) for name in shares], "current_ratio")
    return feeds.unpivot(["cik", "fiscal_year"], [*amounts, *shares, "current_ratio"],
                         "series", "value")
