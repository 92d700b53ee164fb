"""Plain-language insights derived from the computed figures only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.numbers import ratio
from ledgerspan.functions.text import fixed, money, percent
from ledgerspan.operators.annual import ratio_columns
from ledgerspan.settings import Settings


def narrative_inputs(metric_rows: DataFrame) -> DataFrame:
    """One row per company: figures of the first, the previous and the last year in the window.

    Each role comes from one grouping over the company's few years.
    """
    c = F.col
    newest = Window.partitionBy("cik").orderBy(F.desc("fiscal_year"))
    figures = F.struct("fiscal_year", "revenue", "net_income", "total_assets", "total_liabilities",
                       "total_equity", "operating_cf", "investing_cf", "capex", *ratio_columns())
    rows = metric_rows.select("cik", "fiscal_year", figures.alias("f"),
                              F.row_number().over(newest).alias("place"))
    roles = (rows.groupBy("cik").agg(
        F.max_by("f", "fiscal_year").alias("last"), F.min_by("f", "fiscal_year").alias("first"),
        F.first(F.when(c("place") == 2, c("f")), ignorenulls=True).alias("prev"))
        .dropna(subset=["prev"]))
    return roles.select(
        "cik", c("first.fiscal_year").alias("first_year"), c("prev.fiscal_year").alias("prev_year"),
        c("last.fiscal_year").alias("last_year"), c("last.revenue").alias("revenue"),
        ratio(c("last.revenue") - c("prev.revenue"), c("prev.revenue")).alias("revenue_growth"),
        ((c("last.net_margin") - c("prev.net_margin")) * 10000).alias("margin_bps"),
        c("last.net_margin").alias("net_margin"), c("last.total_assets").alias("total_assets"),
        (ratio(c("last.total_liabilities"), c("last.total_assets")) * 100).alias("liabilities_pct"),
        c("last.total_equity").alias("total_equity"), c("prev.total_equity").alias("prior_equity"),
        c("last.operating_cf").alias("operating_cf"), c("last.capex").alias("capex"),
        c("last.free_cash_flow").alias("free_cash_flow"),
        c("last.investing_cf").alias("investing_cf"),
        c("last.gross_margin").alias("gross_margin"),
        c("first.gross_margin").alias("first_gross_margin"),
        c("last.roe").alias("roe"), c("last.net_income").alias("net_income"))


def normalized_margin(metric_rows: DataFrame, one_time_items: DataFrame) -> DataFrame:
    """Net margin of a flagged year with its one-time charges added back."""
    charges = one_time_items.groupBy("cik", "fiscal_year").agg(
        F.sum("amount").alias("amount"), F.max("reason").alias("reason"))
    c = F.col
    return (metric_rows.join(charges, ["cik", "fiscal_year"])
            .select("cik", "fiscal_year", "amount", "reason", "net_income",
                    ratio(c("net_income"), c("revenue")).alias("reported_margin"),
                    ratio(c("net_income") + c("amount"), c("revenue")).alias("normalized_margin")))


def _fy(column: str) -> Column:
    return F.concat(F.lit("FY"), F.col(column).cast("string"))


# The sentence forms below are the published wording.
def narrative(inputs: DataFrame, normalized: DataFrame, companies: DataFrame | None = None,
              settings: Settings = Settings()) -> DataFrame:
    """cik, section, text: four insights per company and the notes whose condition holds."""
    c, lit = F.col, F.lit
    if companies is None:
        named = inputs.withColumn("entity_name", lit(None).cast("string"))
    else:
        named = inputs.join(companies.select("cik", "entity_name"), "cik", "left")
    owner = F.coalesce(F.concat(c("entity_name"), lit("'s")), lit("the company's"))

    income = F.concat(
        _fy("last_year"), lit(" revenue of "), money(c("revenue")), lit(" grew "),
        fixed(c("revenue_growth") * 100, 1), lit("% YoY, while net margin "),
        F.when(c("margin_bps") >= 0, "expanded").otherwise("compressed"), lit(" "),
        fixed(F.abs("margin_bps"), 0), lit(" bps to "), percent(c("net_margin")), lit("."))
    balance = F.concat(
        _fy("last_year"), lit(" total assets of "), money(c("total_assets")), lit(" were "),
        fixed(c("liabilities_pct"), 0), lit("% funded by liabilities; shareholders' equity "),
        F.when(c("total_equity") >= c("prior_equity"), "rose").otherwise("fell"), lit(" to "),
        money(c("total_equity")), lit("."))
    cashflow = F.concat(
        _fy("last_year"), lit(" operating cash flow of "), money(c("operating_cf")),
        lit(" funded "), money(c("capex")), lit(" of capex, leaving "),
        money(c("free_cash_flow")), lit(" of free cash flow."))
    returns = F.concat(
        lit("Gross margin reached "), percent(c("gross_margin")), lit(" in "), _fy("last_year"),
        lit(", up from "), percent(c("first_gross_margin")), lit(" in "), _fy("first_year"),
        lit("; ROE of "), percent(c("roe"), 0),
        lit(" reflects a small equity base relative to "), money(c("net_income")),
        lit(" of net income."))
    high_roe = F.when(c("roe") > settings.high_roe, F.concat(
        lit("ROE above 150% is not an error: sustained share buybacks have shrunk shareholders' "
            "equity to "), money(c("total_equity")), lit(", so "), money(c("net_income")),
        lit(" of net income sits on a small equity base.")))
    investing = F.when(c("investing_cf") > 0, F.concat(
        _fy("last_year"), lit(" investing cash flow was positive ("), money(c("investing_cf")),
        lit(") — not an error. It reflects net maturities and sales of "), owner,
        lit(" marketable-securities portfolio exceeding new purchases and capex.")))
    sections = F.array(*[
        F.struct(lit(name).alias("section"), text.alias("text"))
        for name, text in [("income", income), ("balance", balance), ("cashflow", cashflow),
                           ("ratios", returns), ("ratios_note", high_roe),
                           ("cashflow_note", investing)]])
    insights = named.select("cik", F.inline(sections)).filter(c("text").isNotNull())

    charge = F.concat(
        _fy("fiscal_year"), lit(" net income fell to "), money(c("net_income")),
        lit(" despite higher revenue, due to a one-time ~"), money(c("amount")), lit(" "),
        c("reason"), lit(". Normalized, "), _fy("fiscal_year"), lit(" net margin was ~"),
        percent(c("normalized_margin")), lit(" (vs "), percent(c("reported_margin")),
        lit(" reported), so part of the "), _fy("last_year"),
        lit(" margin expansion is a return to trend."))
    notes = (normalized.join(inputs.select("cik", "last_year"), "cik")
             .select("cik", lit("income_note").alias("section"), charge.alias("text")))
    return insights.unionByName(notes)
