"""Period A against period B: metric changes, the largest mover and the ratio indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.numbers import ratio, relative_change
from ledgerspan.functions.text import page_percent, page_signed
from ledgerspan.settings import VARIANCE_METRICS

# The comparator adds free cash flow to the yearly variance metrics.
COMPARED: dict[str, str] = {**VARIANCE_METRICS, "Free Cash Flow": "free_cash_flow"}


def compared_years(metric_rows: DataFrame, columns: list[Column], base_year: int | None = None,
                   compare_year: int | None = None) -> DataFrame:
    """One row per company with struct columns `base` and `compare`.

    Default: the newest year against the one shown before it. Both sides come from one grouping,
    the metrics are not joined with themselves. Companies lacking either year are left out.
    """
    newest = Window.partitionBy("cik").orderBy(F.desc("fiscal_year"))
    packed = F.struct("fiscal_year", *columns)
    rows = metric_rows.select("cik", "fiscal_year", packed.alias("figures"),
                              F.row_number().over(newest).alias("place"))
    is_base = F.col("place") == 1 if base_year is None else F.col("fiscal_year") == base_year
    is_compare = F.col("place") == 2 if compare_year is None else F.col("fiscal_year") == compare_year
    return (rows.groupBy("cik")
            .agg(F.first(F.when(is_base, F.col("figures")), ignorenulls=True).alias("base"),
                 F.first(F.when(is_compare, F.col("figures")), ignorenulls=True).alias("compare"))
            .dropna(subset=["base", "compare"]))


def variance_ab(metric_rows: DataFrame, base_year: int | None = None,
                compare_year: int | None = None) -> DataFrame:
    """Eight metrics of both periods with the change, relative to the size of the compared one."""
    c = F.col
    free_cash_flow = (c("operating_cf") - c("capex")).alias("free_cash_flow")
    columns = [c(name) for name in VARIANCE_METRICS.values()] + [free_cash_flow]
    both = compared_years(metric_rows, columns, base_year, compare_year)
    entries = F.array(*[
        F.struct(F.lit(place).alias("metric_order"), F.lit(label).alias("metric"),
                 c(f"base.{name}").alias("base_value"),
                 c(f"compare.{name}").alias("compare_value"))
        for place, (label, name) in enumerate(COMPARED.items(), start=1)])
    return (both.select("cik", c("base.fiscal_year").alias("base_year"),
                        c("compare.fiscal_year").alias("compare_year"), F.inline(entries))
            .withColumn("delta", c("base_value") - c("compare_value"))
            .withColumn("pct", relative_change(c("base_value"), c("compare_value"))))


def variance_ab_ranked(variances: DataFrame) -> DataFrame:
    """Tornado order: ascending relative change; metrics without one take no part."""
    rising = Window.partitionBy("cik").orderBy("pct", "metric_order")
    return (variances.filter(F.col("pct").isNotNull())
            .select("cik", F.row_number().over(rising).alias("place"), "metric", "pct"))


def net_margin_bps(metric_rows: DataFrame, base_year: int | None = None,
                   compare_year: int | None = None) -> DataFrame:
    """Net margin of the base period and its change in whole basis points, halves rounded up."""
    margin = ratio(F.col("net_income"), F.col("revenue")).alias("net_margin")
    both = compared_years(metric_rows, [margin], base_year, compare_year)
    change = F.col("base.net_margin") - F.col("compare.net_margin")
    return both.select("cik", F.col("base.net_margin").alias("net_margin"),
                       F.floor(change * 10000 + 0.5).alias("margin_bps"))


def largest_mover(metric_rows: DataFrame, base_year: int | None = None,
                  compare_year: int | None = None) -> DataFrame:
    """The metric with the largest relative change (the first listed on a tie) and a summary."""
    c = F.col
    strongest = F.max_by(F.struct("base_year", "compare_year", "metric", "pct"),
                         F.struct(F.abs("pct"), -c("metric_order")))
    top = (variance_ab(metric_rows, base_year, compare_year).filter(c("pct").isNotNull())
           .groupBy("cik").agg(strongest.alias("top")).select("cik", "top.*"))
    text = F.concat(
        F.lit("Largest move FY"), c("base_year").cast("string"), F.lit(" vs FY"),
        c("compare_year").cast("string"), F.lit(": "), c("metric"), F.lit(" "),
        page_signed(c("pct") * 100, 1, "%"), F.lit(". Net margin "),
        F.when(c("margin_bps") >= 0, "expanded").otherwise("compressed"), F.lit(" "),
        F.abs("margin_bps").cast("string"), F.lit(" bps to "), page_percent(c("net_margin")), F.lit("."))
    return (top.join(net_margin_bps(metric_rows, base_year, compare_year), "cik")
            .withColumn("text", text))


def ratio_kpis(metric_rows: DataFrame) -> DataFrame:
    """Last year against the one before: points, absolute and relative changes with their text."""
    c = F.col
    columns = [
        ratio(c("net_income"), c("total_equity")).alias("roe"),
        ratio(c("net_income"), c("revenue")).alias("net_margin"),
        ratio(c("current_assets"), c("current_liabilities")).alias("current_ratio"),
        (c("operating_cf") - c("capex")).alias("free_cash_flow")]
    both = compared_years(metric_rows, columns)

    def sides(name: str) -> tuple[Column, Column]:
        return c(f"base.{name}"), c(f"compare.{name}")

    def points(name: str) -> Column:
        now, before = sides(name)
        return (now - before) * 100

    ratio_change = sides("current_ratio")[0] - sides("current_ratio")[1]
    cash_change = relative_change(*sides("free_cash_flow"))
    against = F.concat(F.lit(" vs FY"), c("compare.fiscal_year").cast("string"))
    kpis = [
        ("Return on Equity", sides("roe")[0], points("roe"), page_signed(points("roe"), 0, " pp")),
        ("Net Margin", sides("net_margin")[0], points("net_margin"),
         page_signed(points("net_margin"), 1, " pp")),
        ("Current Ratio", sides("current_ratio")[0], ratio_change, page_signed(ratio_change, 2)),
        ("Free Cash Flow", sides("free_cash_flow")[0], cash_change,
         page_signed(cash_change * 100, 1, "%")),
    ]
    entries = F.array(*[
        F.struct(F.lit(place).alias("kpi_order"), F.lit(label).alias("kpi"), now.alias("value"),
                 change.alias("change"),
                 F.ltrim(F.concat(F.coalesce(text, F.lit("")), against)).alias("change_text"))
        for place, (label, now, change, text) in enumerate(kpis, start=1)])
    return both.select("cik", F.inline(entries))
