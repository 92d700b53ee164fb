"""Waterfall data: revenue to net income, and beginning to ending cash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.labels import quarter_key, year_key, year_label
from ledgerspan.operators.cells import PERIOD

KEYS = ["cik", "fiscal_year", "qnum", "period_key", "period_label"]


def _steps(rows: DataFrame, steps: list[tuple[str, str, Column]]) -> DataFrame:
    """Unfold one row per bridge into its ordered steps."""
    entries = F.array(*[
        F.struct(F.lit(place).alias("step_order"), F.lit(name).alias("step"),
                 F.lit(measure).alias("measure"), amount.alias("amount"))
        for place, (name, measure, amount) in enumerate(steps, start=1)])
    return rows.select(*KEYS, F.inline(entries))


def _year_keys(rows: DataFrame, *columns: Column) -> DataFrame:
    year = F.col("fiscal_year")
    return rows.select("cik", "fiscal_year", F.lit(None).cast("int").alias("qnum"),
                       year_key(year).alias("period_key"), year_label(year).alias("period_label"),
                       *columns)


def _quarter_amounts(cells: DataFrame, statement: str, lines: dict[str, str]) -> DataFrame:
    """Named lines of a statement side by side per quarter; quarters lacking any are left out."""
    amounts = [F.max(F.when(F.col("line_label") == label, F.col("value"))).alias(name)
               for name, label in lines.items()]
    return (cells.filter(F.col("statement") == statement)
            .groupBy("cik", *PERIOD).agg(*amounts).dropna(subset=list(lines)))


def income_bridge_annual(metric_rows: DataFrame) -> DataFrame:
    c = F.col
    return _year_keys(
        metric_rows, c("revenue").alias("rev"), c("cogs"), c("gross_profit").alias("gp"),
        (c("gross_profit") - c("operating_income")).alias("opex"),
        c("operating_income").alias("oi"), c("net_income").alias("ni"))


def income_bridge_quarterly(cells: DataFrame) -> DataFrame:
    lines = {"rev": "Revenue", "cogs": "Cost of Revenue", "gp": "Gross Profit",
             "oi": "Operating Income", "ni": "Net Income"}
    return (_quarter_amounts(cells, "income", lines)
            .select(*KEYS, "rev", "cogs", "gp", (F.col("gp") - F.col("oi")).alias("opex"),
                    "oi", "ni"))


def income_steps(bridges: DataFrame) -> DataFrame:
    c = F.col
    return _steps(bridges, [
        ("Revenue", "absolute", c("rev")),
        ("Cost of Revenue", "relative", -c("cogs")),
        ("Gross Profit", "total", c("gp")),
        ("Operating Exp.", "relative", -c("opex")),
        ("Operating Income", "total", c("oi")),
        ("Taxes & Other", "relative", c("ni") - c("oi")),
        ("Net Income", "total", c("ni")),
    ])


def cash_bridge_annual(reconciliation: DataFrame) -> DataFrame:
    c = F.col
    return _year_keys(
        reconciliation, c("beginning_cash").alias("beg"), c("operating_cf").alias("cfo"),
        c("investing_cf").alias("cfi"), c("financing_cf").alias("cff"),
        c("reported_ending_cash").alias("end"))


def cash_bridge_quarterly(cells: DataFrame, end_cash: DataFrame) -> DataFrame:
    """Beginning cash is what the quarter's flows leave of the ending cash."""
    lines = {"cfo": "Operating Cash Flow", "cfi": "Investing Cash Flow",
             "cff": "Financing Cash Flow"}
    c = F.col
    return (_quarter_amounts(cells, "cashflow", lines)
            .join(end_cash.filter(c("ending_cash").isNotNull()), ["cik", "period_end"])
            .select(*KEYS, (c("ending_cash") - (c("cfo") + c("cfi") + c("cff"))).alias("beg"),
                    "cfo", "cfi", "cff", c("ending_cash").alias("end")))


def cash_steps(bridges: DataFrame) -> DataFrame:
    c = F.col
    return _steps(bridges, [
        ("Beginning", "absolute", c("beg")),
        ("Operating", "relative", c("cfo")),
        ("Investing", "relative", c("cfi")),
        ("Financing", "relative", c("cff")),
        ("Ending", "total", c("end")),
    ])


def bridge_periods(bridges: dict[tuple[str, str], DataFrame], visible: DataFrame) -> DataFrame:
    """Periods a bridge can be shown for: annual ones all, quarterly ones only if visible.

    The newest period of each bridge is its default. Keys of `bridges` are (bridge, frequency).
    """
    shown = visible.select("cik", quarter_key(F.col("fiscal_year"), F.col("qnum")).alias("period_key"))
    parts = []
    for (bridge, frequency), rows in bridges.items():
        if frequency == "quarterly":
            rows = rows.join(shown, ["cik", "period_key"], "left_semi")
        parts.append(rows.select("cik", F.lit(bridge).alias("bridge"),
                                 F.lit(frequency).alias("frequency"),
                                 "fiscal_year", "qnum", "period_key", "period_label"))
    choices = parts[0]
    for part in parts[1:]:
        choices = choices.unionByName(part)
    newest = Window.partitionBy("cik", "bridge", "frequency").orderBy(
        F.desc("fiscal_year"), F.desc("qnum"))
    return (choices.withColumn("is_default", F.row_number().over(newest) == 1)
            .select("cik", "bridge", "frequency", "period_key", "period_label", "is_default"))
