"""Reconciliation checks and the publish gate.

Every check gives one row per tested item: cik, check_name, item, fiscal_year, diff, reference,
status (pass, fail or skipped) and note. An unknown figure fails; only a missing comparison base
is skipped, and skipped rows are reported so that an empty check is visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspan.functions.numbers import within_tolerance
from ledgerspan.settings import RECONCILED_CONCEPTS, Settings

COLUMNS = ["cik", "check_name", "item", "fiscal_year", "diff", "reference", "status", "note"]


class GateFailed(RuntimeError):
    """Raised before anything is published when a reconciliation does not hold."""


def _verdict(passed: Column, skipped: Column | None = None) -> Column:
    status = F.when(passed, "pass").otherwise("fail")
    return status if skipped is None else F.when(skipped, "skipped").otherwise(status)


def _rows(frame: DataFrame, name: str, item: str | Column, diff: Column, reference: Column,
          status: Column, note: Column | None = None) -> DataFrame:
    label = F.lit(item) if isinstance(item, str) else item
    return frame.select(
        "cik", F.lit(name).alias("check_name"), label.alias("item"), "fiscal_year",
        diff.alias("diff"), reference.alias("reference"), status.alias("status"),
        (F.lit("") if note is None else note).alias("note"))


def check_balance(balance_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Assets = liabilities + equity."""
    diff, assets = F.col("balance_diff"), F.col("total_assets")
    return _rows(balance_rows, "balance_identity", "Total Assets", diff, assets,
                 _verdict(within_tolerance(diff, assets, settings)))


def check_cash_rollforward(reconciliation: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Beginning cash + flows = ending cash; skipped without a prior year end."""
    ending = F.col("reported_ending_cash")
    diff = F.col("computed_ending_cash") - ending
    return _rows(reconciliation, "cash_rollforward", "Ending Cash", diff, ending,
                 _verdict(within_tolerance(diff, ending, settings),
                          F.col("beginning_cash").isNull()))


def check_cash_tieout(reconciliation: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Ending cash exceeds the balance-sheet line by restricted cash only, a small share of assets."""
    residual, assets = F.col("restricted_cash_residual"), F.col("total_assets")
    bound = assets * settings.restricted_cash_max_pct
    inside = F.coalesce(residual.between(-settings.tolerance_abs, bound), F.lit(False))
    note = F.when(F.abs(residual) <= settings.tolerance_abs, "exact").otherwise("restricted cash")
    return _rows(reconciliation, "cash_tieout", "Cash & Equivalents", residual, assets,
                 _verdict(inside), note)


def check_net_income(metric_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Net income of the income statement = net income that opens the cash flow."""
    net_income = F.col("net_income")
    diff = net_income - F.col("net_income_cf")
    return _rows(metric_rows, "net_income_linkage", "Net Income", diff, net_income,
                 _verdict(within_tolerance(diff, net_income, settings)))


def check_quarterly(reconciled: DataFrame, annual: DataFrame,
                    settings: Settings = Settings()) -> DataFrame:
    """Four derived quarters add up to the annual figure; skipped outside the annual window."""
    tags = list(RECONCILED_CONCEPTS)
    item = F.col("concept")
    for tag, label in RECONCILED_CONCEPTS.items():
        item = F.when(F.col("concept") == tag, label).otherwise(item)
    yearly = (annual.filter(F.col("concept").isin(tags))
              .groupBy("cik", "concept", "fiscal_year")
              .agg(F.max_by("value", "period_end").alias("annual")))
    complete = reconciled.filter(F.col("concept").isin(tags) & (F.col("n_quarters") == 4))
    joined = complete.join(yearly, ["cik", "concept", "fiscal_year"], "left")
    diff, reference = F.col("sum_quarters") - F.col("annual"), F.col("annual")
    return _rows(joined, "quarterly_sum", item, diff, reference,
                 _verdict(within_tolerance(diff, reference, settings), reference.isNull()))


def all_checks(*checks: DataFrame) -> DataFrame:
    union = checks[0]
    for check in checks[1:]:
        union = union.unionByName(check)
    return union


def integrity_summary(results: DataFrame) -> DataFrame:
    """Per company and check: how many items were tested, skipped and failed."""
    def counted(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    return (results.groupBy("cik", "check_name")
            .agg((counted("pass") + counted("fail")).alias("n_checked"),
                 counted("skipped").alias("n_skipped"), counted("fail").alias("n_failed"),
                 F.every(F.col("status") != "fail").alias("passed")))


def company_gate(results: DataFrame) -> DataFrame:
    """Per company: does every item of every check hold?"""
    return results.groupBy("cik").agg(F.every(F.col("status") != "fail").alias("passed"),
                                      F.count("*").alias("n_items"))


def require_all_pass(gate: DataFrame) -> None:
    """Stop the job unless every company passes. Brings one row of counts to the driver."""
    row = gate.agg(F.count("*").alias("companies"),
                   F.count(F.when(~F.col("passed"), 1)).alias("failed")).first()
    if row["failed"]:
        raise GateFailed(f"{row['failed']} of {row['companies']} companies do not reconcile")
