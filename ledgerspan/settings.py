"""All tunable parameters of the engine, plus the fixed tag-to-line mapping."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple


class Line(NamedTuple):
    """One standard statement line and the filing tags that can feed it, best tag first."""

    statement: str
    order: int
    label: str
    candidates: tuple[str, ...]


# Statement lines, their display order and their candidate tags.
STANDARD_LINES: tuple[Line, ...] = (
    Line("income", 1, "Revenue", (
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet")),
    Line("income", 2, "Cost of Revenue", (
        "CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold")),
    Line("income", 3, "Gross Profit", ("GrossProfit",)),
    Line("income", 4, "Operating Expenses", ("OperatingExpenses", "CostsAndExpenses")),
    Line("income", 5, "Operating Income", ("OperatingIncomeLoss",)),
    Line("income", 6, "Pretax Income", (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments")),
    Line("income", 7, "Income Tax", ("IncomeTaxExpenseBenefit",)),
    Line("income", 8, "Net Income", ("NetIncomeLoss", "ProfitLoss")),
    Line("balance", 1, "Total Assets", ("Assets",)),
    Line("balance", 2, "Current Assets", ("AssetsCurrent",)),
    Line("balance", 3, "Cash & Equivalents", (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents")),
    Line("balance", 4, "Total Liabilities", ("Liabilities",)),
    Line("balance", 5, "Current Liabilities", ("LiabilitiesCurrent",)),
    Line("balance", 6, "Total Equity", (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    Line("cashflow", 1, "Net Income", ("NetIncomeLoss", "ProfitLoss")),
    Line("cashflow", 2, "Operating Cash Flow", ("NetCashProvidedByUsedInOperatingActivities",)),
    Line("cashflow", 3, "Investing Cash Flow", ("NetCashProvidedByUsedInInvestingActivities",)),
    Line("cashflow", 4, "Financing Cash Flow", ("NetCashProvidedByUsedInFinancingActivities",)),
    Line("cashflow", 5, "Capital Expenditures", ("PaymentsToAcquirePropertyPlantAndEquipment",)),
    Line("cashflow", 6, "Net Change in Cash (reported)", (
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect",
        "CashAndCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect",
        "CashAndCashEquivalentsPeriodIncreaseDecrease")),
)

# Headline metric column -> (statement, line).
METRIC_LINES: dict[str, tuple[str, str]] = {
    "revenue": ("income", "Revenue"),
    "cogs": ("income", "Cost of Revenue"),
    "gross_profit": ("income", "Gross Profit"),
    "operating_income": ("income", "Operating Income"),
    "net_income": ("income", "Net Income"),
    "total_assets": ("balance", "Total Assets"),
    "current_assets": ("balance", "Current Assets"),
    "cash": ("balance", "Cash & Equivalents"),
    "total_liabilities": ("balance", "Total Liabilities"),
    "current_liabilities": ("balance", "Current Liabilities"),
    "total_equity": ("balance", "Total Equity"),
    "operating_cf": ("cashflow", "Operating Cash Flow"),
    "investing_cf": ("cashflow", "Investing Cash Flow"),
    "financing_cf": ("cashflow", "Financing Cash Flow"),
    "capex": ("cashflow", "Capital Expenditures"),
    "net_income_cf": ("cashflow", "Net Income"),
    "net_change_cash_reported": ("cashflow", "Net Change in Cash (reported)"),
}

# Metrics followed by the year-over-year variance, label -> column.
VARIANCE_METRICS: dict[str, str] = {
    "Revenue": "revenue",
    "Gross Profit": "gross_profit",
    "Operating Income": "operating_income",
    "Net Income": "net_income",
    "Total Assets": "total_assets",
    "Total Equity": "total_equity",
    "Operating Cash Flow": "operating_cf",
}

# Ratio label -> (column, display format).
RATIO_FORMATS: dict[str, tuple[str, str]] = {
    "Gross Margin": ("gross_margin", "pct"),
    "Operating Margin": ("operating_margin", "pct"),
    "Net Margin": ("net_margin", "pct"),
    "Return on Equity": ("roe", "pct"),
    "Current Ratio": ("current_ratio", "x"),
    "Free Cash Flow": ("free_cash_flow", "money"),
}

# Tags of the headline sample.
SAMPLE_CONCEPTS: tuple[str, ...] = (
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "CostOfGoodsAndServicesSold",
    "GrossProfit",
    "OperatingIncomeLoss",
    "NetIncomeLoss",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
    "NetCashProvidedByUsedInOperatingActivities",
)

# Tags whose derived quarters must add up to the annual figure.
RECONCILED_CONCEPTS: dict[str, str] = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "Revenue",
    "NetIncomeLoss": "Net Income",
    "NetCashProvidedByUsedInOperatingActivities": "Operating CF",
}

# The line each statement is expressed as a share of, and its wording.
BASE_LINE: dict[str, tuple[str, str]] = {
    "income": ("income", "Revenue"),
    "cashflow": ("income", "Revenue"),
    "balance": ("balance", "Total Assets"),
}
BASE_WORD: dict[str, str] = {"income": "revenue", "cashflow": "revenue", "balance": "assets"}
BASE_LABEL: dict[str, str] = {
    "income": "% of Revenue", "cashflow": "% of Revenue", "balance": "% of Assets"}

STATEMENTS: tuple[str, ...] = ("income", "balance", "cashflow")


@dataclass(frozen=True)
class Settings:
    """Thresholds and conventions. The defaults reproduce the published behaviour."""

    lines: tuple[Line, ...] = STANDARD_LINES
    taxonomy: str = "us-gaap"
    unit: str | None = None                  # None: the unit takes no part in selection
    years_history: int = 5
    annual_min_days: int = 350
    fiscal_start_min_days: int = 170
    ytd_min_days: int = 80
    ytd_max_days: int = 380
    spine_concept: str = "NetIncomeLoss"
    cash_concept: str = "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"
    # "start_plus_one": fiscal year = year(start) + 1, right for autumn year starts.
    # "year_end": year of the 364th day after the start, right for any year start.
    fiscal_year_rule: str = "start_plus_one"
    tolerance_pct: float = 0.005
    tolerance_abs: float = 1000.0
    restricted_cash_max_pct: float = 0.02
    restatement_pct: float = 0.0005
    restatement_abs: float = 1000.0
    deviation_threshold: dict[str, float] = field(
        default_factory=lambda: {"income": 0.015, "cashflow": 0.015, "balance": 0.020})
    move_threshold: float = 0.30
    min_points: int = 3
    top_annual: int = 5
    top_quarterly: int = 10
    visible_quarters: int = 12
    high_roe: float = 1.5
    company_folders: int = 64                # folders of the incremental facts table
    bucket_slices: int = 8                   # parts in which one folder's facts are merged

    @property
    def mapped_concepts(self) -> list[str]:
        return sorted({tag for line in self.lines for tag in line.candidates})
