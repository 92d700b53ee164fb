"""Published values of one company: 20 lines, fiscal years 2021 to 2025."""

import pytest
from conftest import dicts

from ledgerspan.operators import checks, cells, narrative, notable, revisions
from ledgerspan.plans.workbook import Workbook
from ledgerspan.settings import STANDARD_LINES

# Millions per line, fiscal years 2021 to 2025.
CELLS = {
    ("income", "Revenue"): (365817, 394328, 383285, 391035, 416161),
    ("income", "Cost of Revenue"): (212981, 223546, 214137, 210352, 220960),
    ("income", "Gross Profit"): (152836, 170782, 169148, 180683, 195201),
    ("income", "Operating Expenses"): (43887, 51345, 54847, 57467, 62151),
    ("income", "Operating Income"): (108949, 119437, 114301, 123216, 133050),
    ("income", "Pretax Income"): (109207, 119103, 113736, 123485, 132729),
    ("income", "Income Tax"): (14527, 19300, 16741, 29749, 20719),
    ("income", "Net Income"): (94680, 99803, 96995, 93736, 112010),
    ("balance", "Total Assets"): (351002, 352755, 352583, 364980, 359241),
    ("balance", "Current Assets"): (134836, 135405, 143566, 152987, 147957),
    ("balance", "Cash & Equivalents"): (34940, 23646, 29965, 29943, 35934),
    ("balance", "Total Liabilities"): (287912, 302083, 290437, 308030, 285508),
    ("balance", "Current Liabilities"): (125481, 153982, 145308, 176392, 165631),
    ("balance", "Total Equity"): (63090, 50672, 62146, 56950, 73733),
    ("cashflow", "Net Income"): (94680, 99803, 96995, 93736, 112010),
    ("cashflow", "Operating Cash Flow"): (104038, 122151, 110543, 118254, 111482),
    ("cashflow", "Investing Cash Flow"): (-14545, -22354, 3705, 2935, 15195),
    ("cashflow", "Financing Cash Flow"): (-93353, -110749, -108488, -121983, -120686),
    ("cashflow", "Capital Expenditures"): (11085, 10708, 10959, 9447, 12715),
    ("cashflow", "Net Change in Cash (reported)"): (-3860, -10952, 5760, -794, 5991),
}
# Gross, operating and net margin, return on equity, current ratio, free cash flow.
RATIOS = {
    2021: (.4178, .2978, .2588, 1.5007, 1.0746, 92.953e9),
    2022: (.4331, .3029, .2531, 1.9696, 0.8794, 111.443e9),
    2023: (.4413, .2982, .2531, 1.5608, 0.9880, 99.584e9),
    2024: (.4621, .3151, .2397, 1.6459, 0.8673, 108.807e9),
    2025: (.4691, .3197, .2692, 1.5191, 0.8933, 98.767e9),
}


@pytest.fixture(scope="module")
def lines(spark):
    order = {(line.statement, line.label): line.order for line in STANDARD_LINES}
    rows = [("0000000042", s, label, order[s, label], 2021 + i, v * 1e6)
            for (s, label), values in CELLS.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cik string, statement string, line_label string, "
                                       "line_order int, fiscal_year int, value double")


@pytest.fixture(scope="module")
def wb(lines):
    return Workbook(None).override(statement_lines=lines)


def test_ratios(wb):
    for row in wb.ratios.collect():
        want = RATIOS[row["fiscal_year"]]
        got = tuple(round(row[i + 2], 4) for i in range(5))
        assert got == want[:5] and row["free_cash_flow"] == want[5]


def test_statements_tie_out(wb):
    assert {r["status"] for r in wb.check_balance.collect()} == {"pass"}
    assert {r["diff"] for r in wb.check_balance.collect()} == {0.0}
    assert {r["diff"] for r in wb.check_net_income.collect()} == {0.0}
    for r in wb.metrics.collect():
        assert r["operating_cf"] + r["investing_cf"] + r["financing_cf"] == r["net_change_cash_reported"]


def test_notable_items(wb):
    counts = {r["statement"]: r["count"] for r in wb.flagged_annual.groupBy("statement").count().collect()}
    assert counts == {"income": 14, "balance": 14, "cashflow": 16}
    top = {(r["statement"], r["place"]): r for r in wb.notable_annual.collect()}
    assert len(top) == 15
    assert top["income", 1]["period_label"] == "FY2021" and round(top["income", 1]["severity"], 4) == .0336
    assert (top["balance", 1]["line_label"], round(top["balance", 1]["severity"], 4)) == (
        "Current Liabilities", .0908)
    assert (top["cashflow", 1]["line_label"], top["cashflow", 1]["rule"]) == (
        "Net Change in Cash (reported)", "B")
    assert top["cashflow", 1]["text"] == "Net Change in Cash (reported) fell 114% YoY in FY2024."
    assert top["income", 4]["text"] == (
        "Income Tax was 7.6% of revenue in FY2024, well above its ~4.6% 4-year average.")


def test_common_size_of_the_base_is_one(wb):
    base = wb.common_size.filter("line_label IN ('Revenue', 'Total Assets')").collect()
    assert len(base) == 10 and {r["pct_of_base"] for r in base} == {1.0}


def test_bridge_steps_add_up(wb):
    from ledgerspan.operators import bridges
    by_year = {}
    for r in bridges.income_steps(wb.income_bridge_annual).collect():
        by_year.setdefault(r["fiscal_year"], {})[r["step"]] = r["amount"]
    for s in by_year.values():
        assert s["Revenue"] + s["Cost of Revenue"] == s["Gross Profit"]
        assert s["Gross Profit"] + s["Operating Exp."] == s["Operating Income"]
        assert s["Operating Income"] + s["Taxes & Other"] == s["Net Income"]


def test_comparator(wb):
    rows = {r["metric"]: r for r in wb.variance_ab().collect()}
    assert len(rows) == 8 and rows["Revenue"]["delta"] == 25126e6
    assert rows["Free Cash Flow"]["pct"] == pytest.approx((98767 - 108807) / 108807)
    top = wb.largest_mover().first()
    assert top["metric"] == "Total Equity" and top["margin_bps"] == 294
    assert top["text"] == ("Largest move FY2025 vs FY2024: Total Equity +29.5%. "
                           "Net margin expanded 294 bps to 26.9%.")
    fixed = {r["metric"]: r["base_year"] for r in wb.variance_ab(2023, 2021).collect()}
    assert set(fixed.values()) == {2023}


def test_narrative(spark, wb):
    items = spark.createDataFrame(
        [("0000000042", 2024, 10.2e9, "income-tax charge")],
        "cik string, fiscal_year int, amount double, reason string")
    normalized = narrative.normalized_margin(wb.metrics, items)
    assert round(normalized.first()["normalized_margin"], 4) == round((93736 + 10200) / 391035, 4)
    text = {r["section"]: r["text"] for r in narrative.narrative(wb.narrative_inputs, normalized).collect()}
    assert text["income"] == ("FY2025 revenue of $416.2B grew 6.4% YoY, while net margin expanded "
                              "294 bps to 26.9%.")
    assert text["balance"] == ("FY2025 total assets of $359.2B were 79% funded by liabilities; "
                               "shareholders' equity rose to $73.7B.")
    assert text["cashflow"] == ("FY2025 operating cash flow of $111.5B funded $12.7B of capex, "
                                "leaving $98.8B of free cash flow.")
    assert "ROE of 152%" in text["ratios"] and set(text) == {
        "income", "balance", "cashflow", "ratios", "ratios_note", "cashflow_note", "income_note"}
    assert "~26.6% (vs 24.0% reported)" in text["income_note"]


def test_kpis(wb):
    kpis = {r["kpi"]: r["change_text"] for r in wb.ratio_kpis.collect()}
    assert kpis == {"Return on Equity": "-13 pp vs FY2024", "Net Margin": "+2.9 pp vs FY2024",
                    "Current Ratio": "+0.03 vs FY2024", "Free Cash Flow": "-9.2% vs FY2024"}


def test_snapshot_has_every_cell_under_its_key(wb):
    snapshot = {r["key"]: r["value"] for r in wb.cell_snapshot.collect()}
    assert len(snapshot) == 100 and snapshot["balance|Total Assets|FY2025"] == 359241e6


@pytest.mark.parametrize("line,factor,status", [
    ("Total Assets", 1.006, "fail"), ("Total Assets", 1.004, "pass"), ("Total Assets", None, "fail")])
def test_gate_turns_red_on_a_planted_value(lines, line, factor, status):
    from pyspark.sql import functions as F
    here = (F.col("line_label") == line) & (F.col("fiscal_year") == 2023)
    value = F.lit(None).cast("double") if factor is None else F.col("value") * factor
    wb = Workbook(None).override(statement_lines=lines.withColumn(
        "value", F.when(here, value).otherwise(F.col("value"))))
    got = {r["fiscal_year"]: r["status"] for r in wb.check_balance.collect()}
    assert got[2023] == status and {got[y] for y in (2021, 2022, 2024, 2025)} == {"pass"}
    gate = checks.company_gate(wb.check_balance)
    if status == "fail":
        with pytest.raises(checks.GateFailed):
            checks.require_all_pass(gate)
    else:
        checks.require_all_pass(gate)


def test_annotation_finds_cells(spark, wb):
    notes = spark.createDataFrame([("0000000042", "income|Revenue|FY2023", "dollar", "")],
                                  "cik string, key string, explanation string, source_url string")
    revised = spark.createDataFrame([("0000000042", "income|Revenue|FY2022", 1.0, 2.0, "2026-01-01")],
                                    "cik string, key string, old double, new double, date string")
    out = {(r["line_label"], r["period_label"]): r for r in cells.annotate(
        wb.annual_cells.filter("statement = 'income'"), wb.notable_annual, notes, revised).collect()}
    assert len(out) == 40
    assert out["Revenue", "FY2023"]["explanation"] == "dollar"
    assert out["Revenue", "FY2022"]["revised_new"] == 2.0
    assert out["Income Tax", "FY2024"]["notable_text"].startswith("Income Tax was 7.6%")


def test_rule_b_needs_no_minimum_points_and_rule_a_excludes_it(spark):
    rows = [("1", "balance", "Total Assets", 1, y, 100.0) for y in (2020, 2021)]
    rows += [("1", "balance", "Current Assets", 2, 2020, 10.0), ("1", "balance", "Current Assets", 2, 2021, 20.0)]
    frame = spark.createDataFrame(rows, "cik string, statement string, line_label string, "
                                        "line_order int, fiscal_year int, value double")
    two = dicts(notable.flag_notable(cells.annual_cells(frame), False))
    assert [(r["rule"], r["period_key"]) for r in two] == [("B", "2021")]
    third = spark.createDataFrame([("1", "balance", "Total Assets", 1, 2022, 100.0),
                                   ("1", "balance", "Current Assets", 2, 2022, 20.0)], frame.schema)
    three = dicts(notable.flag_notable(cells.annual_cells(frame.union(third)), False))
    assert sorted((r["rule"], r["period_key"]) for r in three) == [
        ("A", "2020"), ("A", "2021"), ("A", "2022")]


def test_revision_tolerance_and_vanished_keys(spark):
    def snap(**values):
        return spark.createDataFrame([("1", k, float(v)) for k, v in values.items()],
                                     "cik string, key string, value double")
    old = snap(same=1e9, noise=1e9, moved=1e9, small=100, gone=5)
    new = snap(same=1e9, noise=1.0004e9, moved=1.0006e9, small=1099, fresh=7)
    got = revisions.detect_revisions(old, new, "2026-01-05").collect()
    assert [(r["key"], r["old"], r["new"], r["date"]) for r in got] == [
        ("moved", 1e9, 1.0006e9, "2026-01-05")]
