import random

from conftest import dicts

from ledgerspan.operators import quarterly
from ledgerspan.plans.workbook import Workbook
from ledgerspan.settings import Settings

ENDS = {1: "2019-12-28", 2: "2020-03-28", 3: "2020-06-27", 4: "2020-09-26"}


def ytd(concept, values, start="2019-09-29", ends=ENDS, **more):
    """Year-to-date facts by quarter number."""
    return [{"concept": concept, "start": start, "end": ends[q], "value": value,
             "form": "10-K" if q == 4 else "10-Q", "fp": "FY" if q == 4 else f"Q{q}", **more}
            for q, value in values.items()]


def quarters(frame, concept):
    rows = frame.filter(f"concept = '{concept}'").orderBy("period_end").collect()
    return [(r["qnum"], r["value"]) for r in rows]


def test_quarters_are_differences_of_year_to_date(make_facts):
    facts = make_facts(*ytd("NetIncomeLoss", {1: 10, 2: 25, 3: 45, 4: 70}))
    wb = Workbook(facts)
    assert quarters(wb.flow_standalone, "NetIncomeLoss") == [(1, 10), (2, 15), (3, 20), (4, 25)]
    assert [r["label"] for r in wb.quarter_spine.orderBy("period_end").collect()] == [
        "Q1 FY20", "Q2 FY20", "Q3 FY20", "Q4 FY20"]
    assert wb.quarterly_reconcile.first()["sum_quarters"] == 70.0


def test_three_month_facts_do_not_start_a_fiscal_year(make_facts):
    alone = {"concept": "NetIncomeLoss", "start": "2019-12-29", "end": "2020-03-28", "value": 15,
             "form": "10-Q", "fp": "Q2"}
    wb = Workbook(make_facts(*ytd("NetIncomeLoss", {1: 10, 2: 25}), alone))
    assert wb.fy_starts.count() == 1
    assert quarters(wb.flow_standalone, "NetIncomeLoss") == [(1, 10), (2, 15)]


def test_any_tag_can_mark_the_fiscal_year_start(make_facts):
    wb = Workbook(make_facts(*ytd("NetIncomeLoss", {1: 10}), *ytd("GrossProfit", {2: 30})))
    assert quarters(wb.flow_standalone, "NetIncomeLoss") == [(1, 10)]


def test_restated_year_to_date_uses_the_last_filing(make_facts):
    wb = Workbook(make_facts(
        *ytd("NetIncomeLoss", {1: 10, 2: 25}),
        *ytd("NetIncomeLoss", {1: 12}, filed="2021-11-01", form="10-Q", fp="Q1")))
    assert quarters(wb.flow_standalone, "NetIncomeLoss") == [(1, 12), (2, 13)]


def test_missing_point_shifts_positions_and_is_marked(make_facts):
    wb = Workbook(make_facts(*ytd("GrossProfit", {1: 10, 3: 45, 4: 70})))
    rows = dicts(wb.flow_standalone.orderBy("period_end"))
    assert [(r["qnum"], r["duration_q"], r["gap"], r["value"]) for r in rows] == [
        (1, 1, False, 10.0), (2, 3, True, 35.0), (3, 4, True, 25.0)]


def test_fiscal_year_rule(make_facts):
    calendar = {1: "2020-03-31", 2: "2020-06-30"}
    facts = make_facts(*ytd("NetIncomeLoss", {1: 1, 2: 2}, start="2020-01-01", ends=calendar))
    assert {r["fiscal_year"] for r in Workbook(facts).flow_standalone.collect()} == {2021}
    by_end = Workbook(facts, Settings(fiscal_year_rule="year_end")).flow_standalone
    assert {r["fiscal_year"] for r in by_end.collect()} == {2020}


def test_spine_has_one_row_per_quarter_end(make_facts):
    overlapping = {"concept": "NetIncomeLoss", "start": "2019-09-28", "end": ENDS[4], "value": 71}
    facts = make_facts(*ytd("NetIncomeLoss", {1: 10, 2: 25, 3: 45, 4: 70}), overlapping)
    assert Workbook(facts).quarter_spine.count() == 4


def test_spine_starts_with_the_annual_window_and_keeps_whole_years(make_facts):
    rows = []
    for year in range(2012, 2021):
        ends = {1: f"{year - 1}-12-28", 2: f"{year}-03-28", 3: f"{year}-06-27", 4: f"{year}-09-26"}
        rows += ytd("NetIncomeLoss", {1: 1, 2: 3, 3: 6, 4: 10}, start=f"{year - 1}-09-29", ends=ends)
    running = {1: "2020-12-26"}
    half = {2: "2021-03-27"}
    rows += ytd("NetIncomeLoss", {1: 2}, start="2020-09-27", ends=running)
    rows += ytd("NetIncomeLoss", {2: 4}, start="2020-09-27", ends=half)
    wb = Workbook(make_facts(*rows))
    years = {r["fiscal_year"]: (r["n_quarters"], r["partial"]) for r in wb.quarter_years.collect()}
    assert years == {**{y: (4, False) for y in range(2016, 2021)}, 2021: (2, True)}
    assert wb.visible_quarters.count() == 12
    assert quarterly.visible_quarters(wb.quarter_spine, fiscal_year=2017).count() == 4
    ytd_growth = wb.growth_quarterly.filter("statement = 'income' AND period_key = '2021Q1'").first()
    assert (ytd_growth["prior_value"], ytd_growth["growth"]) == (1.0, 1.0)
    qoq = wb.growth_qoq.filter("statement = 'income' AND period_key = '2021Q1'").first()
    assert (qoq["prior_value"], qoq["growth"]) == (4.0, -0.5)


def test_balances_are_snapshots_and_the_grid_is_dense(make_facts):
    facts = make_facts(
        *ytd("NetIncomeLoss", {1: 10, 2: 25, 3: 45, 4: 70}), {"end": ENDS[4], "value": 500},
        {"end": ENDS[1], "value": 400, "form": "10-Q", "fp": "Q1"},
        {"end": "2020-02-02", "value": 1, "form": "10-Q", "fp": "Q1"})
    wb = Workbook(facts)
    rows = {r["period_key"]: r for r in wb.quarterly_cells.filter("statement = 'balance'").collect()}
    assert {k: r["value"] for k, r in rows.items()} == {
        "2020Q1": 400.0, "2020Q2": None, "2020Q3": None, "2020Q4": 500.0}
    assert not any(r["derived"] for r in rows.values())
    flags = {(r["statement"], r["qnum"]): r["derived"] for r in wb.quarterly_cells.collect()}
    assert flags["income", 4] and not flags["income", 3]
    assert flags["cashflow", 2] and not flags["cashflow", 1]


def test_quarters_telescope_to_the_last_year_to_date(make_facts):
    rng = random.Random(7)
    rows, last = [], {}
    for company in range(30):
        present = sorted(rng.sample([1, 2, 3, 4], rng.randint(1, 4)) + [2])
        values = {q: rng.randint(-10**9, 10**9) for q in present}
        rows += ytd("NetIncomeLoss", values, cik=f"{company:010d}")
        last[f"{company:010d}"] = values[max(values)]
    sums = Workbook(make_facts(*rows)).quarterly_reconcile.collect()
    assert {r["cik"]: r["sum_quarters"] for r in sums} == last
