import pytest
from conftest import dicts

from ledgerspan.operators import annual, quarterly, selection
from ledgerspan.plans.workbook import Workbook
from ledgerspan.settings import Settings

CASH = Settings().cash_concept


def only(frame, column="value"):
    return [r[column] for r in frame.collect()]


def test_last_filed_version_wins_and_an_undated_one_loses(make_facts):
    facts = make_facts({"value": 1, "filed": "2020-11-01"}, {"value": 2, "filed": "2021-11-01"},
                       {"value": 3, "filed": None})
    assert only(annual.annual_facts(facts)) == [2.0]
    assert only(selection.dedup_facts(facts)) == [3.0]
    cash = make_facts({"concept": CASH, "value": 1}, {"concept": CASH, "value": 2, "filed": None})
    assert only(quarterly.quarter_end_cash(cash), "ending_cash") == [2.0]
    assert only(annual.cash_anchor(cash), "ending_cash") == [1.0]


@pytest.mark.parametrize("turn", [False, True])
def test_same_day_versions_are_chosen_by_accession(make_facts, turn):
    rows = [{"value": 5, "accn": "a-9"}, {"value": 8, "accn": "a-1"}]
    assert only(annual.annual_facts(make_facts(*(rows[::-1] if turn else rows)))) == [5.0]


def test_filter_comes_before_version_choice(make_facts):
    later_quarterly = {"value": 2, "form": "10-Q", "fp": "Q1", "filed": "2021-02-01"}
    assert only(annual.annual_facts(make_facts({"value": 1}, later_quarterly))) == [1.0]


def test_window_is_bounded_by_all_annual_filings_even_short_ones(make_facts):
    rows = [{"end": f"{y}-09-30", "value": y} for y in range(2014, 2021)]
    assert sorted(only(annual.annual_facts(make_facts(*rows)), "fiscal_year")) == list(range(2016, 2021))
    short = {"concept": "X", "start": "2021-01-01", "end": "2021-03-31"}
    assert sorted(only(annual.annual_facts(make_facts(*rows, short)), "fiscal_year")) == list(range(2017, 2021))


def test_year_comes_from_the_period_end_not_the_tag(make_facts):
    facts = make_facts({"end": "2018-09-29", "fy": 2020}, {"end": "2019-09-28", "fy": 2020, "value": 2})
    assert sorted(only(annual.annual_facts(facts), "fiscal_year")) == [2018, 2019]
    assert only(selection.annual_facts_by_tag(facts), "fiscal_year") == [2020, 2020]


def test_by_tag_counts_distinct_tags_and_ignores_missing_ones(make_facts):
    facts = make_facts(*[{"fy": fy, "end": f"{fy}-09-30"} for fy in (2010, 2012, 2013, 2015, 2016, 2019)],
                       {"fy": None})
    assert sorted(only(selection.annual_facts_by_tag(facts), "fiscal_year")) == [
        2012, 2013, 2015, 2016, 2019]


def test_fallback_tag_only_without_the_preferred_one(make_facts):
    facts = make_facts(
        {"concept": "RevenueFromContractWithCustomerExcludingAssessedTax", "start": "2018-10-01",
         "end": "2019-09-30", "value": 10},
        {"concept": "Revenues", "start": "2018-10-01", "end": "2019-09-30", "value": 11},
        {"concept": "Revenues", "start": "2019-10-01", "end": "2020-09-30", "value": 12})
    got = {r["fiscal_year"]: r["value"] for r in Workbook(facts).statement_lines.collect()}
    assert got == {2019: 10.0, 2020: 12.0}


def test_one_tag_feeds_two_lines(make_facts):
    facts = make_facts({"concept": "NetIncomeLoss", "start": "2019-10-01"})
    got = {(r["statement"], r["line_label"]) for r in Workbook(facts).statement_lines.collect()}
    assert got == {("income", "Net Income"), ("cashflow", "Net Income")}


def test_two_year_ends_in_one_calendar_year(make_facts):
    facts = make_facts({"end": "2020-01-02", "value": 1}, {"end": "2020-12-31", "value": 2},
                       {"concept": CASH, "end": "2020-01-02", "value": 3},
                       {"concept": CASH, "end": "2020-12-31", "value": 4})
    wb = Workbook(facts)
    assert [r["value"] for r in wb.statement("balance").filter("line_order = 1").collect()] == [2.0]
    assert only(wb.cash_reconciliation, "reported_ending_cash") == [4.0]


def test_unit_filter_is_optional(make_facts):
    facts = make_facts({"value": 1, "unit": "USD"}, {"value": 2, "unit": "EUR", "filed": "2021-01-01"})
    assert only(annual.annual_facts(facts)) == [2.0]
    assert only(annual.annual_facts(facts, Settings(unit="USD"))) == [1.0]


def test_zero_denominators_give_null(make_facts):
    facts = make_facts(
        {"concept": "Revenues", "start": "2019-10-01", "value": 0},
        {"concept": "NetIncomeLoss", "start": "2019-10-01", "value": 5},
        {"concept": "StockholdersEquity", "value": 0})
    row = Workbook(facts).ratios.first()
    assert row["net_margin"] is None and row["roe"] is None
    assert Workbook(facts).common_size.filter("line_label = 'Net Income'").first()["pct_of_base"] is None


def test_companies_do_not_mix(make_facts):
    rows = [{"cik": cik, "end": f"{year}-09-30", "value": year}
            for cik, years in (("a", (2009, 2010)), ("b", (2019, 2020))) for year in years]
    got = dicts(annual.annual_facts(make_facts(*rows)))
    assert {(r["cik"], r["fiscal_year"]) for r in got} == {
        ("a", 2009), ("a", 2010), ("b", 2019), ("b", 2020)}


def test_one_company_with_a_third_of_all_rows(make_facts):
    hot = [{"cik": "hot", "value": v, "accn": f"a-{v:05d}"} for v in range(1000)]
    rest = [{"cik": f"c{v}", "value": v} for v in range(2000)]
    got = {r["cik"]: r["value"] for r in annual.annual_facts(make_facts(*hot, *rest)).collect()}
    assert len(got) == 2001 and got["hot"] == 999.0
