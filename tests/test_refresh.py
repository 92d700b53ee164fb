import json

import pytest
from conftest import dicts

from pyspark.sql import functions as F

from ledgerspan.functions.text import page_number, page_percent, page_signed
from ledgerspan.operators import checks, revisions
from ledgerspan.plans import refresh
from ledgerspan.plans.catalog import filed_by
from ledgerspan.plans.workbook import Workbook
from ledgerspan.sources.company_facts import to_documents
from ledgerspan.settings import RATIO_FORMATS
from ledgerspan.sources import tables
from ledgerspan.sources.derived import base_facts, derive_companies, quarter_amounts
from ledgerspan.sources.snapshots import SnapshotStore
from ledgerspan.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_store_keeps_runs_and_the_last_record_of_a_key(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.last_run() == 0 and store.log().count() == 0
    for value, date in ((1e6, "d1"), (2e6, "d2"), (2e6, "d3"), (5e6, "d4")):
        snapshot = spark.createDataFrame([("1", "k", value)], "cik string, key string, value double")
        refresh.record_revisions(store, snapshot, date)
    assert store.last_run() == 4 and store.snapshot().first()["value"] == 5e6
    assert sorted((r["seq"], r["old"], r["new"]) for r in store.log().collect()) == [
        (2, 1e6, 2e6), (4, 2e6, 5e6)]
    last = revisions.latest_revisions(store.log()).collect()
    assert [(r["old"], r["new"], r["date"]) for r in last] == [(2e6, 5e6, "d4")]


def test_refresh_publishes_and_logs_restatements(spark, tmp_path):
    facts = base_facts(spark, SF)
    inputs = {"companies": derive_companies(spark, SF)}
    first = refresh.run_refresh(filed_by(facts, "2001-01-01"), str(tmp_path), "2001-01-01", inputs,
                                marts=())
    second = refresh.run_refresh(facts, str(tmp_path), "2002-12-31", inputs, marts=("ratios",))
    assert (first.run, second.run) == (1, 2)
    assert second.companies_published == facts.select("cik").distinct().count()
    stored = spark.read.parquet(f"{second.gold}/ratios")
    assert sorted(map(str, stored.collect())) == sorted(map(str, Workbook(facts).ratios.collect()))
    log = SnapshotStore(spark, f"{tmp_path}/store").log().collect()
    assert {r["key"] for r in log} == {"income|Operating Income|FY2000"}
    document = json.loads(spark.read.parquet(f"{second.gold}/documents").orderBy("cik").first()["document"])
    revenue = [line for line in document["statements"]
               if line["line"] == "Revenue" and line["frequency"] == "annual"][0]
    assert list(revenue["values"]) == ["1997", "1998", "1999", "2000", "2001"]
    assert [r["fiscal_year"] for r in document["years"]] == [1997, 1998, 1999, 2000, 2001]
    assert list(dict.fromkeys(r["label"] for r in document["ratios"])) == list(RATIO_FORMATS)
    assert revenue["base_label"] == "% of Revenue"
    severities = [r["severity"] for r in document["notable_quarterly"]]
    assert severities == sorted(severities, reverse=True)
    quarters = [p for p in document["periods"] if (p["statement"], p["frequency"]) == ("income", "quarterly")]
    known = {p["period_key"] for p in quarters}
    assert known and sum(p.get("prev_key") in known for p in quarters) > len(quarters) // 2
    shown = {(r["line_label"], r["period_key"]): r["value"] for r in document["base_series"]}
    assert shown["Revenue", "2001"] == revenue["values"]["2001"]
    assert {"metrics", "ratios", "cash_recon", "notable_annual", "notable_quarterly", "insights",
            "income_bridges", "cash_bridges", "quarter_years", "meta"} <= set(document)


def test_a_company_in_quarantine_keeps_its_stored_values(spark, make_facts, tmp_path):
    def company(cik, assets, liabilities=4e6, equity=6e6):
        return [{"cik": cik, "value": assets}, {"cik": cik, "concept": "Liabilities", "value": liabilities},
                {"cik": cik, "concept": "StockholdersEquity", "value": equity},
                {"cik": cik, "start": "2019-10-01", "concept": "NetIncomeLoss", "value": 1e6}]
    runs = ([*company("a", 10e6), *company("b", 10e6)], [*company("a", 10e6), *company("b", 11e6)],
            [*company("a", 10e6), *company("b", 12e6, 5e6, 7e6)])
    for day, rows in enumerate(runs, start=1):
        refresh.run_refresh(make_facts(*rows), str(tmp_path), f"2020-12-0{day}", quarantine=True, marts=())
    log = SnapshotStore(spark, f"{tmp_path}/store").log().collect()
    assert sorted((r["cik"], r["old"], r["new"], r["seq"]) for r in log) == [
        ("b", 4e6, 5e6, 3), ("b", 6e6, 7e6, 3), ("b", 10e6, 12e6, 3)]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        conf, sparkContext = {}, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session)


def test_every_order_line_is_in_the_facts(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "sum(floor(l_extendedprice * (1 - l_discount)))").first()[0]
    assert quarter_amounts(spark, SF).selectExpr("sum(rev)").first()[0] == lines


def test_figures_of_the_page_round_halves_up_and_separate_thousands(spark):
    row = spark.range(1).select(
        page_percent(F.lit(12.345)).alias("share"), page_number(F.lit(0.125), 2).alias("ratio"),
        page_signed(F.lit(12.5), 0, " pp").alias("points")).first()
    assert tuple(row) == ("1,234.5%", "0.13", "+13 pp")


def test_gate_blocks_publishing_or_quarantines(spark, make_facts, tmp_path):
    def company(cik, assets):
        flow = {"cik": cik, "start": "2019-10-01"}
        return [{"cik": cik, "value": assets}, {"cik": cik, "concept": "Liabilities", "value": 4e6},
                {"cik": cik, "concept": "StockholdersEquity", "value": 6e6},
                {**flow, "concept": "NetIncomeLoss", "value": 1e6}]
    facts = make_facts(*company("good", 10e6), *company("bad", 11e6))
    with pytest.raises(checks.GateFailed, match="1 of 2"):
        refresh.run_refresh(facts, str(tmp_path / "strict"), "2020-12-01")
    assert not (tmp_path / "strict/run=1/gold").exists()
    assert not (tmp_path / "strict/store").exists()
    result = refresh.run_refresh(facts, str(tmp_path / "loose"), "2020-12-01", quarantine=True,
                                 marts=("metrics",))
    assert result.companies_published == 1
    assert {r["cik"] for r in spark.read.parquet(f"{result.gold}/metrics").collect()} == {"good"}


def test_cash_checks(make_facts):
    cash = "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"

    def year(y, start_cash, flows, end_cash, shown, assets=1e6):
        at = {"end": f"{y}-09-30", "fy": y, "filed": f"{y}-11-01"}
        span = {**at, "start": f"{y - 1}-10-01"}
        names = ["Operating", "Investing", "Financing"]
        return [{**span, "concept": f"NetCashProvidedByUsedIn{n}Activities", "value": v}
                for n, v in zip(names, flows)] + [
            {**at, "concept": cash, "value": end_cash}, {**at, "value": assets},
            {**at, "concept": "CashAndCashEquivalentsAtCarryingValue", "value": shown}]
    wb = Workbook(make_facts(
        *year(2018, None, (1, 1, 1), 100000, 100000), *year(2019, 100000, (5000, 0, 0), 105000, 90000),
        *year(2020, 105000, (5000, 0, 0), 120000, 99000)))
    roll = {r["fiscal_year"]: r["status"] for r in wb.check_cash_rollforward.collect()}
    assert roll == {2018: "skipped", 2019: "pass", 2020: "fail"}
    tie = {r["fiscal_year"]: (r["status"], r["note"]) for r in wb.check_cash_tieout.collect()}
    assert tie == {2018: ("pass", "exact"), 2019: ("pass", "restricted cash"),
                   2020: ("fail", "restricted cash")}
    summary = {r["check_name"]: (r["n_checked"], r["n_skipped"], r["n_failed"])
               for r in wb.integrity_summary.collect()}
    assert summary["cash_rollforward"] == (2, 1, 1)


def test_quarterly_check_fails_on_a_diverging_annual(make_facts):
    ends = {1: "2019-12-31", 2: "2020-03-31", 3: "2020-06-30", 4: "2020-09-30"}
    rows = [{"concept": "NetIncomeLoss", "start": "2019-10-01", "end": ends[q], "value": q * 1e6,
             "form": "10-Q", "fp": f"Q{q}"} for q in (1, 2, 3)]
    annual = {"concept": "NetIncomeLoss", "start": "2019-10-01", "end": ends[4]}
    newer_quarterly_view = {**annual, "value": 4e6, "form": "10-Q", "fp": "Q4", "filed": "2021-02-01"}
    good = Workbook(make_facts(*rows, {**annual, "value": 4e6}))
    assert [r["status"] for r in good.check_quarterly.collect()] == ["pass"]
    bad = Workbook(make_facts(*rows, {**annual, "value": 5e6}, newer_quarterly_view))
    assert [(r["item"], r["status"]) for r in bad.check_quarterly.collect()] == [("Net Income", "fail")]


def test_incremental_refresh_touches_only_companies_that_filed(spark, tmp_path):
    facts = base_facts(spark, SF)
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")

    def land(part):
        to_documents(part).select("document").coalesce(1).write.mode("append").text(landing)

    early = filed_by(facts, "2001-01-01")
    land(early)
    incremental.refresh_available(spark, landing, root, "2001-01-01")
    before = dicts(incremental.current_lines(spark, root))
    assert before and sorted(map(str, before)) == sorted(map(str, dicts(
        Workbook(early).statement_lines.select(*incremental.LINES.fieldNames()))))
    land(facts.filter("filed > '2001-01-01' AND cik = '0000000000'"))
    incremental.refresh_available(spark, landing, root, "2002-12-31")
    lines = incremental.current_lines(spark, root)
    assert lines.count() == len(before)
    log = dicts(incremental.revision_log(spark, root))
    assert [(r["cik"], r["key"]) for r in log] == [("0000000000", "income|Operating Income|FY2000")]
    # batch 1 rewrote the bucket of the one company that filed, and nothing else
    store = incremental.lines_store(spark, root)
    moved = {b for b, v in store.manifest().items() if v == 1}
    assert len(moved) == 1 and all(f"/v=1/bucket=" in p for p in store.paths(moved))
    assert {r["cik"] for r in store.read(moved).collect()} >= {"0000000000"}
    incremental.refresh_available(spark, landing, root, "2003-01-01")
    assert incremental.current_lines(spark, root).count() == len(before)


def test_job_runs_from_raw_documents(spark, tmp_path):
    from ledgerspan.plans import job
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    to_documents(base_facts(spark, SF)).select("document").coalesce(2).write.text(raw)
    (tmp_path / "notes.json").write_text(json.dumps({"cik": 1, "notes": [
        {"statement": "income", "line": "Revenue", "period": "FY1999", "explanation": "why"}]}))
    code = job.main(["--raw", raw, "--out", out, "--lines", "--notes", str(tmp_path / "notes.json"),
                     "--run-date", "2002-12-31"])
    assert code == 0
    marked = spark.read.parquet(f"{out}/run=1/gold/annotated_cells").filter("explanation = 'why'")
    assert [(r["cik"], r["line_label"]) for r in marked.collect()] == [("0000000001", "Revenue")]
