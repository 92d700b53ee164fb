import json
from types import SimpleNamespace

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from ledgerspan.operators import mapping, selection
from ledgerspan.plans.workbook import Workbook
from ledgerspan.sources import company_facts, notes, tables
from ledgerspan.streaming import incremental


def point(**fields):
    return {"end": "2020-09-30", "val": 5, "accn": "a-1", "fy": 2020, "fp": "FY", "form": "10-K",
            "filed": "2020-11-01", **fields}


@pytest.fixture
def raw_zone(tmp_path):
    first = {"cik": 42, "entityName": "First", "facts": {
        "dei": {"Shares": {"units": {"shares": [point()]}}},
        "us-gaap": {
            "Assets": {"units": {"USD": [point(), point(end="not a date", fy=None)], "EUR": [point(val=7)]}},
            "NetIncomeLoss": {"units": {"USD": [point(start="2019-10-01", frame="CY2020")]}},
            "Empty": {"units": {"USD": []}}}}}
    second = {"cik": 7, "entityName": "Second", "facts": {"dei": {}}}
    third = {"cik": 8, "entityName": "Third"}
    for name, document in (("a", first), ("b", second), ("c", third)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=2))
    return str(tmp_path)


def test_flatten_keeps_only_the_taxonomy_and_every_datapoint(spark, raw_zone):
    documents = company_facts.read_documents(spark, raw_zone)
    facts = dicts(company_facts.facts_from(documents).orderBy("concept", "unit", "period_end"))
    assert [(f["concept"], f["unit"]) for f in facts] == [
        ("Assets", "EUR"), ("Assets", "USD"), ("Assets", "USD"), ("NetIncomeLoss", "USD")]
    assert {f["cik"] for f in facts} == {"0000000042"}
    assert facts[1]["period_end"] is None and facts[1]["fiscal_year"] is None
    assert facts[3]["duration_days"] == 365 and facts[3]["frame"] == "CY2020"
    assert facts[2]["duration_days"] is None and facts[2]["period_start"] is None


def test_companies_come_from_the_documents(spark, raw_zone):
    documents = company_facts.read_documents(spark, raw_zone)
    tickers = spark.createDataFrame([("0000000042", "FST")], "cik string, ticker string")
    rows = dicts(company_facts.companies_from(documents, tickers).orderBy("cik"))
    assert [(r["ticker"], r["entity_name"]) for r in rows] == [
        (None, "Second"), (None, "Third"), ("FST", "First")]


def test_broken_document_stops_the_read(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"cik": 1, "facts": ')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        company_facts.facts_from(company_facts.read_documents(spark, str(tmp_path))).collect()


def test_documents_round_trip(spark, make_facts):
    facts = make_facts({}, {"concept": "NetIncomeLoss", "start": "2019-10-01"},
                       {"concept": "NetIncomeLoss", "start": "2020-07-01"},
                       {"unit": "EUR", "filed": None, "value": None})
    texts = company_facts.to_documents(facts)
    assert texts.count() == 1
    back = company_facts.facts_from(company_facts.parse_documents(texts))
    assert sorted(map(str, back.collect())) == sorted(map(str, facts.collect()))


def test_load_replaces_the_table(spark, make_facts, tmp_path):
    path = str(tmp_path / "facts")
    tables.load_facts(make_facts({}, {"concept": "Liabilities"}), path)
    table = tables.load_facts(make_facts({"value": 9}), path)
    assert [r["value"] for r in table.collect()] == [9.0]


def test_notes_default_url_missing_file_and_key(spark, tmp_path):
    assert notes.read_notes(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "n.json").write_text(json.dumps({"cik": 3, "notes": [
        {"statement": "income", "line": "Revenue", "period": "FY2020", "explanation": "why"}]}, indent=1))
    row = notes.read_notes(spark, str(tmp_path / "n.json")).first()
    assert (row["key"], row["source_url"]) == ("income|Revenue|FY2020", "")


def test_concept_map_has_ordered_candidates(spark):
    rows = dicts(mapping.concept_map(spark))
    assert len(rows) == 32 and len({(r["statement"], r["line_label"]) for r in rows}) == 20
    revenue = sorted((r["priority"], r["concept"]) for r in rows if r["line_label"] == "Revenue")
    assert [c for _, c in revenue] == ["RevenueFromContractWithCustomerExcludingAssessedTax",
                                       "Revenues", "SalesRevenueNet"]


def test_empty_facts_give_empty_statements(spark, make_facts):
    wb = Workbook(make_facts())
    assert wb.ratios.count() == 0 and wb.quarterly_cells.count() == 0
    assert selection.ingest_summary(wb.facts).count() == 0


def test_latest_filed_stream_equals_batch(spark, make_facts, tmp_path):
    facts = make_facts(
        {"value": 1, "filed": "2020-11-01"}, {"value": 2, "filed": "2021-11-01", "accn": "a-2"},
        {"value": 3, "filed": "2020-12-01"}, {"concept": "Cash", "value": 4, "filed": None},
        {"concept": "Cash", "value": 5}, {"concept": "NI", "start": "2019-10-01", "value": 6})
    landing = str(tmp_path / "in")
    for value in range(1, 7):
        facts.filter(f"value = {value}").coalesce(1).write.mode("append").parquet(landing)
    got = incremental.latest_filed_available(spark, landing, str(tmp_path / "out"), files_per_batch=1)
    want = selection.dedup_facts(facts)
    pick = ["concept", "value", "filed"]
    assert sorted(map(str, got.select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))
    assert {r["value"] for r in got.collect()} == {2.0, 4.0, 6.0}
    # a later file is taken up by the next call from where the last one stopped
    later = facts.filter("value = 6").withColumns({"value": F.lit(7.0), "accn": F.lit("b-1")})
    later.coalesce(1).write.mode("append").parquet(landing)
    again = incremental.latest_filed_available(spark, landing, str(tmp_path / "out"))
    assert {r["value"] for r in again.collect()} == {2.0, 4.0, 7.0}


def test_shared_folder_follows_the_session(spark):
    assert tables.shared_folder(spark) == tables.shared_folder(spark)
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/named-by-cluster/"})
    assert tables.shared_folder(named) == "/shared/named-by-cluster"
    assert tables.scratch_path(named, "x") != tables.scratch_path(named, "x")
