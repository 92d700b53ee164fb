"""What a batch writes and how often rows are dealt, and that results stay those of plain selection."""

import os

from conftest import dicts

from pyspark.sql import functions as F

from ledgerspan.functions.pick import latest_filed
from ledgerspan.plans import catalog
from ledgerspan.sources.company_facts import facts_from, parse_documents, to_documents
from ledgerspan.sources.derived import base_facts
from ledgerspan.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_documents_are_dealt_once_and_keep_units(make_facts):
    facts = make_facts({"value": 1}, {"value": 2, "unit": "EUR"}, {"value": 3, "unit": "EUR", "end": "2019-09-30"},
                       {"value": 4, "concept": "Liabilities"}, {"value": 5, "accn": "a-2"})
    documents = to_documents(facts)
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert documents.count() == 2
    columns = ["concept", "unit", "period_end", "value", "accn"]
    got = facts_from(parse_documents(documents)).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, facts.select(*columns).collect()))


def test_a_batch_writes_shared_relations_once_and_the_first_one_its_facts_once(spark, make_facts, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    facts = base_facts(spark, SF).where("cik = '0000000000'")
    for _ in range(2):  # the same filings twice: facts are a set
        to_documents(facts).select("document").write.mode("append").text(landing)
    incremental.refresh_available(spark, landing, root, "2001-01-01")
    assert not os.path.exists(f"{root}/work/batch=0/arrived")
    assert os.path.exists(f"{root}/work/batch=0/silver/flow_standalone")
    stored = incremental.facts_store(spark, root)
    assert stored.read().count() == facts.distinct().count()
    to_documents(make_facts({"cik": "0000000000", "accn": "late"}, {"cik": "0000000077"})).select(
        "document").write.mode("append").text(landing)
    incremental.refresh_available(spark, landing, root, "2002-01-01")
    assert stored.read().count() == facts.distinct().count() + 2


def test_the_replay_grows_in_files_and_its_first_batch_is_written_once(spark, monkeypatch, tmp_path):
    base_facts(spark, SF).repartition(5).write.parquet(str(tmp_path / "five"))
    facts = spark.read.parquet(str(tmp_path / "five"))
    seen = {}

    def latest(spark, landed, root, files_per_batch):
        seen.update(landed=landed, files=files_per_batch, root=root)
        return available(spark, landed, root, files_per_batch)

    available = incremental.latest_filed_available
    monkeypatch.setattr(catalog, "base_facts", lambda *_: facts)
    monkeypatch.setattr(incremental, "latest_filed_available", latest)
    got = catalog.latest_filed_stream(spark, SF)
    assert seen["files"] == 5 and len(spark.read.parquet(seen["landed"]).inputFiles()) > 4
    assert not os.path.exists(f"{seen['root']}/work/batch=0")
    want = latest_filed(facts, incremental.KEYS, ["value", "filed", "accn"], missing_date_wins=True)
    columns = [*incremental.KEYS, "value", "filed", "accn"]
    assert sorted(map(str, dicts(got.select(*columns)))) == sorted(map(str, dicts(want.select(*columns))))
    assert got.where(F.col("cik").isNull()).count() == 0
