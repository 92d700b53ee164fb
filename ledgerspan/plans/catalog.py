"""The query catalog: every operator of the engine over facts derived from the given tables.

Ratios are rounded to six decimals here, at the comparison boundary, and nowhere in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspan.functions.labels import quarter_label, year_label
from ledgerspan.operators import bridges, cells, comparator, mapping, notable, revisions, selection
from ledgerspan.plans import refresh
from ledgerspan.plans.workbook import Workbook
from ledgerspan.sources import company_facts, notes, snapshots, tables
from ledgerspan.sources.derived import base_facts, derive_companies, derive_facts
from ledgerspan.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

# Dates at which the restatement queries look at the filings received so far.
AS_OF = ["1999-01-01", "2000-01-01", "2001-01-01", "2002-12-31"]


def book(spark: SparkSession, sf_dir: str) -> Workbook:
    return Workbook(base_facts(spark, sf_dir))


_SILVER: dict[str, Workbook] = {}


def silver_book(spark: SparkSession, sf_dir: str) -> Workbook:
    """The workbook over stored silver relations, written once per copy of the base facts, as the job does.

    For results that put many relations together: they read no facts any more.
    """
    facts = base_facts(spark, sf_dir)
    copy = facts.inputFiles()[0].rpartition("/")[0]
    if copy not in _SILVER:
        _SILVER[copy] = refresh.with_silver(Workbook(facts), tables.scratch_path(spark, "silver"))
    return _SILVER[copy].override()


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({name: F.round(name, digits) for name in columns})


def note_documents(metric_rows: DataFrame) -> DataFrame:
    """Notes as documents, one per company and year, written from the computed figures."""
    year = F.col("fiscal_year")
    amount = F.format_string("%d", F.col("net_income").cast("bigint"))

    def note(statement, line, period, explanation, url):
        return F.struct(F.lit(statement).alias("statement"), F.lit(line).alias("line"),
                        period.alias("period"), explanation.alias("explanation"),
                        url.cast("string").alias("source_url"))

    entries = F.array(
        note("income", "Net Income", year_label(year),
             F.concat(F.lit("Reported net income "), amount),
             F.concat(F.lit("filing/"), F.col("cik"))),
        note("ratios", "Return on Equity", year_label(year), F.lit("On year-end equity"), F.lit(None)),
        note("income", "Revenue", quarter_label(year, F.lit(1)), F.lit("First quarter"), F.lit(None)))
    document = F.to_json(F.struct(F.col("cik").cast("bigint").alias("cik"), entries.alias("notes")))
    return metric_rows.select(document.alias("document"))


def curated(metric_rows: DataFrame) -> DataFrame:
    return notes.parse_notes(note_documents(metric_rows))


def one_time_items(facts: DataFrame) -> DataFrame:
    """A tenth of the income tax first reported two years before a company's newest, as a one-time charge."""
    first_report = ((F.col("concept") == "IncomeTaxExpenseBenefit") & (F.col("form") == "10-K")
                    & (F.col("fiscal_year") == F.year("period_end")))
    newest = F.max("fiscal_year").over(Window.partitionBy("cik"))
    return facts.filter(first_report).withColumn("newest", newest).filter(
        F.col("fiscal_year") == F.col("newest") - 2).select(
        "cik", "fiscal_year", F.floor(F.col("value") * 0.1).cast("double").alias("amount"),
        F.lit("income-tax charge").alias("reason"))


def filed_by(facts: DataFrame, date: str) -> DataFrame:
    return facts.filter(F.col("filed") <= F.lit(date).cast("date"))


def snapshot_at(facts: DataFrame, date: str) -> DataFrame:
    return Workbook(filed_by(facts, date)).cell_snapshot


def revision_history(facts: DataFrame) -> DataFrame:
    """Restatements between each two successive dates, with their sequence."""
    states = [snapshot_at(facts, date) for date in AS_OF]
    parts = [
        revisions.detect_revisions(old, new, date).withColumn("seq", F.lit(seq).cast("bigint"))
        for seq, (old, new, date) in enumerate(zip(states, states[1:], AS_OF[1:]), start=2)]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


# Queries that need more than one expression.

def flatten_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = company_facts.to_documents(base_facts(spark, sf_dir))
    return company_facts.flatten(company_facts.parse_documents(documents))


def typed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = company_facts.to_documents(base_facts(spark, sf_dir))
    return company_facts.facts_from(company_facts.parse_documents(documents))


def ingest_facts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a raw zone as lines, read back from there and loaded as a table."""
    raw = tables.scratch_path(spark, "raw")
    company_facts.to_documents(base_facts(spark, sf_dir)).select("document").write.text(raw)
    documents = company_facts.read_documents(spark, raw, multi_line=False)
    return tables.load_facts(company_facts.facts_from(documents), tables.scratch_path(spark, "facts"))


def load_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base table written afresh from the order tables."""
    return tables.load_facts(derive_facts(spark, sf_dir), tables.scratch_path(spark, "facts"))


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a snapshot store after a refresh on each date."""
    facts = base_facts(spark, sf_dir)
    store = snapshots.SnapshotStore(spark, tables.scratch_path(spark, "store"))
    for date in AS_OF:
        refresh.record_revisions(store, snapshot_at(facts, date), date)
    return store.log().select("cik", "key", "old", "new", "date", "seq")


def annotated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wb = silver_book(spark, sf_dir)
    earlier = snapshot_at(base_facts(spark, sf_dir), AS_OF[2])
    wb = wb.with_inputs(curated=curated(wb.metrics),
                        revised=revisions.detect_revisions(earlier, wb.cell_snapshot, AS_OF[3]))
    return rounded(wb.annotated_cells, "value")


def visible_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wb = silver_book(spark, sf_dir)
    return cells.visible_notes(wb.notable_quarterly, curated(wb.metrics), wb.visible_quarters)


def normalized_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = base_facts(spark, sf_dir)
    wb = Workbook(facts, one_time_items=one_time_items(facts))
    return rounded(wb.normalized_margin, "reported_margin", "normalized_margin")


def narrative_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = base_facts(spark, sf_dir)
    return Workbook(facts, one_time_items=one_time_items(facts),
                    companies=derive_companies(spark, sf_dir)).narrative


def export_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = one_time_items(base_facts(spark, sf_dir))
    wb = silver_book(spark, sf_dir).with_inputs(companies=derive_companies(spark, sf_dir), one_time_items=items)
    return refresh.export_documents(wb)


def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported documents parsed back into rows, with their places inside each section."""
    rows = refresh.read_back(export_payload(spark, sf_dir))
    return rounded(rows, "value")


def _two_drops(spark: SparkSession, sf_dir: str) -> str:
    facts = base_facts(spark, sf_dir)
    landing, root = tables.scratch_path(spark, "landing"), tables.scratch_path(spark, "refresh")
    late = F.col("accn").substr(12, 4).cast("int") >= 2001
    for drop, condition, date in (("a", ~late, AS_OF[2]), ("b", late, AS_OF[3])):
        company_facts.to_documents(facts.filter(condition)).select("document").write.mode(
            "append").text(f"{landing}/drop={drop}")
        incremental.refresh_available(spark, landing, root, date)
    return root


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings arrive in two drops; the stored lines of touched companies follow them."""
    return incremental.current_lines(spark, _two_drops(spark, sf_dir))


def incremental_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarterly lines kept up to date by the same two drops, only for the companies each touches."""
    return incremental.current_quarterly(spark, _two_drops(spark, sf_dir))


def incremental_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restatements that the second drop brings to what the first one published."""
    log = incremental.revision_log(spark, _two_drops(spark, sf_dir))
    return log.select("cik", "key", "old", "new", "date", "seq")


def latest_filed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts table replayed as a stream of files; state keeps the last filed value per key."""
    facts = base_facts(spark, sf_dir)
    landed = tables.scratch_path(spark, "replay")
    # two micro-batches whatever the size; their files grow in number with the table's, so that no task writes a share of it
    files = 2 * max(2, len(facts.inputFiles()))
    facts.repartition(files, "accn").write.parquet(landed)
    return incremental.latest_filed_available(
        spark, landed, tables.scratch_path(spark, "latest"), files_per_batch=files // 2)


def _of(name: str, *ratio_columns: str) -> Query:
    """A workbook relation as a query, with the named columns rounded."""
    return lambda spark, sf_dir: rounded(getattr(book(spark, sf_dir), name), *ratio_columns)


def _statement(name: str) -> Query:
    return lambda spark, sf_dir: book(spark, sf_dir).statement(name)


def _pivot(name: str) -> Query:
    return lambda spark, sf_dir: book(spark, sf_dir).pivot(name)


def _items(name: str) -> Query:
    return lambda spark, sf_dir: rounded(
        getattr(book(spark, sf_dir), name).select(
            "cik", "statement", "line_label", "period_key", "period_label", "rule", "severity",
            "place", "text"), "severity")


QUERIES: dict[str, Query] = {
    # sources
    "flatten_facts": flatten_facts,
    "typed_facts": typed_facts,
    "ingest_facts_batch": ingest_facts_batch,
    "load_facts": load_facts,
    "company_dim": derive_companies,
    "concept_map": lambda s, d: mapping.concept_usage(base_facts(s, d)),
    "curated_notes": lambda s, d: curated(book(s, d).metrics),
    "ingest_summary": lambda s, d: selection.ingest_summary(base_facts(s, d)),
    # selection
    "dedup_facts": lambda s, d: selection.dedup_facts(base_facts(s, d)),
    "annual_facts_by_tag": _of("annual_facts_by_tag"),
    "headline_sample": lambda s, d: selection.headline_sample(base_facts(s, d)),
    # annual
    "annual_facts": _of("annual_facts"),
    "statement_lines": _of("statement_lines"),
    "income_statement": _statement("income"),
    "balance_sheet": _statement("balance"),
    "cash_flow": _statement("cashflow"),
    "metrics": _of("metrics"),
    "balance_check": _of("balance_check"),
    "cash_anchor": _of("cash_anchor"),
    "cash_reconciliation": _of("cash_reconciliation"),
    "ratios": _of("ratios", "gross_margin", "operating_margin", "net_margin", "roe", "current_ratio"),
    "ratios_long": _of("ratios_long", "value"),
    "common_size": _of("common_size", "pct_of_base"),
    "metrics_long": _of("metrics_long"),
    "variance_yoy": _of("variance_yoy", "delta_pct"),
    "headline_series": _of("headline_series", "value"),
    "pivot_income": _pivot("income"),
    "pivot_balance": _pivot("balance"),
    "pivot_cashflow": _pivot("cashflow"),
    # quarterly
    "fy_starts": _of("fy_starts"),
    "flow_cumulative": _of("flow_cumulative"),
    "flow_standalone": _of("flow_standalone"),
    "quarter_spine": _of("quarter_spine"),
    "quarterly_facts": _of("quarterly_facts"),
    "quarterly_statement_lines": _of("quarterly_statement_lines"),
    "quarterly_reconcile": _of("quarterly_reconcile"),
    "visible_quarters": _of("visible_quarters"),
    "partial_years": _of("quarter_years"),
    "quarter_end_cash": _of("quarter_end_cash"),
    # cells
    "annual_cells": _of("annual_cells"),
    "quarterly_cells": _of("quarterly_cells"),
    "statement_line_set": lambda s, d: cells.statement_line_set(book(s, d).statement_lines),
    "base_series": lambda s, d: cells.base_series(book(s, d).quarterly_cells),
    "growth_annual": _of("growth_annual", "growth"),
    "growth_quarterly": _of("growth_quarterly", "growth"),
    "growth_qoq": _of("growth_qoq", "growth"),
    "pct_of_base_annual": _of("pct_of_base_annual", "pct"),
    "pct_of_base_quarterly": _of("pct_of_base_quarterly", "pct"),
    "line_trend": lambda s, d: (lambda wb: rounded(cells.line_trend(
        wb.quarterly_cells, "income", "Gross Profit", wb.visible_quarters),
        "value_billions", digits=9))(book(s, d)),
    "annotated_cells": annotated_cells,
    "visible_notes": visible_notes,
    # notable items
    "peer_baseline": lambda s, d: rounded(
        notable.peer_baseline(book(s, d).quarterly_cells, True), "pct", "peer_mean"),
    "notable_annual": _items("notable_annual"),
    "notable_quarterly": _items("notable_quarterly"),
    # bridges
    "income_bridge_annual": lambda s, d: bridges.income_steps(book(s, d).income_bridge_annual),
    "income_bridge_quarterly": lambda s, d: bridges.income_steps(book(s, d).income_bridge_quarterly),
    "cash_bridge_annual": lambda s, d: bridges.cash_steps(book(s, d).cash_bridge_annual),
    "cash_bridge_quarterly": lambda s, d: bridges.cash_steps(book(s, d).cash_bridge_quarterly),
    "bridge_periods": lambda s, d: silver_book(s, d).bridge_periods,
    # comparator and narrative
    "variance_ab": lambda s, d: rounded(book(s, d).variance_ab(), "pct"),
    "variance_ab_ranked": lambda s, d: rounded(
        comparator.variance_ab_ranked(book(s, d).variance_ab(2000, 1998)), "pct"),
    "largest_mover": lambda s, d: rounded(book(s, d).largest_mover(), "pct", "net_margin"),
    "ratio_kpis": _of("ratio_kpis", "value", "change"),
    "narrative_inputs": _of(
        "narrative_inputs", "revenue_growth", "margin_bps", "net_margin", "liabilities_pct",
        "gross_margin", "first_gross_margin", "roe"),
    "narrative": narrative_texts,
    "normalized_margin": normalized_margin,
    # checks
    "check_balance": _of("check_balance"),
    "check_cash_rollforward": _of("check_cash_rollforward"),
    "check_cash_tieout": _of("check_cash_tieout"),
    "check_net_income": _of("check_net_income"),
    "check_quarterly": _of("check_quarterly"),
    "integrity_summary": lambda s, d: silver_book(s, d).integrity_summary,
    # restatements
    "cell_snapshot": _of("cell_snapshot"),
    "detect_revisions": lambda s, d: (lambda facts: revisions.detect_revisions(
        snapshot_at(facts, AS_OF[2]), Workbook(facts).cell_snapshot, AS_OF[3]))(base_facts(s, d)),
    "latest_revisions": lambda s, d: revisions.latest_revisions(
        revision_history(base_facts(s, d))),
    "revision_log": revision_log,
    # jobs
    "export_payload": export_payload,
    "export_entries": export_entries,
    "incremental_refresh": incremental_refresh,
    "incremental_quarterly": incremental_quarterly,
    "incremental_revisions": incremental_revisions,
    "latest_filed_stream": latest_filed_stream,
}
