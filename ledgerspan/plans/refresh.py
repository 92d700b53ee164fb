"""The batch job: facts in, checked marts out.

The layers are tables in the output folder, not cached blocks: a lost executor costs the tasks it
ran, and a mart starts from the silver tables instead of from the facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspan.operators import checks, revisions
from ledgerspan.operators.cells import base_series
from ledgerspan.plans.workbook import Workbook
from ledgerspan.settings import BASE_LABEL, RATIO_FORMATS, RECONCILED_CONCEPTS
from ledgerspan.sources.company_facts import companies_from, facts_from, read_documents
from ledgerspan.sources.notes import read_notes
from ledgerspan.sources.snapshots import SnapshotStore
from ledgerspan.sources.tables import load_facts, scratch_path, stage

SILVER = ("annual_facts", "statement_lines", "flow_standalone", "quarter_spine",
          "quarterly_statement_lines", "cash_anchor")

GOLD = ("metrics", "ratios", "common_size", "variance_yoy", "balance_check", "cash_reconciliation",
        "annual_cells", "quarterly_cells", "growth_annual", "growth_quarterly", "growth_qoq",
        "pct_of_base_annual", "pct_of_base_quarterly", "notable_annual", "notable_quarterly",
        "income_bridge_annual", "income_bridge_quarterly", "cash_bridge_annual",
        "cash_bridge_quarterly", "bridge_periods", "ratios_long", "ratio_kpis", "headline_series",
        "narrative", "quarter_years", "visible_quarters", "annotated_cells", "variance_last_years")


# The parts of an exported document that are read back.
EXPORT = """
  statements array<struct<statement string, frequency string, line string, values map<string, double>,
    derived array<string>, base_label string>>,
  periods array<struct<statement string, frequency string, period_key string, prev_key string, prev_seq_key string>>,
  years array<struct<fiscal_year int>>,
  base_series array<struct<line_label string, period_key string, value double>>,
  ratios array<struct<ratio string, fiscal_year int, label string, value double>>,
  notable_annual array<struct<statement string, line_label string, period_key string, severity double, text string>>,
  notable_quarterly array<struct<statement string, line_label string, period_key string, severity double, text string>>,
  insights array<struct<section string, text string>>,
  meta array<struct<ticker string, entity_name string>>"""


@dataclass(frozen=True)
class RefreshResult:
    run: int
    gold: str
    companies_published: int


def with_silver(wb: Workbook, folder: str) -> Workbook:
    """Write the relations that several marts share, each one from those before it.

    Relations by tag keep only the tags a mart reads: those of the lines and of the checks.
    """
    tags = sorted({*wb.settings.mapped_concepts, wb.settings.spine_concept, *RECONCILED_CONCEPTS})
    stored: dict[str, DataFrame] = {}
    for name in SILVER:
        relation = getattr(wb.override(**stored), name)
        if "concept" in relation.columns:
            relation = relation.filter(F.col("concept").isin(tags))
        stored[name] = stage(relation, f"{folder}/{name}", cluster_by=("cik",))
    return wb.override(**stored)


def record_revisions(store: SnapshotStore, snapshot: DataFrame, run_date: str,
                     passing: DataFrame | None = None, path: str | None = None) -> int:
    """Compare with the stored snapshot, append the restatements, replace the snapshot.

    With `passing` (cik), companies outside it keep their stored values, so a company in quarantine is
    later compared with what was last published. The snapshot is computed once, into a table that
    both steps read: at `path`, or a scratch table.
    """
    spark = store.spark
    previous = store.last_run()
    current = stage(snapshot, path or scratch_path(spark, "snapshot"))
    stored = store.snapshot(previous)
    changed = revisions.detect_revisions(stored, current, run_date)
    if passing is not None:
        kept = stored.join(passing, "cik", "left_anti")
        current = current.unionByName(kept.select(*current.columns))
    store.write_run(previous + 1, current, changed)
    return previous + 1


def run_refresh(facts: DataFrame, root: str, run_date: str, wb_inputs: dict | None = None,
                quarantine: bool = False, marts: tuple[str, ...] = GOLD) -> RefreshResult:
    """Full refresh with the publish gate. `facts` must not read from `root`: the base table there is replaced.

    Gold marts are written last, after the restatement log they show. By default one company that does not reconcile stops the run before anything is published.
    With `quarantine`, the companies that reconcile are published and the others are left out.
    """
    spark = facts.sparkSession
    store = SnapshotStore(spark, f"{root}/store")
    run = store.last_run() + 1
    base = f"{root}/run={run}"
    inputs = dict(wb_inputs or {})
    if inputs.get("companies") is not None:
        # several marts read the names: without a table each would parse the raw documents again
        inputs["companies"] = stage(inputs["companies"], f"{base}/companies")
    wb = Workbook(load_facts(facts, f"{root}/facts"), **inputs)
    wb = with_silver(wb, f"{base}/silver")

    results = stage(wb.all_checks, f"{base}/checks", cluster_by=("cik",))
    gate = checks.company_gate(results)
    if not quarantine:
        checks.require_all_pass(gate)
    passing = stage(gate.filter("passed").select("cik"), f"{base}/published")
    wb = wb.override(**{name: getattr(wb, name).join(passing, "cik", "left_semi")
                        for name in SILVER})

    record_revisions(store, wb.cell_snapshot, run_date, passing, f"{base}/snapshot")
    wb.revised = revisions.latest_revisions(store.log())

    gold = f"{base}/gold"
    for name in marts:
        getattr(wb, name).write.mode("overwrite").parquet(f"{gold}/{name}")
    export_documents(wb).write.mode("overwrite").parquet(f"{gold}/documents")
    return RefreshResult(run, gold, passing.count())


def refresh_from_documents(spark: SparkSession, raw: str, root: str, run_date: str,
                           notes_path: str | None = None, tickers: DataFrame | None = None,
                           one_time_items: DataFrame | None = None, multi_line: bool = True,
                           quarantine: bool = False) -> RefreshResult:
    """The whole job from a raw zone of filing documents. The raw zone is only read."""
    documents = read_documents(spark, raw, multi_line)
    inputs = {"companies": companies_from(documents, tickers), "one_time_items": one_time_items,
              "curated": read_notes(spark, notes_path) if notes_path else None}
    return run_refresh(facts_from(documents), root, run_date, inputs, quarantine)


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _line_rows(cells: DataFrame, frequency: str) -> DataFrame:
    """One JSON object per line with its period -> value map."""
    values = F.map_from_entries(F.sort_array(F.collect_list(F.struct("period_key", "value"))))
    derived = F.sort_array(F.collect_list(F.when(F.col("derived"), F.col("period_key"))))
    if "derived" not in cells.columns:
        derived = F.array().cast("array<string>")
    label = F.element_at(F.create_map(*[F.lit(x) for pair in BASE_LABEL.items() for x in pair]), F.col("statement"))
    return (cells.groupBy("cik", "statement", "line_order", "line_label")
            .agg(values.alias("values"), derived.alias("derived"))
            .withColumn("base_label", label)
            .select("cik", F.lit("statements").alias("section"), F.lit(0.0).alias("rank"),
                    F.format_string("%s|%s|%03d", F.col("statement"), F.lit(frequency),
                                    F.col("line_order")).alias("place"),
                    _json("statement", F.lit(frequency).alias("frequency"),
                          F.col("line_order").alias("order"), F.col("line_label").alias("line"),
                          "values", "derived", "base_label").alias("body")))


def _period_rows(cells: DataFrame, frequency: str) -> DataFrame:
    """The displayed periods of a statement, each with the keys of the periods it is compared with."""
    named = [name for name in ("period_key", "period_label", "fiscal_year", "qnum", "prev_key", "prev_seq_key")
             if name in cells.columns]
    periods = cells.select("cik", "statement", F.lit(frequency).alias("frequency"), *named).distinct()
    return _section(periods, "periods", [
        "statement", "frequency", F.format_string("%05d.%d", F.col("fiscal_year"), F.coalesce("qnum", F.lit(0)))])


def read_back(documents: DataFrame) -> DataFrame:
    """Documents (cik, document) as rows: cik, section, position in the section, field, text, value.

    Each document is parsed once and unfolded by one generator.
    """
    def entries(section, field, text=None, value=None):
        def entry(row, place):
            return _entry(section, place, field(row), text(row) if text else None, value(row) if value else None)
        return F.transform(F.col(f"d.{section}"), entry)

    def joined(*names):
        return lambda row: F.concat_ws("|", *[row[name].cast("string") for name in names])

    def line(row, place):
        return F.transform(F.map_entries(row["values"]), lambda cell: _entry(
            "statements", place, F.concat_ws("|", joined("statement", "frequency", "line")(row), cell["key"]),
            F.concat(row["base_label"], F.when(F.array_contains(row["derived"], cell["key"]), "|derived").otherwise("")),
            cell["value"]))

    item = joined("statement", "line_label", "period_key")
    rows = F.concat(
        F.flatten(F.transform(F.col("d.statements"), line)),
        entries("periods", joined("statement", "frequency", "period_key"), lambda r: F.concat_ws(
            "|", F.coalesce(r["prev_key"], F.lit("-")), F.coalesce(r["prev_seq_key"], F.lit("-")))),
        entries("years", joined("fiscal_year")),
        entries("base_series", joined("line_label", "period_key"), value=lambda r: r["value"]),
        entries("ratios", joined("ratio", "fiscal_year"), lambda r: r["label"], lambda r: r["value"]),
        *[entries(name, item, lambda r: r["text"], lambda r: r["severity"])
          for name in ("notable_annual", "notable_quarterly")],
        entries("insights", joined("section"), lambda r: r["text"]),
        entries("meta", joined("ticker"), lambda r: r["entity_name"]))
    parsed = documents.select("cik", F.from_json("document", EXPORT, {"mode": "FAILFAST"}).alias("d"))
    return parsed.select("cik", F.explode(rows).alias("row")).select("cik", "row.*")


def _entry(section: str, place: Column, field: Column, text: Column | None, value: Column | None) -> Column:
    return F.struct(F.lit(section).alias("section"), place.alias("position"), field.alias("field"),
                    (F.lit(None) if text is None else text).cast("string").alias("text"),
                    (F.lit(None) if value is None else value).cast("double").alias("value"))


def _section(rows: DataFrame, name: str, place: list[str | Column], rank: Column | None = None) -> DataFrame:
    """Each row as a JSON object; `rank`, then the texts in `place` order them within a company's document."""
    fields = [column for column in rows.columns if column != "cik"]
    first = F.lit(0.0) if rank is None else rank
    return rows.select("cik", F.lit(name).alias("section"), first.alias("rank"), F.concat_ws("|", *place).alias("place"),
                       _json(*fields).alias("body"))


def export_documents(wb: Workbook) -> DataFrame:
    """All marts of a company as one nested JSON document: cik, document.

    Sections are stacked and grouped twice, so no mart is joined with another. A document holds
    only mart rows, a few hundred per company whatever the number of filings.
    """
    # nine decimals, as the items are chosen: lines that complement each other tie within float noise
    by_severity = -F.coalesce(F.round("severity", 9), F.lit(0.0))
    items = ["statement", "line_label", "period_key"]
    ratio_order = F.array_position(F.array(*[F.lit(column) for column, _ in RATIO_FORMATS.values()]), F.col("ratio"))
    sections = [
        _line_rows(wb.annual_cells, "annual"),
        _period_rows(wb.annual_cells, "annual"),
        _period_rows(wb.quarterly_cells, "quarterly"),
        _section(wb.metrics.select("cik", "fiscal_year"), "years", ["fiscal_year"]),
        _section(base_series(wb.annual_cells).unionByName(base_series(wb.quarterly_cells)), "base_series",
                 ["line_label", "period_key"]),
        _line_rows(wb.quarterly_cells, "quarterly"),
        _section(wb.metrics, "metrics", ["fiscal_year"]),
        _section(wb.ratios_long.select("cik", "fiscal_year", "ratio", "label", "fmt", "value"),
                 "ratios", [F.format_string("%03d", ratio_order), "fiscal_year"]),
        _section(wb.cash_reconciliation, "cash_recon", ["fiscal_year"]),
        _section(wb.notable_annual.select("cik", "statement", "line_label", "period_key",
                                          "period_label", "severity", "text"),
                 "notable_annual", items, by_severity),
        _section(wb.notable_quarterly.select("cik", "statement", "line_label", "period_key",
                                             "period_label", "severity", "text"),
                 "notable_quarterly", items, by_severity),
        _section(wb.quarter_years, "quarter_years", ["fiscal_year"]),
        _section(wb.income_bridge_annual.unionByName(wb.income_bridge_quarterly)
                 .drop("fiscal_year", "qnum"), "income_bridges", ["period_key"]),
        _section(wb.cash_bridge_annual.unionByName(wb.cash_bridge_quarterly)
                 .drop("fiscal_year", "qnum"), "cash_bridges", ["period_key"]),
        _section(wb.narrative, "insights", ["section"]),
    ]
    if wb.companies is not None:
        sections.append(_section(wb.companies, "meta", ["ticker"]))
    if wb.curated is not None:
        sections.append(_section(wb.curated, "curated", ["key"]))
    if wb.revised is not None:
        sections.append(_section(wb.revised, "revisions", ["key"]))
    stacked = sections[0]
    for section in sections[1:]:
        stacked = stacked.unionByName(section)
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("rank", "place", "body"))),
                         lambda entry: entry["body"])
    part = F.concat(F.lit('"'), F.col("section"), F.lit('":['), F.array_join(bodies, ","), F.lit("]"))
    document = F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("part")), ","),
                        F.lit("}"))
    return (stacked.groupBy("cik", "section").agg(part.alias("part"))
            .groupBy("cik").agg(document.alias("document")))
