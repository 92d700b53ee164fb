"""All relations of the engine over one facts table, wired lazily.

Reading a property only builds a plan; nothing runs until an action does. `override` swaps a
relation for a stored table, which is how the refresh job cuts the plan at its silver layer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ledgerspan.operators import (
    annual, bridges, cells, checks, comparator, narrative, notable, quarterly, revisions, selection)
from ledgerspan.schemas import NOTES, ONE_TIME_ITEMS, REVISIONS
from ledgerspan.settings import Settings
from ledgerspan.sources.notes import flatten_notes


class Workbook:
    def __init__(self, facts: DataFrame, settings: Settings = Settings(),
                 companies: DataFrame | None = None, curated: DataFrame | None = None,
                 one_time_items: DataFrame | None = None, revised: DataFrame | None = None):
        self.facts = facts
        self.settings = settings
        self.companies = companies
        self.curated = curated
        self.revised = revised
        self._one_time_items = one_time_items
        self._stored: set[str] = set()

    def override(self, **relations: DataFrame) -> "Workbook":
        """The same workbook reading the given relations instead of computing them."""
        copy = Workbook(self.facts, self.settings, self.companies, self.curated,
                        self._one_time_items, self.revised)
        copy._stored = self._stored | set(relations)
        for name, relation in {**{name: self.__dict__[name] for name in self._stored}, **relations}.items():
            if not isinstance(getattr(type(self), name, None), cached_property):
                raise KeyError(name)
            copy.__dict__[name] = relation
        return copy

    def with_inputs(self, **inputs: DataFrame) -> "Workbook":
        """The same workbook with other input tables next to the facts; relations already stored stay.

        Relations that depend on these inputs are built anew, so only stored ones may be kept.
        """
        copy = self.override(**{name: self.__dict__[name] for name in self._stored})
        for name, table in inputs.items():
            setattr(copy, "_one_time_items" if name == "one_time_items" else name, table)
        return copy

    # annual

    @cached_property
    def annual_facts(self) -> DataFrame:
        return annual.annual_facts(self.facts, self.settings)

    @cached_property
    def annual_facts_by_tag(self) -> DataFrame:
        return selection.annual_facts_by_tag(self.facts, self.settings)

    @cached_property
    def statement_lines(self) -> DataFrame:
        return annual.statement_lines(self.annual_facts, self.settings)

    def statement(self, name: str) -> DataFrame:
        return annual.one_statement(self.statement_lines, name)

    @cached_property
    def metrics(self) -> DataFrame:
        return annual.metrics(self.statement_lines)

    @cached_property
    def balance_check(self) -> DataFrame:
        return annual.balance_check(self.metrics)

    @cached_property
    def cash_anchor(self) -> DataFrame:
        return annual.cash_anchor(self.facts, self.settings)

    @cached_property
    def cash_reconciliation(self) -> DataFrame:
        return annual.cash_reconciliation(self.metrics, self.cash_anchor)

    @cached_property
    def ratios(self) -> DataFrame:
        return annual.ratios(self.metrics)

    @cached_property
    def ratios_long(self) -> DataFrame:
        return annual.ratios_long(self.ratios)

    @cached_property
    def common_size(self) -> DataFrame:
        return annual.common_size(self.statement_lines)

    @cached_property
    def metrics_long(self) -> DataFrame:
        return annual.metrics_long(self.metrics)

    @cached_property
    def variance_yoy(self) -> DataFrame:
        return annual.variance_yoy(self.metrics_long)

    @cached_property
    def headline_series(self) -> DataFrame:
        return annual.headline_series(self.metrics)

    def pivot(self, name: str, years: list[int] | None = None) -> DataFrame:
        """Lines by the position of the year in each company's window (y0 newest); with `years`, by those
        calendar years instead (columns fy<year>), for a reader who names them."""
        rows = self.statement(name)
        if years is None:
            return annual.pivot_window(rows, self.settings.years_history)
        return annual.pivot_statement(rows, years)

    # quarterly

    @cached_property
    def fy_starts(self) -> DataFrame:
        return quarterly.fy_starts(self.facts, self.settings)

    @cached_property
    def flow_cumulative(self) -> DataFrame:
        return quarterly.flow_cumulative(self.facts, self.settings)

    @cached_property
    def flow_standalone(self) -> DataFrame:
        return quarterly.flow_standalone(self.flow_cumulative, self.settings)

    @cached_property
    def quarter_spine(self) -> DataFrame:
        return quarterly.quarter_spine(self.flow_standalone, self.statement_lines, self.settings)

    @cached_property
    def quarterly_facts(self) -> DataFrame:
        return quarterly.quarterly_facts(
            self.facts, self.flow_standalone, self.quarter_spine, self.settings)

    @cached_property
    def quarterly_statement_lines(self) -> DataFrame:
        return quarterly.quarterly_statement_lines(self.quarterly_facts, self.settings)

    @cached_property
    def quarterly_reconcile(self) -> DataFrame:
        return quarterly.quarterly_reconcile(self.flow_standalone)

    @cached_property
    def visible_quarters(self) -> DataFrame:
        return quarterly.visible_quarters(self.quarter_spine, self.settings)

    @cached_property
    def quarter_years(self) -> DataFrame:
        return quarterly.quarter_years(self.quarter_spine)

    @cached_property
    def quarter_end_cash(self) -> DataFrame:
        return quarterly.quarter_end_cash(self.facts, self.settings)

    # cells and their views

    @cached_property
    def annual_cells(self) -> DataFrame:
        return cells.annual_cells(self.statement_lines)

    @cached_property
    def quarterly_cells(self) -> DataFrame:
        return cells.quarterly_cells(
            self.quarterly_statement_lines, self.statement_lines, self.quarter_spine, self.settings)

    @cached_property
    def growth_annual(self) -> DataFrame:
        return cells.growth(self.annual_cells)

    @cached_property
    def growth_quarterly(self) -> DataFrame:
        return cells.growth(self.quarterly_cells)

    @cached_property
    def growth_qoq(self) -> DataFrame:
        return cells.growth_qoq(self.quarterly_cells)

    @cached_property
    def pct_of_base_annual(self) -> DataFrame:
        return cells.pct_of_base(self.annual_cells)

    @cached_property
    def pct_of_base_quarterly(self) -> DataFrame:
        return cells.pct_of_base(self.quarterly_cells)

    @cached_property
    def annotated_cells(self) -> DataFrame:
        """Annual, quarterly and ratio cells with their notable, curated and restatement marks."""
        shape = ["cik", "statement", "line_label", "period_key", "period_label", "value"]
        shown = (self.annual_cells.select(*shape)
                 .unionByName(self.quarterly_cells.select(*shape))
                 .unionByName(cells.ratio_cells(self.ratios_long).select(*shape)))
        flagged = self.notable_annual.unionByName(self.notable_quarterly)
        spark = shown.sparkSession
        curated = self.curated
        if curated is None:
            curated = flatten_notes(spark.createDataFrame([], NOTES))
        revised = self.revised
        if revised is None:
            revised = spark.createDataFrame([], REVISIONS)
        return cells.annotate(shown, flagged, curated, revised)

    # notable items

    @cached_property
    def flagged_annual(self) -> DataFrame:
        return notable.flag_notable(self.annual_cells, False, self.settings)

    @cached_property
    def flagged_quarterly(self) -> DataFrame:
        return notable.flag_notable(self.quarterly_cells, True, self.settings)

    @cached_property
    def notable_annual(self) -> DataFrame:
        return notable.notable_items(self.flagged_annual, self.settings.top_annual)

    @cached_property
    def notable_quarterly(self) -> DataFrame:
        return notable.notable_items(self.flagged_quarterly, self.settings.top_quarterly)

    # bridges

    @cached_property
    def income_bridge_annual(self) -> DataFrame:
        return bridges.income_bridge_annual(self.metrics)

    @cached_property
    def income_bridge_quarterly(self) -> DataFrame:
        return bridges.income_bridge_quarterly(self.quarterly_cells)

    @cached_property
    def cash_bridge_annual(self) -> DataFrame:
        return bridges.cash_bridge_annual(self.cash_reconciliation)

    @cached_property
    def cash_bridge_quarterly(self) -> DataFrame:
        return bridges.cash_bridge_quarterly(self.quarterly_cells, self.quarter_end_cash)

    @cached_property
    def bridge_periods(self) -> DataFrame:
        return bridges.bridge_periods({
            ("income", "annual"): self.income_bridge_annual,
            ("income", "quarterly"): self.income_bridge_quarterly,
            ("cash", "annual"): self.cash_bridge_annual,
            ("cash", "quarterly"): self.cash_bridge_quarterly,
        }, self.visible_quarters)

    # comparator and narrative

    def variance_ab(self, base_year: int | None = None, compare_year: int | None = None) -> DataFrame:
        return comparator.variance_ab(self.metrics, base_year, compare_year)

    def largest_mover(self, base_year: int | None = None, compare_year: int | None = None) -> DataFrame:
        return comparator.largest_mover(self.metrics, base_year, compare_year)

    @cached_property
    def variance_last_years(self) -> DataFrame:
        return self.variance_ab()

    @cached_property
    def ratio_kpis(self) -> DataFrame:
        return comparator.ratio_kpis(self.metrics)

    @cached_property
    def narrative_inputs(self) -> DataFrame:
        return narrative.narrative_inputs(self.metrics)

    @cached_property
    def one_time_items(self) -> DataFrame:
        if self._one_time_items is not None:
            return self._one_time_items
        return self.facts.sparkSession.createDataFrame([], ONE_TIME_ITEMS)

    @cached_property
    def normalized_margin(self) -> DataFrame:
        return narrative.normalized_margin(self.metrics, self.one_time_items)

    @cached_property
    def narrative(self) -> DataFrame:
        return narrative.narrative(
            self.narrative_inputs, self.normalized_margin, self.companies, self.settings)

    # checks

    @cached_property
    def check_balance(self) -> DataFrame:
        return checks.check_balance(self.balance_check, self.settings)

    @cached_property
    def check_cash_rollforward(self) -> DataFrame:
        return checks.check_cash_rollforward(self.cash_reconciliation, self.settings)

    @cached_property
    def check_cash_tieout(self) -> DataFrame:
        return checks.check_cash_tieout(self.cash_reconciliation, self.settings)

    @cached_property
    def check_net_income(self) -> DataFrame:
        return checks.check_net_income(self.metrics, self.settings)

    @cached_property
    def check_quarterly(self) -> DataFrame:
        return checks.check_quarterly(self.quarterly_reconcile, self.annual_facts, self.settings)

    @cached_property
    def all_checks(self) -> DataFrame:
        return checks.all_checks(self.check_balance, self.check_cash_rollforward,
                                 self.check_cash_tieout, self.check_net_income, self.check_quarterly)

    @cached_property
    def integrity_summary(self) -> DataFrame:
        return checks.integrity_summary(self.all_checks)

    @cached_property
    def company_gate(self) -> DataFrame:
        return checks.company_gate(self.all_checks)

    # restatements

    @cached_property
    def cell_snapshot(self) -> DataFrame:
        return revisions.cell_snapshot(self.statement_lines)
