"""Statement cells, one row per company, line and period, and the views of a cell.

Annual and quarterly cells share one shape, so growth, share of base, notable items and
annotations are written once: cik, statement, line_order, line_label, fiscal_year, qnum (NULL for
a year), period_end, period_key, period_label, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.labels import quarter_key, year_key, year_label
from ledgerspan.functions.numbers import BILLION, ratio, relative_change
from ledgerspan.operators.mapping import is_line, sql_text
from ledgerspan.settings import BASE_LINE, Settings

LINE = ["cik", "statement", "line_order", "line_label"]
PERIOD = ["fiscal_year", "qnum", "period_end", "period_key", "period_label"]


def annual_cells(lines: DataFrame) -> DataFrame:
    """Cells of the annual block with the key of the year before, where that year is shown.

    The window holds one company's annual lines (lines x years in the window).
    """
    year_before = Window.partitionBy("cik").orderBy("fiscal_year").rangeBetween(-1, -1)
    year = F.col("fiscal_year")
    shown = F.max("fiscal_year").over(year_before)
    return (lines.withColumn("prev_key", year_key(shown))
            .select(*LINE, "fiscal_year", F.lit(None).cast("int").alias("qnum"),
                    F.lit(None).cast("date").alias("period_end"),
                    year_key(year).alias("period_key"), year_label(year).alias("period_label"),
                    "prev_key", F.col("prev_key").alias("prev_seq_key"), "value"))


def statement_line_set(lines: DataFrame) -> DataFrame:
    """The distinct lines a company shows."""
    return lines.select(*LINE).distinct()


def is_derived(statement: Column, qnum: Column) -> Column:
    """A quarter rebuilt by differencing: income in the fourth, cash flow from the second on."""
    return F.coalesce(
        F.when(statement == "income", qnum == 4).when(statement == "cashflow", qnum >= 2),
        F.lit(False))


def quarterly_cells(quarter_lines: DataFrame, annual_lines: DataFrame, spine: DataFrame,
                    settings: Settings = Settings()) -> DataFrame:
    """Dense block: every annual line on every spine quarter, NULL where nothing was filed.

    Values and shown lines are laid out side by side first, one column per line of the settings, so
    the joins move one row per quarter and the grid is unfolded after the last of them. It comes
    out partitioned by company, which is what growth, shares and notable items group by.
    """
    keys = Window.partitionBy("cik").orderBy("period_end")
    quarter = quarter_key(F.col("fiscal_year"), F.col("qnum"))
    year_ago = Window.partitionBy("cik", "qnum").orderBy("fiscal_year").rangeBetween(-1, -1)
    periods = (spine.withColumn("prev_year", F.max("fiscal_year").over(year_ago))
               .select("cik", "period_end", "fiscal_year", "qnum",
                       quarter.alias("period_key"), F.col("label").alias("period_label"),
                       quarter_key(F.col("prev_year"), F.col("qnum")).alias("prev_key"),
                       F.lag(quarter).over(keys).alias("prev_seq_key")))
    numbered = list(enumerate(settings.lines))
    filed = quarter_lines.groupBy("cik", "period_end").agg(*[
        F.expr(f"max(value) FILTER (WHERE {is_line(line)})").alias(f"value_{n}")
        for n, line in numbered])
    shown = annual_lines.groupBy("cik").agg(*[
        F.expr(f"bool_or({is_line(line)})").alias(f"shown_{n}") for n, line in numbered])
    entries = ", ".join(
        f"named_struct('shown', shown_{n}, 'statement', {sql_text(line.statement)}, 'line_order', "
        f"{line.order}, 'line_label', {sql_text(line.label)}, 'value', value_{n})"
        for n, line in numbered)
    return (periods.join(filed, ["cik", "period_end"], "left").join(shown, "cik")
            .select("cik", *PERIOD, "prev_key", "prev_seq_key", F.expr(f"inline(array({entries}))"))
            .filter("shown")
            .select(*LINE, *PERIOD, "prev_key", "prev_seq_key",
                    is_derived(F.col("statement"), F.col("qnum")).alias("derived"), "value"))


def base_series(cells: DataFrame) -> DataFrame:
    """Revenue and total assets per period, the denominators of every share."""
    base = ((F.col("statement") == "income") & (F.col("line_label") == "Revenue")) | (
        (F.col("statement") == "balance") & (F.col("line_label") == "Total Assets"))
    return cells.filter(base).select("cik", "line_label", "period_key", "value")


def _same_period_last_year() -> Window:
    """Calendar comparison: a missing year gives NULL, never an older one."""
    return (Window.partitionBy(*LINE, "qnum").orderBy("fiscal_year").rangeBetween(-1, -1))


def growth(cells: DataFrame) -> DataFrame:
    """Change against the same period of the year before, on the size of the prior value."""
    prior = F.first("value").over(_same_period_last_year())
    return (cells.withColumn("prior_value", prior)
            .withColumn("growth", relative_change(F.col("value"), F.col("prior_value")))
            .select(*LINE, *PERIOD, "value", "prior_value", "growth"))


def growth_qoq(cells: DataFrame) -> DataFrame:
    """Change against the preceding spine quarter. Cells are dense, so lag is that quarter."""
    in_time = Window.partitionBy(*LINE).orderBy("period_end")
    return (cells.withColumn("prior_value", F.lag("value").over(in_time))
            .withColumn("growth", relative_change(F.col("value"), F.col("prior_value")))
            .select(*LINE, *PERIOD, "value", "prior_value", "growth"))


def with_base(cells: DataFrame) -> DataFrame:
    """Adds the base of each cell's statement in the same period.

    The window holds one company's lines of one period.
    """
    period = Window.partitionBy("cik", "period_key")

    def found(line: tuple[str, str]) -> Column:
        here = (F.col("statement") == line[0]) & (F.col("line_label") == line[1])
        return F.max(F.when(here, F.col("value"))).over(period)

    base = F.lit(None).cast("double")
    for statement, line in BASE_LINE.items():
        base = F.when(F.col("statement") == statement, found(line)).otherwise(base)
    return cells.withColumn("base", base)


def pct_of_base(cells: DataFrame) -> DataFrame:
    """Share of revenue (income, cash flow) or of total assets (balance)."""
    return with_base(cells).select(*LINE, *PERIOD, "value", "base",
                                   ratio(F.col("value"), F.col("base")).alias("pct"))


def line_trend(cells: DataFrame, statement: str, line: str,
               visible: DataFrame | None = None) -> DataFrame:
    """One line over its periods in billions, or over the visible quarters; a gap stays NULL."""
    chosen = cells.filter((F.col("statement") == statement) & (F.col("line_label") == line))
    if visible is not None:
        chosen = chosen.join(visible.select("cik", "period_end"), ["cik", "period_end"], "left_semi")
    return chosen.select("cik", "period_end", "period_label",
                         (F.col("value") / BILLION).alias("value_billions"))


def annotate(cells: DataFrame, flagged: DataFrame, curated: DataFrame,
             revised: DataFrame) -> DataFrame:
    """Cells with the notable text, the curated note and the latest restatement of each."""
    items = flagged.select("cik", "statement", "line_label", "period_key",
                           F.col("text").alias("notable_text"))
    notes = curated.select("cik", F.col("key").alias("cell"), "explanation", "source_url")
    changes = revised.select("cik", F.col("key").alias("cell"), F.col("old").alias("revised_old"),
                             F.col("new").alias("revised_new"), F.col("date").alias("revised_on"))
    return (cells.withColumn("cell", F.concat_ws("|", "statement", "line_label", "period_label"))
            .join(items, ["cik", "statement", "line_label", "period_key"], "left")
            .join(notes, ["cik", "cell"], "left")
            .join(changes, ["cik", "cell"], "left")
            .select("cik", "statement", "line_label", "period_key", "period_label", "value",
                    "notable_text", "explanation", "source_url",
                    "revised_old", "revised_new", "revised_on"))


def ratio_cells(ratio_rows_long: DataFrame) -> DataFrame:
    """Ratios in cell shape, so that curated notes reach them as well."""
    year = F.col("fiscal_year")
    return ratio_rows_long.select(
        "cik", F.lit("ratios").alias("statement"), F.col("label").alias("line_label"),
        year_key(year).alias("period_key"), year_label(year).alias("period_label"), "value")


def visible_notes(flagged: DataFrame, curated: DataFrame, visible: DataFrame) -> DataFrame:
    """Detected items and curated notes whose period is in view."""
    shown = visible.select("cik", quarter_key(F.col("fiscal_year"), F.col("qnum")).alias("period_key"),
                           F.col("label").alias("period_label"))
    detected = (flagged.join(shown.select("cik", "period_key"), ["cik", "period_key"], "left_semi")
                .select("cik", "statement", F.lit("detected").alias("kind"), "line_label",
                        "period_label", "text"))
    part = F.split("key", r"\|")
    verified = (curated.select("cik", part[0].alias("statement"), part[1].alias("line_label"),
                               part[2].alias("period_label"), F.col("explanation").alias("text"))
                .join(shown.select("cik", "period_label"), ["cik", "period_label"], "left_semi")
                .select("cik", "statement", F.lit("curated").alias("kind"), "line_label",
                        "period_label", "text"))
    return detected.unionByName(verified)
