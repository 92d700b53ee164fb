"""Notable items: unusual shares of base (rule A) and large year-over-year moves (rule B).

Both rules are computed as columns of the same cells. A window per line gives the peers, so the
rule A exclusion of rule B is a `when`, not an anti join, and no pairs of periods are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.functions.numbers import ratio, relative_change
from ledgerspan.functions.text import deviation_word, percent
from ledgerspan.operators.cells import LINE, PERIOD, with_base
from ledgerspan.settings import BASE_LINE, BASE_WORD, Settings


def _by_statement(values: dict) -> Column:
    chosen = F.lit(None)
    for statement, value in values.items():
        chosen = F.when(F.col("statement") == statement, F.lit(value)).otherwise(chosen)
    return chosen


def _is_own_base() -> Column:
    """Revenue over revenue and assets over assets say nothing."""
    own = [(statement, label) for statement, (home, label) in BASE_LINE.items() if statement == home]
    is_base = F.lit(False)
    for statement, label in own:
        is_base = is_base | ((F.col("statement") == statement) & (F.col("line_label") == label))
    return is_base


def peer_baseline(cells: DataFrame, same_quarter: bool) -> DataFrame:
    """Share of base and the mean share of its peers, the cell itself left out.

    Peers are the line's other years, or for quarters the same quarter of other years.
    """
    line = Window.partitionBy(*LINE)
    peers = Window.partitionBy(*LINE, "qnum") if same_quarter else line
    others = F.count("pct").over(peers) - 1
    rest = F.sum("pct").over(peers) - F.col("pct")
    return (with_base(cells)
            .withColumn("pct", ratio(F.col("value"), F.col("base")))
            .withColumn("n_points", F.count("pct").over(line))
            .withColumn("n_peers", F.when(F.col("pct").isNotNull(), others))
            .withColumn("peer_mean", F.when(F.col("n_peers") > 0, ratio(rest, others)))
            .select(*LINE, *PERIOD, "value", "pct", "n_points", "n_peers", "peer_mean"))


def flag_notable(cells: DataFrame, same_quarter: bool,
                 settings: Settings = Settings()) -> DataFrame:
    """The cells either rule flags, with severity and text."""
    c = F.col
    year_ago = Window.partitionBy(*LINE, "qnum").orderBy("fiscal_year").rangeBetween(-1, -1)
    threshold = _by_statement(settings.deviation_threshold)
    average = F.lit("same-quarter") if same_quarter else F.concat(c("n_peers").cast("string"), F.lit("-year"))
    share_text = F.concat(
        c("line_label"), F.lit(" was "), percent(c("pct")), F.lit(" of "), _by_statement(BASE_WORD),
        F.lit(" in "), c("period_label"), F.lit(", "), deviation_word(c("deviation"), threshold),
        F.lit(" its ~"), percent(c("peer_mean")), F.lit(" "), average, F.lit(" average."))
    move_text = F.concat(
        c("line_label"), F.when(c("growth") >= 0, " rose ").otherwise(" fell "),
        percent(F.abs(c("growth")), 0), F.lit(" YoY in "), c("period_label"), F.lit("."))
    unusual = (c("n_points") >= settings.min_points) & (F.abs(c("deviation")) > threshold)
    moved = F.abs(c("growth")) > settings.move_threshold
    return (peer_baseline(cells, same_quarter)
            .withColumn("deviation", c("pct") - c("peer_mean"))
            .withColumn("growth", relative_change(c("value"), F.first("value").over(year_ago)))
            .filter(~_is_own_base())
            .withColumn("rule", F.when(unusual, "A").when(moved, "B"))
            .filter(c("rule").isNotNull())
            .select(*LINE, *PERIOD, "rule",
                    F.when(c("rule") == "A", F.abs(c("deviation")))
                    .otherwise(F.abs(c("growth")) / 10).alias("severity"),
                    F.when(c("rule") == "A", share_text).otherwise(move_text).alias("text")))


def notable_items(flagged: DataFrame, top: int) -> DataFrame:
    """The most severe items per company and statement.

    Complementary lines tie within float noise, so severity is compared on nine decimals and ties
    go to rule A, then line order, then the earlier period.
    """
    worst = Window.partitionBy("cik", "statement").orderBy(
        F.round("severity", 9).desc(), "rule", "line_order", "period_key")
    return (flagged.withColumn("place", F.row_number().over(worst))
            .filter(F.col("place") <= top))
