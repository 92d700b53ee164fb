"""Snapshots of displayed values and detection of restated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspan.functions.labels import cell_key, year_label
from ledgerspan.settings import Settings


def cell_snapshot(lines: DataFrame) -> DataFrame:
    """cik, key (statement|line|FYyyyy) and value of every annual cell that has one."""
    key = cell_key(F.col("statement"), F.col("line_label"), year_label(F.col("fiscal_year")))
    return lines.filter(F.col("value").isNotNull()).select("cik", key.alias("key"), "value")


def detect_revisions(previous: DataFrame, current: DataFrame, run_date: str,
                     settings: Settings = Settings()) -> DataFrame:
    """Cells present in both snapshots whose value moved by more than noise."""
    old, new = F.col("old"), F.col("new")
    noise = F.greatest(F.lit(settings.restatement_abs), F.abs(old) * settings.restatement_pct)
    before = previous.select("cik", "key", F.col("value").alias("old"))
    now = current.select("cik", "key", F.col("value").alias("new"))
    return (before.join(now, ["cik", "key"]).filter(F.abs(old - new) > noise)
            .select("cik", "key", "old", "new", F.lit(run_date).alias("date")))


def latest_revisions(log: DataFrame) -> DataFrame:
    """The last appended record of each cell, by sequence."""
    last = F.max_by(F.struct("old", "new", "date"), "seq")
    return log.groupBy("cik", "key").agg(last.alias("last")).select("cik", "key", "last.*")
