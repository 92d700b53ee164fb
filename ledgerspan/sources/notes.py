"""Curated notes: documents holding a `notes` array, flattened to one row per note."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspan.functions.labels import cell_key
from ledgerspan.schemas import NOTES
from ledgerspan.sources.company_facts import cik_text


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Read note files; a path that does not exist gives an empty relation."""
    try:
        documents = spark.read.schema(NOTES).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        documents = spark.createDataFrame([], NOTES)
    return flatten_notes(documents)


def parse_notes(texts: DataFrame, column: str = "document") -> DataFrame:
    parsed = F.from_json(column, NOTES, {"mode": "FAILFAST"})
    return flatten_notes(texts.select(parsed.alias("parsed")).select("parsed.*"))


def flatten_notes(documents: DataFrame) -> DataFrame:
    """cik, key (statement|line|period), its three parts, explanation and source_url.

    A key written twice keeps one note per company, chosen by text so that reruns agree.
    """
    rows = (documents.select(cik_text(F.col("cik")).alias("cik"), F.inline("notes"))
            .withColumn("key", cell_key(F.col("statement"), F.col("line"), F.col("period")))
            .withColumn("source_url", F.coalesce("source_url", F.lit(""))))
    chosen = F.max(F.struct("explanation", "source_url"))
    return (rows.groupBy("cik", "key", "statement", "line", "period")
            .agg(chosen.alias("note"))
            .select("cik", "key", "statement", "line", "period", "note.*"))
