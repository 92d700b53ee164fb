"""The tag-to-line mapping as a relation, and the pick of the best tag per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspan.settings import Line, Settings

# The mapping comes from settings held on the driver, so its size is known when planning.
BROADCAST_MAX_ROWS = 10_000


def sql_text(value: str) -> str:
    """A string literal for an SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def concept_map(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """statement, line_label, line_order, concept, priority, sign.

    Priority is the position in the candidate list, from 1. The lines are an inline table, so the
    relation is part of the plan and its size is known to the optimizer.
    """
    rows = ", ".join(
        f"({sql_text(line.statement)}, {sql_text(line.label)}, {line.order}, "
        f"array({', '.join(map(sql_text, line.candidates))}))" for line in settings.lines)
    return spark.sql(f"""
        SELECT statement, line_label, line_order, concept, position + 1 AS priority, 1 AS sign
        FROM VALUES {rows} AS lines(statement, line_label, line_order, candidates)
        LATERAL VIEW posexplode(candidates) ranked AS position, concept""")


def concept_usage(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mapping with the number of facts and companies behind each candidate tag."""
    used = (facts.filter(F.col("concept").isin(settings.mapped_concepts))
            .groupBy("concept", "cik").agg(F.count("*").alias("facts"))
            .groupBy("concept").agg(F.sum("facts").alias("n_facts"),
                                    F.count("*").alias("n_companies")))
    mapping = concept_map(facts.sparkSession, settings)
    zero = F.lit(0).cast("bigint")
    return (mapping.join(used, "concept", "left")
            .select(*mapping.columns, F.coalesce("n_facts", zero).alias("n_facts"),
                    F.coalesce("n_companies", zero).alias("n_companies")))


def map_to_lines(values: DataFrame, settings: Settings) -> DataFrame:
    """Join tagged values with the mapping. A tag may feed several lines, so rows fan out.

    The tag filter is written out because it travels below the version selection to the scan.
    """
    mapping = concept_map(values.sparkSession, settings)
    if sum(len(line.candidates) for line in settings.lines) <= BROADCAST_MAX_ROWS:
        mapping = F.broadcast(mapping)
    return (values.filter(F.col("concept").isin(settings.mapped_concepts))
            .join(mapping, "concept")
            .withColumn("value", F.col("sign") * F.col("value")))


def is_line(line: Line) -> str:
    """SQL condition for the rows of one statement line."""
    return f"statement = {sql_text(line.statement)} AND line_label = {sql_text(line.label)}"
