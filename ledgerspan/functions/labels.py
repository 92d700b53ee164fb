"""Period keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_key(fiscal_year: Column) -> Column:
    return fiscal_year.cast("string")


def year_label(fiscal_year: Column) -> Column:
    """FY2024"""
    return F.concat(F.lit("FY"), fiscal_year.cast("string"))


def quarter_key(fiscal_year: Column, qnum: Column) -> Column:
    """2024Q3"""
    return F.concat(fiscal_year.cast("string"), F.lit("Q"), qnum.cast("string"))


def quarter_label(fiscal_year: Column, qnum: Column) -> Column:
    """Q3 FY24"""
    return F.concat(F.lit("Q"), qnum.cast("string"), F.lit(" FY"),
                    F.substring(fiscal_year.cast("string"), 3, 2))


def cell_key(statement: Column, line: Column, label: Column) -> Column:
    """income|Revenue|FY2024"""
    return F.concat_ws("|", statement, line, label)
