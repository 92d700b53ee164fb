"""Financial-statement analytics over filing facts, expressed as Spark DataFrames."""

from ledgerspan.settings import Settings
from ledgerspan.plans.workbook import Workbook

__all__ = ["Settings", "Workbook"]
