"""Null-safe arithmetic used by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspan.settings import Settings

BILLION = 1e9


def known(col: Column) -> Column:
    """NULL for NaN, so that comparisons cannot pass on NaN."""
    return F.when(~F.isnan(col), col)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Real division; NULL when the denominator is zero or missing."""
    return F.try_divide(numerator, denominator)


def relative_change(value: Column, prior: Column) -> Column:
    """Change on the absolute size of the prior value; NULL when prior is zero or missing."""
    return F.try_divide(value - prior, F.abs(prior))


def billions(col: Column, digits: int = 2) -> Column:
    return F.round(col / BILLION, digits)


def within_tolerance(diff: Column, reference: Column, settings: Settings) -> Column:
    """True only when both sides are known and the gap is inside the tolerance."""
    ref = known(reference)
    bound = F.when(ref.isNotNull(), F.greatest(
        F.abs(ref) * settings.tolerance_pct, F.lit(settings.tolerance_abs)))
    return F.coalesce(F.abs(known(diff)) <= bound, F.lit(False))
