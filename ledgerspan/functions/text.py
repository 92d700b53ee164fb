"""Display text for amounts, shares and changes.

`format_number` rounds half to even on the exact binary value, so its digits are those of the
narrative's own number format; the separators are dropped where that format has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspan.functions.numbers import BILLION


def fixed(col: Column, digits: int) -> Column:
    """Plain fixed-point digits, no thousands separators."""
    return F.translate(F.format_number(col, digits), ",", "")


def percent(share: Column, digits: int = 1) -> Column:
    """0.4621 -> 46.2%"""
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def money(amount: Column) -> Column:
    """-1234000000 -> -$1.2B, missing -> n/a"""
    sign = F.when(amount < 0, "-").otherwise("")
    text = F.concat(sign, F.lit("$"), F.format_number(F.abs(amount) / BILLION, 1), F.lit("B"))
    return F.coalesce(text, F.lit("n/a"))


def page_number(col: Column, digits: int) -> Column:
    """Figures of cells and indicators: thousands separators, halves away from zero: 1,234.5 and 0.125 -> 0.13."""
    sign = F.when(col < 0, "-").otherwise("")  # also of what rounds to zero
    return F.concat(sign, F.format_number(F.round(F.abs(col), digits), digits))


def page_percent(share: Column, digits: int = 1) -> Column:
    """12.345 -> 1,234.5%"""
    return F.concat(page_number(share * 100, digits), F.lit("%"))


def page_signed(col: Column, digits: int, suffix: str = "") -> Column:
    """A change in a cell or indicator: +13 pp for 12.5."""
    return F.concat(F.when(col >= 0, "+").otherwise(""), page_number(col, digits), F.lit(suffix))


def deviation_word(deviation: Column, threshold: Column) -> Column:
    """How far a value lies from its average, in words."""
    return (F.when(deviation > threshold * 2, "well above")
            .when(deviation > 0, "above")
            .when(deviation < threshold * -2, "well below")
            .otherwise("below"))
