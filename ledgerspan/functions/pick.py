"""Version selection as a partially aggregated maximum.

A window would bring every version of a key into one task. `max_by` reduces each map task's rows
to one per key before the shuffle, so a key that holds a third of the table stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_order(missing_date_wins: bool = False, keys: Sequence[str] = ()) -> Column:
    """Total order on versions: last filed, then accession number, then stable tie-breakers.

    A missing filing date loses by default; `missing_date_wins` gives the opposite rule that the
    de-duplication and the quarter-end cash lookup follow. Columns in `keys` are equal within a
    group and left out.
    """
    parts = [name for name in ("filed", "accn", "unit", "period_start", "value") if name not in keys]
    lead = [F.col("filed").isNull().alias("undated")] if missing_date_wins else []
    return F.struct(*lead, *parts)


def latest_filed(facts: DataFrame, keys: list[str], payload: list[str],
                 missing_date_wins: bool = False) -> DataFrame:
    """One row per key: the payload of its last filed version. NULL keys group together.

    Payloads with text plan a sort before the aggregation, on either side of the shuffle; those of plain
    numbers are hashed.
    """
    order = version_order(missing_date_wins, keys)
    if len(payload) == 1:
        return facts.groupBy(*keys).agg(F.max_by(payload[0], order).alias(payload[0]))
    chosen = F.max_by(F.struct(*payload), order)
    return (facts.groupBy(*keys).agg(chosen.alias("chosen"))
            .select(*keys, *[F.col(f"chosen.{name}").alias(name) for name in payload]))
