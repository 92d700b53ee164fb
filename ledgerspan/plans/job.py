"""Command line of the batch job: spark-submit ledgerspan/plans/job.py --raw ... --out ..."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession

from ledgerspan.operators.checks import GateFailed
from ledgerspan.plans.refresh import refresh_from_documents
from ledgerspan.schemas import COMPANY, ONE_TIME_ITEMS
from ledgerspan.session import COMMON


def main(arguments: list[str] | None = None) -> int:
    """0 when published, 1 when a reconciliation failed and nothing was."""
    parser = argparse.ArgumentParser(description="Refresh the statement marts from filing documents")
    parser.add_argument("--raw", required=True, help="folder of filing-fact documents (JSON)")
    parser.add_argument("--out", required=True, help="output folder in shared storage")
    parser.add_argument("--run-date", default=datetime.datetime.now(datetime.UTC).date().isoformat())
    parser.add_argument("--notes", help="curated notes (JSON)")
    parser.add_argument("--companies", help="cik, ticker, entity_name (Parquet)")
    parser.add_argument("--one-time-items", help="cik, fiscal_year, amount, reason (Parquet)")
    parser.add_argument("--lines", action="store_true", help="one document per line")
    parser.add_argument("--quarantine", action="store_true",
                        help="publish the companies that reconcile and leave out the others")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ledgerspan-refresh").config(map=COMMON).getOrCreate()

    def table(path, schema):
        return spark.read.schema(schema).parquet(path) if path else None

    try:
        result = refresh_from_documents(
            spark, given.raw, given.out, given.run_date, given.notes,
            table(given.companies, COMPANY), table(given.one_time_items, ONE_TIME_ITEMS),
            multi_line=not given.lines, quarantine=given.quarantine)
    except GateFailed as failed:
        print(f"Nothing published: {failed}", file=sys.stderr)
        return 1
    print(f"Run {result.run}: {result.companies_published} companies in {result.gold}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
