"""Times the headline queries to a complete noop write and prints one JSON line.

BENCH_SF_DIR names the input folder and BENCH_CPUS the local cores. Every query runs twice and the
second time counts, plan building included. Base facts are loaded once; `load_facts` times a load.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerspan.plans.catalog import QUERIES  # noqa: E402
from ledgerspan.session import local_session  # noqa: E402

HEADLINE = [
    "load_facts", "typed_facts", "dedup_facts", "annual_facts", "statement_lines", "metrics", "ratios",
    "common_size", "variance_yoy", "cash_reconciliation", "flow_standalone", "quarterly_facts",
    "quarterly_cells", "growth_quarterly", "notable_annual", "notable_quarterly",
    "cash_bridge_quarterly", "bridge_periods", "integrity_summary", "detect_revisions",
    "narrative_inputs", "latest_filed_stream",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        timings[name] = round(seconds(spark, name, sf_dir), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
