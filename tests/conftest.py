import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerspan.schemas import FACTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return datetime.date.fromisoformat(text) if text else None


@pytest.fixture
def make_facts(spark):
    """Facts from short dicts; everything not given has a plain annual default."""
    def build(*rows):
        out = []
        for row in rows:
            full = {"cik": "0000000001", "concept": "Assets", "unit": "USD", "start": None,
                    "end": "2020-09-30", "value": 1.0, "fy": 2020, "fp": "FY", "form": "10-K",
                    "filed": "2020-11-01", "accn": "a-1", **row}
            start, end = day(full["start"]), day(full["end"])
            out.append((full["cik"], full["concept"], full["unit"], start, end,
                        None if full["value"] is None else float(full["value"]), full["fy"],
                        full["fp"], full["form"], day(full["filed"]), None, full["accn"],
                        (end - start).days if start and end else None))
        return spark.createDataFrame(out, FACTS)
    return build


def dicts(frame):
    return [row.asDict(recursive=True) for row in frame.collect()]
