"""Run catalog queries next to their SQL and report differences: python tests/compare.py [names]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    import datetime
    import math
    if isinstance(value, datetime.datetime):
        return value.date().isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def differences(query, sql, spark, con, sf_dir):
    """None when names, types and rows agree, otherwise a short description."""
    frame = query(spark, sf_dir)
    got_names = sorted(frame.columns)
    got = sorted((tuple(normal(row[n]) for n in got_names) for row in frame.collect()), key=repr)
    # as the driver does: the SQL must stand as a view
    con.execute(f"CREATE OR REPLACE VIEW oracle_view AS {sql}")
    relation = con.execute("SELECT * FROM oracle_view")
    names = [d[0] for d in relation.description]
    rows = relation.fetchall()
    if sorted(names) != got_names:
        return f"columns {got_names} != {sorted(names)}"
    order = [names.index(n) for n in got_names]
    want = sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{got_names}: {mine} != {theirs}"
    return None if want else "no rows"


if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[1:] or list(queries):
        begin = time.time()
        try:
            if name in sqls:
                problem = differences(queries[name], sqls[name], spark, con, sf)
            else:
                problem = None if queries[name](spark, sf).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print("failed", failed)
    spark.stop()
