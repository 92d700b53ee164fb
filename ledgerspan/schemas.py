"""Declared schemas. Nothing is inferred: tag and unit names in filings are data, not columns."""

from pyspark.sql import types as T

DATAPOINT = T.StructType([
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("accn", T.StringType()),
    T.StructField("fy", T.IntegerType()),
    T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("filed", T.StringType()),
    T.StructField("frame", T.StringType()),
])

_UNITS = T.MapType(T.StringType(), T.ArrayType(DATAPOINT))
_CONCEPTS = T.MapType(T.StringType(), T.StructType([T.StructField("units", _UNITS)]))

COMPANY_FACTS = T.StructType([
    T.StructField("cik", T.LongType()),
    T.StructField("entityName", T.StringType()),
    T.StructField("facts", T.MapType(T.StringType(), _CONCEPTS)),
])

FACTS = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("concept", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("fiscal_period", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("filed", T.DateType()),
    T.StructField("frame", T.StringType()),
    T.StructField("accn", T.StringType()),
    T.StructField("duration_days", T.IntegerType()),
])

COMPANY = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("entity_name", T.StringType()),
])

NOTES = T.StructType([
    T.StructField("cik", T.LongType()),
    T.StructField("notes", T.ArrayType(T.StructType([
        T.StructField("statement", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("source_url", T.StringType()),
    ]))),
])

SNAPSHOT = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

REVISIONS = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("old", T.DoubleType()),
    T.StructField("new", T.DoubleType()),
    T.StructField("date", T.StringType()),
])

ONE_TIME_ITEMS = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])
