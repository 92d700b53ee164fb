"""Statement pivots: a window-aligned shape that does not depend on the data, and calendar columns on request."""

from ledgerspan.operators import annual

ROWS = [
    # company a: five years with a gap (2022 missing), company b: two years
    ("a", 1, "Revenue", year, float(year - 2000) * 1e9) for year in (2025, 2024, 2023, 2021, 2020, 2019)
] + [("a", 2, "Net Income", 2025, 1.234e9), ("b", 1, "Revenue", 2024, 5e8), ("b", 1, "Revenue", 2023, 4e8)]
SCHEMA = "cik string, line_order int, line_label string, fiscal_year int, value double"


def test_window_pivot_has_fixed_columns_and_keeps_gaps(spark):
    wide = annual.pivot_window(spark.createDataFrame(ROWS, SCHEMA), 5)
    assert wide.columns == ["cik", "line_order", "line_label", "fy0", "fy1", "fy2", "fy3", "fy4",
                            "y0", "y1", "y2", "y3", "y4"]
    got = {(r.cik, r.line_order): r for r in wide.collect()}
    a = got[("a", 1)]
    assert [a.fy0, a.fy1, a.fy2, a.fy3, a.fy4] == [2025, 2024, 2023, 2021, 2020]  # 2019 is outside the window
    assert [a.y0, a.y3] == [25.0, 21.0]
    # a line without a value in a year keeps the company's years
    ni = got[("a", 2)]
    assert (ni.fy1, ni.y0, ni.y1) == (2024, 1.23, None)
    b = got[("b", 1)]
    assert [b.fy0, b.fy1, b.fy2, b.y0, b.y1] == [2024, 2023, None, 0.5, 0.4]


def test_window_pivot_plan_has_no_driver_step(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    annual.pivot_window(df, 5)  # building the plan runs no job
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


def test_calendar_pivot(spark):
    wide = annual.pivot_statement(spark.createDataFrame(ROWS, SCHEMA), [2021, 2025])
    assert wide.columns == ["cik", "line_order", "line_label", "fy2021", "fy2025"]
    got = {(r.cik, r.line_order): (r.fy2021, r.fy2025) for r in wide.collect()}
    assert got == {("a", 1): (21.0, 25.0), ("a", 2): (None, 1.23), ("b", 1): (None, None)}
