"""The same questions in SQL, for the side-by-side check on the given tables.

Written separately from the DataFrame code: versions are ranked with windows, prior periods and
peers come from joins, and shares are joined to their base.
"""

from __future__ import annotations

import re

from ledgerspan.settings import (
    BASE_WORD, METRIC_LINES, RATIO_FORMATS, RECONCILED_CONCEPTS, SAMPLE_CONCEPTS, STANDARD_LINES,
    VARIANCE_METRICS)

AS_OF = ["1999-01-01", "2000-01-01", "2001-01-01", "2002-12-31"]

REVENUE_TAG = "RevenueFromContractWithCustomerExcludingAssessedTax"
CASH_TAG = "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"
LEGACY = "(company % 3 = 0 AND fy <= 1997)"
NO_FIRST_TAG = f"({LEGACY} OR (company % 3 = 1 AND fy = 2000))"
CASH = "(all_rev - all_opx - all_dsc - all_tax + 1000000)"

# tag, kind, amount, condition
TAGGED = [
    (REVENUE_TAG, "ytd", "ytd_rev", f"NOT {NO_FIRST_TAG}"),
    ("Revenues", "ytd", "ytd_rev + 1", "company % 3 = 1 AND fy >= 1998"),
    ("SalesRevenueNet", "ytd", "ytd_rev", LEGACY),
    ("CostOfGoodsAndServicesSold", "ytd", "ytd_opx", "true"),
    ("GrossProfit", "ytd", "ytd_rev - ytd_opx", "NOT (company % 7 = 3 AND fy = 1998 AND q = 2)"),
    ("OperatingExpenses", "ytd", "ytd_dsc", "true"),
    ("OperatingIncomeLoss", "ytd", "ytd_rev - ytd_opx - ytd_dsc", "true"),
    (STANDARD_LINES[5].candidates[1], "ytd", "ytd_rev - ytd_opx - ytd_dsc", "true"),
    ("IncomeTaxExpenseBenefit", "ytd", "ytd_tax", "true"),
    ("NetIncomeLoss", "ytd", "ytd_rev - ytd_opx - ytd_dsc - ytd_tax", "true"),
    ("NetCashProvidedByUsedInOperatingActivities", "ytd", "ytd_rev - ytd_opx", "true"),
    ("NetCashProvidedByUsedInInvestingActivities", "ytd", "-ytd_dsc", "true"),
    ("NetCashProvidedByUsedInFinancingActivities", "ytd", "-ytd_tax", "true"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "ytd", "floor(ytd_dsc * 0.5)", "true"),
    ("CashAndCashEquivalentsPeriodIncreaseDecrease", "ytd",
     "ytd_rev - ytd_opx - ytd_dsc - ytd_tax", "true"),
    (REVENUE_TAG, "quarter", "rev", f"q IN (2, 3) AND NOT {NO_FIRST_TAG}"),
    ("NetIncomeLoss", "quarter", "rev - opx - dsc - tax", "q IN (2, 3)"),
    ("Assets", "instant", "all_rev + 5000000 + CASE WHEN company % 25 = 11 AND fy = 1999 "
     "THEN floor(all_rev * 0.25) ELSE 0 END", "true"),
    ("Liabilities", "instant", "floor(all_rev * 0.5) + 2000000", "true"),
    ("StockholdersEquity", "instant", "all_rev - floor(all_rev * 0.5) + 3000000", "true"),
    ("AssetsCurrent", "instant", "floor(all_rev * 0.25) + 2000000", "true"),
    ("LiabilitiesCurrent", "instant", "floor(all_rev * 0.25) + 1000000", "true"),
    (CASH_TAG, "instant", CASH, "true"),
    ("CashAndCashEquivalentsAtCarryingValue", "instant",
     f"{CASH} - 500 * (company % 4) - CASE WHEN company % 25 = 13 "
     "THEN floor(all_rev * 0.05) + 500000 ELSE 0 END", "true"),
]


def _values(rows) -> str:
    def text(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def _newest(source: str, keys: str, where: str = "true", undated: str = "LAST",
            columns: str = "*") -> str:
    return (f"SELECT {columns} FROM {source} WHERE {where} QUALIFY row_number() OVER ("
            f"PARTITION BY {keys} ORDER BY filed DESC NULLS {undated}, accn DESC NULLS LAST, "
            "unit DESC NULLS LAST, period_start DESC NULLS LAST, value DESC NULLS LAST) = 1")


RUNNING = ", ".join(
    [f"sum({n}) OVER (PARTITION BY company ORDER BY fy, q) AS all_{n}"
     for n in ("rev", "dsc", "tax", "opx")]
    + [f"sum({n}) OVER (PARTITION BY company, fy ORDER BY q) AS ytd_{n}"
       for n in ("rev", "dsc", "tax", "opx")])

# name -> SQL, in dependency order
CTE: dict[str, str] = {}

CTE["quarters"] = """
SELECT company, fy, q,
       CAST(sum(rev) AS BIGINT) AS rev, CAST(sum(dsc) AS BIGINT) AS dsc,
       CAST(sum(tax) AS BIGINT) AS tax, CAST(sum(opx) AS BIGINT) AS opx
FROM (SELECT o_custkey // 50 AS company,
             CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fy,
             CAST((month(o_orderdate) + 2) % 12 // 3 + 1 AS INTEGER) AS q,
             floor(l_extendedprice * (1 - l_discount)) AS rev,
             floor(l_extendedprice * l_discount) AS dsc,
             floor(l_extendedprice * l_tax) AS tax,
             floor(l_quantity * 300) AS opx
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) lines
GROUP BY company, fy, q"""
CTE["running"] = f"SELECT *, {RUNNING} FROM quarters"
CTE["tagged"] = " UNION ALL ".join(
    f"SELECT company, fy, q, '{tag}' AS concept, '{kind}' AS kind, "
    f"CAST({amount} AS BIGINT) AS amount FROM running WHERE {condition}"
    for tag, kind, amount, condition in TAGGED)
CTE["facts"] = """
SELECT cik, concept, 'USD' AS unit, period_start, period_end,
       CAST(CASE WHEN company % 5 = 0 AND refiled = 1 AND concept = 'OperatingIncomeLoss'
                 THEN amount + floor(amount * 0.02) ELSE amount END AS DOUBLE) AS value,
       CAST(fy + refiled AS INTEGER) AS fiscal_year,
       CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END AS fiscal_period,
       CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form,
       period_end + CAST(40 + 365 * refiled AS INTEGER) AS filed,
       CAST(NULL AS VARCHAR) AS frame,
       cik || '-' || (fy + refiled) || '-Q' || q AS accn,
       CAST(date_diff('day', period_start, period_end) AS INTEGER) AS duration_days
FROM (SELECT t.*, v.refiled, lpad(CAST(company AS VARCHAR), 10, '0') AS cik,
             CAST(make_date(fy - 1, 10, 1) + to_months(3 * q) - INTERVAL 1 DAY AS DATE) AS period_end,
             CASE kind WHEN 'ytd' THEN make_date(fy - 1, 10, 1)
                       WHEN 'quarter' THEN CAST(make_date(fy - 1, 10, 1) + to_months(3 * (q - 1)) AS DATE)
             END AS period_start
      FROM tagged t JOIN (VALUES (0), (1)) v(refiled) ON v.refiled = 0 OR t.fy < 2001) filed_rows"""
CTE["mapping"] = ("SELECT * FROM (VALUES " + _values(
    (line.statement, line.label, line.order, tag, place)
    for line in STANDARD_LINES for place, tag in enumerate(line.candidates, start=1))
    + ") m(statement, line_label, line_order, concept, priority)")


def _annual_chain(suffix: str, source: str) -> dict[str, str]:
    """Annual facts and lines over any version of the facts, named with a suffix."""
    return {
        f"annual{suffix}": f"""
SELECT n.cik, n.concept, CAST(year(n.period_end) AS INTEGER) AS fiscal_year, n.period_end, n.value
FROM ({_newest(source, "cik, concept, period_end",
               "form = '10-K' AND fiscal_period = 'FY' AND coalesce(duration_days, 350) >= 350")}) n
JOIN (SELECT cik, max(year(period_end)) AS newest FROM {source}
      WHERE form = '10-K' AND fiscal_period = 'FY' GROUP BY cik) y ON y.cik = n.cik
WHERE year(n.period_end) > y.newest - 5""",
        f"lines{suffix}": f"""
SELECT cik, statement, line_label, CAST(line_order AS INTEGER) AS line_order, fiscal_year, value
FROM annual{suffix} JOIN mapping USING (concept)
QUALIFY row_number() OVER (PARTITION BY cik, statement, line_label, fiscal_year
                           ORDER BY priority, period_end DESC) = 1""",
        f"snapshot{suffix}": f"""
SELECT cik, statement || '|' || line_label || '|FY' || fiscal_year AS key, value
FROM lines{suffix} WHERE value IS NOT NULL""",
    }


CTE.update(_annual_chain("", "facts"))
for place, date in enumerate(AS_OF, start=1):
    CTE[f"facts_{place}"] = f"SELECT * FROM facts WHERE filed <= DATE '{date}'"
    CTE.update(_annual_chain(f"_{place}", f"facts_{place}"))
for place, date in enumerate(AS_OF[1:], start=2):
    CTE[f"restated_{place}"] = f"""
SELECT n.cik, n.key, o.value AS old, n.value AS new, '{date}' AS date, CAST({place} AS BIGINT) AS seq
FROM snapshot_{place} n JOIN snapshot_{place - 1} o ON o.cik = n.cik AND o.key = n.key
WHERE abs(o.value - n.value) > greatest(1000.0, abs(o.value) * 0.0005)"""
CTE["history"] = " UNION ALL ".join(f"SELECT * FROM restated_{p}" for p in (2, 3, 4))

CTE["metric_rows"] = "SELECT cik, fiscal_year, " + ", ".join(
    f"max(value) FILTER (statement = '{statement}' AND line_label = '{label}') AS {name}"
    for name, (statement, label) in METRIC_LINES.items()) + " FROM lines GROUP BY cik, fiscal_year"
CTE["ratio_rows"] = """
SELECT *, gross_profit / nullif(revenue, 0) AS gross_margin,
       operating_income / nullif(revenue, 0) AS operating_margin,
       net_income / nullif(revenue, 0) AS net_margin,
       net_income / nullif(total_equity, 0) AS roe,
       current_assets / nullif(current_liabilities, 0) AS current_ratio,
       operating_cf - capex AS free_cash_flow
FROM metric_rows"""
CTE["anchors"] = f"""
SELECT cik, CAST(year(period_end) AS INTEGER) AS fiscal_year, period_end, value AS ending_cash
FROM ({_newest("facts", "cik, period_end", f"concept = '{CASH_TAG}' AND form = '10-K' AND period_start IS NULL")})"""
CTE["yearly_anchor"] = """
SELECT cik, fiscal_year, ending_cash FROM anchors
QUALIFY row_number() OVER (PARTITION BY cik, fiscal_year ORDER BY period_end DESC) = 1"""
CTE["recon"] = """
SELECT m.cik, m.fiscal_year, p.ending_cash AS beginning_cash, m.operating_cf, m.investing_cf,
       m.financing_cf, m.operating_cf + m.investing_cf + m.financing_cf AS net_change,
       p.ending_cash + m.operating_cf + m.investing_cf + m.financing_cf AS computed_ending_cash,
       c.ending_cash AS reported_ending_cash, m.cash AS balance_sheet_cash,
       c.ending_cash - m.cash AS restricted_cash_residual, m.total_assets
FROM metric_rows m
JOIN yearly_anchor c ON c.cik = m.cik AND c.fiscal_year = m.fiscal_year
LEFT JOIN yearly_anchor p ON p.cik = m.cik AND p.fiscal_year = m.fiscal_year - 1"""
CTE["long_metrics"] = " UNION ALL ".join(
    f"SELECT cik, fiscal_year, '{label}' AS metric, {name} AS value FROM metric_rows"
    for label, name in VARIANCE_METRICS.items())

# quarterly
CTE["starts"] = """
SELECT DISTINCT cik, period_start FROM facts
WHERE period_start IS NOT NULL AND form IN ('10-Q', '10-K') AND duration_days >= 170"""
CTE["cumulative"] = "SELECT cik, concept, period_start, period_end, value FROM (" + _newest(
    "facts f", "f.cik, f.concept, f.period_start, f.period_end",
    "form IN ('10-Q', '10-K') AND duration_days >= 80 AND duration_days <= 380 AND EXISTS ("
    "SELECT 1 FROM starts s WHERE s.cik = f.cik AND s.period_start = f.period_start)") + ")"
CTE["standalone"] = """
SELECT c.cik, c.concept, c.period_start, c.period_end,
       c.value - coalesce(lag(c.value) OVER w, 0) AS value,
       CAST(row_number() OVER w AS INTEGER) AS qnum,
       CAST(year(c.period_start) + 1 AS INTEGER) AS fiscal_year,
       CAST(round(date_diff('day', c.period_start, c.period_end) / 91.3) AS INTEGER) AS duration_q
FROM cumulative c
WINDOW w AS (PARTITION BY c.cik, c.concept, c.period_start ORDER BY c.period_end)"""
CTE["spine"] = """
SELECT cik, period_end, fiscal_year, qnum,
       'Q' || qnum || ' FY' || right(CAST(fiscal_year AS VARCHAR), 2) AS label,
       fiscal_year || 'Q' || qnum AS period_key
FROM standalone JOIN (SELECT cik, min(fiscal_year) AS first_year FROM lines GROUP BY cik) USING (cik)
WHERE concept = 'NetIncomeLoss' AND fiscal_year >= first_year
QUALIFY row_number() OVER (PARTITION BY cik, period_end ORDER BY fiscal_year DESC, qnum DESC) = 1"""
CTE["quarter_facts"] = f"""
SELECT s.cik, s.concept, s.period_end, s.value FROM standalone s
JOIN spine p ON p.cik = s.cik AND p.period_end = s.period_end
UNION ALL
SELECT i.cik, i.concept, i.period_end, i.value
FROM ({_newest("facts", "cik, concept, period_end", "period_start IS NULL AND form IN ('10-Q', '10-K')")}) i
JOIN spine p ON p.cik = i.cik AND p.period_end = i.period_end"""
CTE["quarter_lines"] = """
SELECT cik, statement, line_label, CAST(line_order AS INTEGER) AS line_order, period_end, value
FROM quarter_facts JOIN mapping USING (concept)
QUALIFY row_number() OVER (PARTITION BY cik, statement, line_label, period_end
                           ORDER BY priority, value DESC) = 1"""
CTE["quarter_sums"] = """
SELECT cik, concept, fiscal_year, count(*) AS n_quarters, sum(value) AS sum_quarters
FROM standalone GROUP BY cik, concept, fiscal_year"""
CTE["shown_quarters"] = """
SELECT * FROM spine
QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) <= 12"""
CTE["end_cash"] = "SELECT cik, period_end, value AS ending_cash FROM (" + _newest(
    "facts", "cik, period_end", f"concept = '{CASH_TAG}' AND period_start IS NULL", "FIRST") + ")"

# cells
CTE["year_cells"] = """
SELECT l.cik, l.statement, l.line_order, l.line_label, l.fiscal_year, CAST(NULL AS INTEGER) AS qnum,
       CAST(NULL AS DATE) AS period_end, CAST(l.fiscal_year AS VARCHAR) AS period_key,
       'FY' || l.fiscal_year AS period_label, CAST(b.fiscal_year AS VARCHAR) AS prev_key, l.value
FROM lines l LEFT JOIN (SELECT DISTINCT cik, fiscal_year FROM lines) b
  ON b.cik = l.cik AND b.fiscal_year = l.fiscal_year - 1"""
CTE["quarter_cells"] = """
SELECT l.cik, l.statement, l.line_order, l.line_label, p.fiscal_year, p.qnum, p.period_end,
       p.period_key, p.label AS period_label, b.period_key AS prev_key,
       p.prev_seq_key,
       (l.statement = 'income' AND p.qnum = 4) OR (l.statement = 'cashflow' AND p.qnum >= 2) AS derived,
       q.value
FROM (SELECT DISTINCT cik, statement, line_order, line_label FROM lines) l
JOIN (SELECT *, lag(period_key) OVER (PARTITION BY cik ORDER BY period_end) AS prev_seq_key
      FROM spine) p ON p.cik = l.cik
LEFT JOIN spine b ON b.cik = p.cik AND b.fiscal_year = p.fiscal_year - 1 AND b.qnum = p.qnum
LEFT JOIN quarter_lines q ON q.cik = l.cik AND q.statement = l.statement
  AND q.line_label = l.line_label AND q.period_end = p.period_end"""


def _growth(cells: str, prev: str) -> str:
    return f"""
SELECT c.cik, c.statement, c.line_order, c.line_label, c.fiscal_year, c.qnum, c.period_end,
       c.period_key, c.period_label, c.value, p.value AS prior_value,
       (c.value - p.value) / nullif(abs(p.value), 0) AS growth
FROM {cells} c LEFT JOIN {cells} p ON p.cik = c.cik AND p.statement = c.statement
  AND p.line_label = c.line_label AND p.period_key = c.{prev}"""


def _share(cells: str) -> str:
    return f"""
SELECT c.cik, c.statement, c.line_order, c.line_label, c.fiscal_year, c.qnum, c.period_end,
       c.period_key, c.period_label, c.value, b.value AS base, c.value / nullif(b.value, 0) AS pct
FROM {cells} c LEFT JOIN {cells} b ON b.cik = c.cik AND b.period_key = c.period_key
  AND b.statement = CASE WHEN c.statement = 'balance' THEN 'balance' ELSE 'income' END
  AND b.line_label = CASE WHEN c.statement = 'balance' THEN 'Total Assets' ELSE 'Revenue' END"""


def _baseline(shares: str, same_quarter: bool) -> str:
    peer = " AND p.qnum = s.qnum" if same_quarter else ""
    return f"""
SELECT s.cik, s.statement, s.line_order, s.line_label, s.fiscal_year, s.qnum, s.period_end,
       s.period_key, s.period_label, s.value, s.pct, max(n.n_points) AS n_points,
       CASE WHEN s.pct IS NOT NULL THEN count(p.pct) END AS n_peers,
       CASE WHEN s.pct IS NOT NULL THEN avg(p.pct) END AS peer_mean
FROM {shares} s
JOIN (SELECT cik, statement, line_label, count(pct) AS n_points FROM {shares}
      GROUP BY cik, statement, line_label) n
  ON n.cik = s.cik AND n.statement = s.statement AND n.line_label = s.line_label
LEFT JOIN {shares} p ON p.cik = s.cik AND p.statement = s.statement
  AND p.line_label = s.line_label AND p.period_key <> s.period_key{peer}
GROUP BY s.cik, s.statement, s.line_order, s.line_label, s.fiscal_year, s.qnum, s.period_end,
         s.period_key, s.period_label, s.value, s.pct"""


def _flagged(baseline: str, changes: str, average: str, top: int) -> str:
    word = "CASE b.statement " + " ".join(
        f"WHEN '{s}' THEN '{w}'" for s, w in BASE_WORD.items()) + " END"
    return f"""
SELECT cik, statement, line_label, period_key, period_label, rule, severity,
       CAST(row_number() OVER (PARTITION BY cik, statement
            ORDER BY round(severity, 9) DESC, rule, line_order, period_key) AS INTEGER) AS place, text
FROM (
  SELECT *, CASE WHEN rule = 'A' THEN abs(dev) ELSE abs(growth) / 10 END AS severity,
         CASE WHEN rule = 'A' THEN
           line_label || ' was ' || format('{{:.1f}}', pct * 100) || '% of ' || base_word || ' in '
           || period_label || ', ' || CASE WHEN dev > 2 * thr THEN 'well above' WHEN dev > 0 THEN 'above'
             WHEN dev < -2 * thr THEN 'well below' ELSE 'below' END
           || ' its ~' || format('{{:.1f}}', peer_mean * 100) || '% ' || {average} || ' average.'
         ELSE line_label || CASE WHEN growth >= 0 THEN ' rose ' ELSE ' fell ' END
           || format('{{:.0f}}', abs(growth) * 100) || '% YoY in ' || period_label || '.' END AS text
  FROM (
    SELECT b.*, g.growth, b.pct - b.peer_mean AS dev, {word} AS base_word,
           CASE WHEN b.statement = 'balance' THEN 0.020 ELSE 0.015 END AS thr,
           CASE WHEN b.n_points >= 3 AND abs(b.pct - b.peer_mean)
                  > CASE WHEN b.statement = 'balance' THEN 0.020 ELSE 0.015 END THEN 'A'
                WHEN abs(g.growth) > 0.30 THEN 'B' END AS rule
    FROM {baseline} b JOIN {changes} g ON g.cik = b.cik AND g.statement = b.statement
      AND g.line_label = b.line_label AND g.period_key = b.period_key
    WHERE NOT (b.statement = 'income' AND b.line_label = 'Revenue')
      AND NOT (b.statement = 'balance' AND b.line_label = 'Total Assets'))
  WHERE rule IS NOT NULL)
QUALIFY place <= {top}"""


CTE["year_growth"] = _growth("year_cells", "prev_key")
CTE["quarter_growth"] = _growth("quarter_cells", "prev_key")
CTE["year_share"] = _share("year_cells")
CTE["quarter_share"] = _share("quarter_cells")
CTE["year_baseline"] = _baseline("year_share", False)
CTE["quarter_baseline"] = _baseline("quarter_share", True)
CTE["year_items"] = _flagged("year_baseline", "year_growth", "(n_peers || '-year')", 5)
CTE["quarter_items"] = _flagged("quarter_baseline", "quarter_growth", "'same-quarter'", 10)
CTE["notes"] = """
SELECT cik, statement || '|' || line || '|' || period AS key, statement, line, period, explanation, source_url
FROM (SELECT cik, 'income' AS statement, 'Net Income' AS line, 'FY' || fiscal_year AS period,
             'Reported net income ' || CAST(CAST(net_income AS BIGINT) AS VARCHAR) AS explanation,
             'filing/' || cik AS source_url FROM metric_rows
      UNION ALL SELECT cik, 'ratios', 'Return on Equity', 'FY' || fiscal_year, 'On year-end equity', ''
      FROM metric_rows
      UNION ALL SELECT cik, 'income', 'Revenue', 'Q1 FY' || right(CAST(fiscal_year AS VARCHAR), 2),
             'First quarter', '' FROM metric_rows)"""

# bridges
CTE["income_year"] = """
SELECT cik, fiscal_year, CAST(NULL AS INTEGER) AS qnum, CAST(fiscal_year AS VARCHAR) AS period_key,
       'FY' || fiscal_year AS period_label, revenue AS rev, cogs, gross_profit AS gp,
       gross_profit - operating_income AS opex, operating_income AS oi, net_income AS ni
FROM metric_rows"""
CTE["income_quarter"] = """
SELECT r.cik, r.fiscal_year, r.qnum, r.period_key, r.period_label, r.value AS rev, c.value AS cogs,
       g.value AS gp, g.value - o.value AS opex, o.value AS oi, n.value AS ni
FROM (SELECT * FROM quarter_cells WHERE statement = 'income' AND line_label = 'Revenue') r """ + " ".join(
    f"JOIN (SELECT * FROM quarter_cells WHERE statement = 'income' AND line_label = '{label}' "
    f"AND value IS NOT NULL) {a} ON {a}.cik = r.cik AND {a}.period_key = r.period_key"
    for a, label in (("c", "Cost of Revenue"), ("g", "Gross Profit"), ("o", "Operating Income"),
                     ("n", "Net Income"))) + " WHERE r.value IS NOT NULL"
CTE["cash_year"] = """
SELECT cik, fiscal_year, CAST(NULL AS INTEGER) AS qnum, CAST(fiscal_year AS VARCHAR) AS period_key,
       'FY' || fiscal_year AS period_label, beginning_cash AS beg, operating_cf AS cfo,
       investing_cf AS cfi, financing_cf AS cff, reported_ending_cash AS ending
FROM recon"""
CTE["cash_quarter"] = """
SELECT o.cik, o.fiscal_year, o.qnum, o.period_key, o.period_label,
       e.ending_cash - (o.value + i.value + f.value) AS beg, o.value AS cfo, i.value AS cfi,
       f.value AS cff, e.ending_cash AS ending
FROM quarter_cells o
JOIN quarter_cells i ON i.cik = o.cik AND i.period_key = o.period_key AND i.line_label = 'Investing Cash Flow'
JOIN quarter_cells f ON f.cik = o.cik AND f.period_key = o.period_key AND f.line_label = 'Financing Cash Flow'
JOIN end_cash e ON e.cik = o.cik AND e.period_end = o.period_end
WHERE o.line_label = 'Operating Cash Flow' AND o.value + i.value + f.value + e.ending_cash IS NOT NULL"""


def _steps(source: str, steps: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT cik, fiscal_year, qnum, period_key, period_label, CAST({place} AS INTEGER) AS step_order, "
        f"'{step}' AS step, '{measure}' AS measure, {amount} AS amount FROM {source}"
        for place, (step, measure, amount) in enumerate(steps, start=1))


INCOME_STEPS = [
    ("Revenue", "absolute", "rev"), ("Cost of Revenue", "relative", "-cogs"),
    ("Gross Profit", "total", "gp"), ("Operating Exp.", "relative", "-opex"),
    ("Operating Income", "total", "oi"), ("Taxes & Other", "relative", "ni - oi"),
    ("Net Income", "total", "ni")]
CASH_STEPS = [
    ("Beginning", "absolute", "beg"), ("Operating", "relative", "cfo"),
    ("Investing", "relative", "cfi"), ("Financing", "relative", "cff"), ("Ending", "total", "ending")]

# comparator
CTE["ranked_years"] = """
SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fiscal_year DESC) AS place FROM ratio_rows"""
COMPARED = {**VARIANCE_METRICS, "Free Cash Flow": "free_cash_flow"}


def _compared(condition: str) -> str:
    return " UNION ALL ".join(
        f"SELECT a.cik, a.fiscal_year AS base_year, b.fiscal_year AS compare_year, "
        f"CAST({place} AS INTEGER) AS metric_order, '{label}' AS metric, a.{name} AS base_value, "
        f"b.{name} AS compare_value, a.{name} - b.{name} AS delta, "
        f"(a.{name} - b.{name}) / nullif(abs(b.{name}), 0) AS pct "
        f"FROM ranked_years a JOIN ranked_years b ON b.cik = a.cik WHERE {condition}"
        for place, (label, name) in enumerate(COMPARED.items(), start=1))


CTE["compared"] = _compared("a.place = 1 AND b.place = 2")
CTE["compared_fixed"] = _compared("a.fiscal_year = 2000 AND b.fiscal_year = 1998")

# checks
WITHIN = "coalesce(abs({d}) <= CASE WHEN {r} IS NOT NULL THEN greatest(0.005 * abs({r}), 1000) END, false)"


def _check(name: str, item: str, diff: str, reference: str, source: str, passed: str = "",
           skipped: str = "false", note: str = "''") -> str:
    ok = passed or WITHIN.format(d=f"({diff})", r=f"({reference})")
    return (f"SELECT cik, '{name}' AS check_name, {item} AS item, fiscal_year, {diff} AS diff, "
            f"{reference} AS reference, CASE WHEN {skipped} THEN 'skipped' WHEN {ok} THEN 'pass' "
            f"ELSE 'fail' END AS status, {note} AS note FROM {source}")


CTE["c_balance"] = _check(
    "balance_identity", "'Total Assets'", "total_assets - total_liabilities - total_equity",
    "total_assets", "metric_rows")
CTE["c_roll"] = _check(
    "cash_rollforward", "'Ending Cash'", "computed_ending_cash - reported_ending_cash",
    "reported_ending_cash", "recon", skipped="beginning_cash IS NULL")
CTE["c_tie"] = _check(
    "cash_tieout", "'Cash & Equivalents'", "restricted_cash_residual", "total_assets", "recon",
    passed="restricted_cash_residual >= -1000 AND restricted_cash_residual <= 0.02 * total_assets",
    note="CASE WHEN abs(restricted_cash_residual) <= 1000 THEN 'exact' ELSE 'restricted cash' END")
CTE["c_net"] = _check("net_income_linkage", "'Net Income'", "net_income - net_income_cf",
                      "net_income", "metric_rows")
CTE["quarter_totals"] = """
SELECT s.cik, s.concept, s.fiscal_year, s.sum_quarters,
       (SELECT arg_max(a.value, a.period_end) FROM annual a
        WHERE a.cik = s.cik AND a.concept = s.concept AND a.fiscal_year = s.fiscal_year) AS annual
FROM quarter_sums s WHERE s.n_quarters = 4 AND s.concept IN (""" + ", ".join(
    f"'{tag}'" for tag in RECONCILED_CONCEPTS) + ")"
CTE["c_quarters"] = _check(
    "quarterly_sum", "CASE concept " + " ".join(
        f"WHEN '{tag}' THEN '{label}'" for tag, label in RECONCILED_CONCEPTS.items()) + " END",
    "sum_quarters - annual", "annual", "quarter_totals", skipped="annual IS NULL")
CTE["verdicts"] = " UNION ALL ".join(
    f"SELECT * FROM {c}" for c in ("c_balance", "c_roll", "c_tie", "c_net", "c_quarters"))

MATERIALIZED = {"running", "facts", "lines", "standalone", "spine", "quarter_cells", "quarter_share",
                "year_share"}


def _needed(final: str) -> list[str]:
    """The relations a statement reads, directly or through others, in dependency order."""
    words = set(re.findall(r"[a-z_0-9]+", final))
    chosen: list[str] = []
    for name in reversed(CTE):
        if name in words:
            chosen.append(name)
            words |= set(re.findall(r"[a-z_0-9]+", CTE[name]))
    return chosen[::-1]


def _statement(final: str) -> str:
    ctes = ", ".join(
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({CTE[name]})"
        for name in _needed(final))
    return f"WITH {ctes} {final}" if ctes else final


SIX = "gross_margin, operating_margin, net_margin, roe, current_ratio"
R6 = ", ".join(f"round({name}, 6) AS {name}" for name in SIX.split(", "))
CELL = ("cik, statement, line_order, line_label, fiscal_year, qnum, period_end, period_key, "
        "period_label")
FACT_COLUMNS = ("cik, concept, unit, period_start, period_end, value, fiscal_year, fiscal_period, "
                "form, filed, frame, accn, duration_days")
BY_TAG = """(SELECT * FROM {source} WHERE form = '10-K' AND fiscal_period = 'FY'
  AND coalesce(duration_days, 350) >= 350
  QUALIFY dense_rank() OVER (PARTITION BY cik ORDER BY fiscal_year DESC) <= 5)"""
DEDUP = _newest("facts", "cik, concept, unit, period_start, period_end", undated="FIRST")


def _one_statement(name: str) -> str:
    return (f"SELECT cik, line_order, line_label, fiscal_year, value FROM lines "
            f"WHERE statement = '{name}'")


def _pivot(name: str, width: int = 5) -> str:
    placed = ("SELECT cik, line_order, line_label, fiscal_year, value, "
              "dense_rank() OVER (PARTITION BY cik ORDER BY fiscal_year DESC) - 1 AS pos "
              f"FROM lines WHERE statement = '{name}'")
    years = ", ".join(f"CAST(max(fiscal_year) FILTER (WHERE pos = {k}) AS INTEGER) AS fy{k}" for k in range(width))
    values = ", ".join(f"round(max(value) FILTER (WHERE pos = {k}) / 1e9, 2) + 0.0 AS y{k}" for k in range(width))
    return (f"SELECT w.cik, line_order, line_label, {', '.join(f'fy{k}' for k in range(width))}, "
            f"{', '.join(f'y{k}' for k in range(width))} "
            f"FROM (SELECT cik, line_order, line_label, {values} FROM ({placed}) WHERE pos < {width} "
            "GROUP BY cik, line_order, line_label) w "
            f"JOIN (SELECT cik, {years} FROM ({placed}) WHERE pos < {width} GROUP BY cik) y ON y.cik = w.cik")


def _growth_out(source: str) -> str:
    return f"SELECT {CELL}, value, prior_value, round(growth, 6) AS growth FROM {source}"


SERIES = {**{name: f"{name} / 1e9" for name in (
    "revenue", "net_income", "total_assets", "total_liabilities", "total_equity", "cash",
    "operating_cf", "capex", "investing_cf", "financing_cf", "free_cash_flow")},
    **{name: f"{name} * 100" for name in ("gross_margin", "operating_margin", "net_margin", "roe")},
    "current_ratio": "current_ratio"}


def _change_text(value: str, digits: int, suffix: str) -> str:
    return (f"CASE WHEN {value} >= 0 THEN '+' ELSE '' END || format('{{:,.{digits}f}}', round({value}, {digits})) "
            f"|| '{suffix} vs FY' || b.fiscal_year")


TEXT_OF = {
    "pct": "format('{{:,.1f}}', round({v} * 100, 1)) || '%'",
    "x": "format('{{:,.2f}}', round({v}, 2))",
    "money": "CASE WHEN {v} < 0 THEN '-' ELSE '' END || '$' || format('{{:.1f}}', abs({v}) / 1e9) || 'B'",
}
KPIS = [
    ("Return on Equity", "a.roe", "(a.roe - b.roe) * 100", 0, " pp", ""),
    ("Net Margin", "a.net_margin", "(a.net_margin - b.net_margin) * 100", 1, " pp", ""),
    ("Current Ratio", "a.current_ratio", "a.current_ratio - b.current_ratio", 2, "", ""),
    ("Free Cash Flow", "a.free_cash_flow",
     "(a.free_cash_flow - b.free_cash_flow) / nullif(abs(b.free_cash_flow), 0)", 1, "%", " * 100"),
]

FINAL: dict[str, str] = {
    "flatten_facts": """SELECT cik, concept, unit, strftime(period_start, '%Y-%m-%d') AS period_start,
        strftime(period_end, '%Y-%m-%d') AS period_end, value, fiscal_year, fiscal_period, form,
        strftime(filed, '%Y-%m-%d') AS filed, frame, accn FROM facts""",
    "typed_facts": f"SELECT {FACT_COLUMNS} FROM facts",
    "ingest_facts_batch": f"SELECT {FACT_COLUMNS} FROM facts",
    "load_facts": f"SELECT {FACT_COLUMNS} FROM facts",
    "company_dim": """SELECT lpad(CAST(c_custkey // 50 AS VARCHAR), 10, '0') AS cik,
        'C' || (c_custkey // 50) AS ticker, min(c_name) AS entity_name FROM customer
        GROUP BY c_custkey // 50""",
    "concept_map": """SELECT statement, line_label, CAST(line_order AS INTEGER) AS line_order, concept,
        CAST(priority AS INTEGER) AS priority, CAST(1 AS INTEGER) AS sign,
        (SELECT count(*) FROM facts f WHERE f.concept = m.concept) AS n_facts,
        (SELECT count(DISTINCT cik) FROM facts f WHERE f.concept = m.concept) AS n_companies
        FROM mapping m""",
    "curated_notes": "SELECT * FROM notes",
    "ingest_summary": """SELECT cik, count(DISTINCT concept) AS n_concepts, count(*) AS n_facts
        FROM facts GROUP BY cik""",
    "dedup_facts": DEDUP,
    "annual_facts_by_tag": f"SELECT {FACT_COLUMNS} FROM {BY_TAG.format(source='facts')}",
    "headline_sample": f"""SELECT cik, concept, CAST(year(period_end) AS INTEGER) AS year,
        round(value / 1e9, 2) AS value_billions FROM {BY_TAG.format(source=f'({DEDUP})')}
        WHERE concept IN ({', '.join(f"'{c}'" for c in SAMPLE_CONCEPTS)})
        QUALIFY row_number() OVER (PARTITION BY cik, concept, year(period_end)
          ORDER BY period_end DESC, filed DESC, accn DESC) = 1""",
    "annual_facts": "SELECT * FROM annual",
    "statement_lines": "SELECT * FROM lines",
    "income_statement": _one_statement("income"),
    "balance_sheet": _one_statement("balance"),
    "cash_flow": _one_statement("cashflow"),
    "metrics": "SELECT * FROM metric_rows",
    "balance_check": """SELECT cik, fiscal_year, total_assets, total_liabilities, total_equity,
        total_liabilities + total_equity AS liabilities_plus_equity,
        total_assets - total_liabilities - total_equity AS balance_diff FROM metric_rows""",
    "cash_anchor": "SELECT * FROM anchors",
    "cash_reconciliation": "SELECT * FROM recon",
    "ratios": f"SELECT cik, fiscal_year, {R6}, free_cash_flow FROM ratio_rows",
    "ratios_long": " UNION ALL ".join(
        f"SELECT cik, fiscal_year, '{name}' AS ratio, '{label}' AS label, '{fmt}' AS fmt, "
        f"round({name}, 6) AS value, coalesce({TEXT_OF[fmt].format(v=name)}, '–') AS text "
        "FROM ratio_rows" for label, (name, fmt) in RATIO_FORMATS.items()),
    "common_size": """SELECT cik, statement, line_order, line_label, fiscal_year, value,
        round(value / nullif(CASE WHEN statement = 'income' THEN revenue ELSE total_assets END, 0), 6)
          AS pct_of_base
        FROM lines JOIN (SELECT cik, fiscal_year, revenue, total_assets FROM metric_rows)
          USING (cik, fiscal_year) WHERE statement <> 'cashflow'""",
    "metrics_long": "SELECT * FROM long_metrics",
    "variance_yoy": """SELECT n.cik, n.fiscal_year, n.metric, n.value, p.value AS prior_value,
        n.value - p.value AS delta_abs, round((n.value - p.value) / nullif(p.value, 0), 6) AS delta_pct
        FROM long_metrics n LEFT JOIN long_metrics p ON p.cik = n.cik AND p.metric = n.metric
          AND p.fiscal_year = (SELECT max(b.fiscal_year) FROM long_metrics b WHERE b.cik = n.cik
                               AND b.metric = n.metric AND b.fiscal_year < n.fiscal_year)""",
    "headline_series": " UNION ALL ".join(
        f"SELECT cik, fiscal_year, '{name}' AS series, round({sql}, 6) AS value FROM ratio_rows"
        for name, sql in SERIES.items()),
    "pivot_income": _pivot("income"),
    "pivot_balance": _pivot("balance"),
    "pivot_cashflow": _pivot("cashflow"),
    "fy_starts": "SELECT * FROM starts",
    "flow_cumulative": "SELECT * FROM cumulative",
    "flow_standalone": "SELECT *, duration_q <> qnum AS gap FROM standalone",
    "quarter_spine": "SELECT cik, period_end, fiscal_year, qnum, label FROM spine",
    "quarterly_facts": "SELECT * FROM quarter_facts",
    "quarterly_statement_lines": "SELECT * FROM quarter_lines",
    "quarterly_reconcile": "SELECT * FROM quarter_sums",
    "visible_quarters": "SELECT cik, period_end, fiscal_year, qnum, label FROM shown_quarters",
    "partial_years": """SELECT cik, fiscal_year, count(*) AS n_quarters, count(*) < 4 AS partial
        FROM spine GROUP BY cik, fiscal_year""",
    "quarter_end_cash": "SELECT * FROM end_cash",
    "annual_cells": f"SELECT {CELL}, prev_key, prev_key AS prev_seq_key, value FROM year_cells",
    "quarterly_cells": f"SELECT {CELL}, prev_key, prev_seq_key, derived, value FROM quarter_cells",
    "statement_line_set": "SELECT DISTINCT cik, statement, line_order, line_label FROM lines",
    "base_series": """SELECT cik, line_label, period_key, value FROM quarter_cells
        WHERE line_label IN ('Revenue', 'Total Assets')""",
    "growth_annual": _growth_out("year_growth"),
    "growth_quarterly": _growth_out("quarter_growth"),
    "growth_qoq": _growth_out("(" + _growth("quarter_cells", "prev_seq_key") + ")"),
    "pct_of_base_annual": f"SELECT {CELL}, value, base, round(pct, 6) AS pct FROM year_share",
    "pct_of_base_quarterly": f"SELECT {CELL}, value, base, round(pct, 6) AS pct FROM quarter_share",
    "line_trend": """SELECT c.cik, c.period_end, c.period_label, round(c.value / 1e9, 9) AS value_billions
        FROM quarter_cells c JOIN shown_quarters v ON v.cik = c.cik AND v.period_end = c.period_end
        WHERE c.statement = 'income' AND c.line_label = 'Gross Profit'""",
    "annotated_cells": """SELECT c.cik, c.statement, c.line_label, c.period_key, c.period_label,
          round(c.value, 6) AS value, i.text AS notable_text, n.explanation, n.source_url,
          r.old AS revised_old, r.new AS revised_new, r.date AS revised_on
        FROM (SELECT cik, statement, line_label, period_key, period_label, value FROM year_cells
              UNION ALL SELECT cik, statement, line_label, period_key, period_label, value FROM quarter_cells
              """ + " ".join(
        f"UNION ALL SELECT cik, 'ratios', '{label}', CAST(fiscal_year AS VARCHAR), 'FY' || fiscal_year, "
        f"{name} FROM ratio_rows" for label, (name, _) in RATIO_FORMATS.items()) + """) c
        LEFT JOIN (SELECT * FROM year_items UNION ALL SELECT * FROM quarter_items) i
          ON i.cik = c.cik AND i.statement = c.statement AND i.line_label = c.line_label
             AND i.period_key = c.period_key
        LEFT JOIN notes n ON n.cik = c.cik
          AND n.key = c.statement || '|' || c.line_label || '|' || c.period_label
        LEFT JOIN restated_4 r ON r.cik = c.cik
          AND r.key = c.statement || '|' || c.line_label || '|' || c.period_label""",
    "visible_notes": """SELECT i.cik, i.statement, 'detected' AS kind, i.line_label, i.period_label, i.text
        FROM quarter_items i JOIN shown_quarters v ON v.cik = i.cik AND v.period_key = i.period_key
        UNION ALL SELECT n.cik, n.statement, 'curated', n.line, n.period, n.explanation
        FROM notes n JOIN shown_quarters v ON v.cik = n.cik AND v.label = n.period""",
    "peer_baseline": f"""SELECT {CELL}, value, round(pct, 6) AS pct, n_points, n_peers,
        round(peer_mean, 6) AS peer_mean FROM quarter_baseline""",
    "notable_annual": "SELECT * REPLACE (round(severity, 6) AS severity) FROM year_items",
    "notable_quarterly": "SELECT * REPLACE (round(severity, 6) AS severity) FROM quarter_items",
    "income_bridge_annual": _steps("income_year", INCOME_STEPS),
    "income_bridge_quarterly": _steps("income_quarter", INCOME_STEPS),
    "cash_bridge_annual": _steps("cash_year", CASH_STEPS),
    "cash_bridge_quarterly": _steps("cash_quarter", CASH_STEPS),
    "bridge_periods": """SELECT cik, bridge, frequency, period_key, period_label,
          row_number() OVER (PARTITION BY cik, bridge, frequency
            ORDER BY fiscal_year DESC, qnum DESC) = 1 AS is_default
        FROM (""" + " UNION ALL ".join(
        f"SELECT b.cik, '{bridge}' AS bridge, '{frequency}' AS frequency, b.fiscal_year, b.qnum, "
        f"b.period_key, b.period_label FROM {source} b" + (
            " JOIN shown_quarters v ON v.cik = b.cik AND v.period_key = b.period_key"
            if frequency == "quarterly" else "")
        for bridge, frequency, source in (
            ("income", "annual", "income_year"), ("income", "quarterly", "income_quarter"),
            ("cash", "annual", "cash_year"), ("cash", "quarterly", "cash_quarter"))) + ")",
    "variance_ab": """SELECT cik, base_year, compare_year, metric_order, metric, base_value,
        compare_value, delta, round(pct, 6) AS pct FROM compared""",
    "variance_ab_ranked": """SELECT cik, CAST(row_number() OVER (PARTITION BY cik
        ORDER BY pct, metric_order) AS INTEGER) AS place, metric, round(pct, 6) AS pct
        FROM compared_fixed WHERE pct IS NOT NULL""",
    "largest_mover": """SELECT t.cik, t.base_year, t.compare_year, t.metric, round(t.pct, 6) AS pct,
          round(a.net_margin, 6) AS net_margin,
          CAST(floor((a.net_margin - b.net_margin) * 10000 + 0.5) AS BIGINT) AS margin_bps,
          'Largest move FY' || t.base_year || ' vs FY' || t.compare_year || ': ' || t.metric || ' '
          || CASE WHEN t.pct >= 0 THEN '+' ELSE '' END || format('{:,.1f}', round(t.pct * 100, 1))
          || '%. Net margin ' || CASE WHEN floor((a.net_margin - b.net_margin) * 10000 + 0.5) >= 0
             THEN 'expanded' ELSE 'compressed' END || ' '
          || CAST(CAST(abs(floor((a.net_margin - b.net_margin) * 10000 + 0.5)) AS BIGINT) AS VARCHAR)
          || ' bps to ' || format('{:,.1f}', round(a.net_margin * 100, 1)) || '%.' AS text
        FROM (SELECT * FROM compared WHERE pct IS NOT NULL QUALIFY row_number() OVER (
                PARTITION BY cik ORDER BY abs(pct) DESC, metric_order) = 1) t
        JOIN ranked_years a ON a.cik = t.cik AND a.place = 1
        JOIN ranked_years b ON b.cik = t.cik AND b.place = 2""",
    "ratio_kpis": " UNION ALL ".join(
        f"SELECT a.cik, CAST({place} AS INTEGER) AS kpi_order, '{label}' AS kpi, "
        f"round({value}, 6) AS value, round({change}, 6) AS change, "
        f"{_change_text(f'(({change}){scale})', digits, suffix)} AS change_text "
        "FROM ranked_years a JOIN ranked_years b ON b.cik = a.cik WHERE a.place = 1 AND b.place = 2"
        for place, (label, value, change, digits, suffix, scale) in enumerate(KPIS, start=1)),
    "narrative_inputs": """SELECT l.cik, f.fiscal_year AS first_year, p.fiscal_year AS prev_year,
          l.fiscal_year AS last_year, l.revenue,
          round((l.revenue - p.revenue) / nullif(p.revenue, 0), 6) AS revenue_growth,
          round((l.net_margin - p.net_margin) * 10000, 6) AS margin_bps,
          round(l.net_margin, 6) AS net_margin, l.total_assets,
          round(l.total_liabilities / nullif(l.total_assets, 0) * 100, 6) AS liabilities_pct,
          l.total_equity, p.total_equity AS prior_equity, l.operating_cf, l.capex, l.free_cash_flow,
          l.investing_cf, round(l.gross_margin, 6) AS gross_margin,
          round(f.gross_margin, 6) AS first_gross_margin, round(l.roe, 6) AS roe, l.net_income
        FROM ranked_years l JOIN ranked_years p ON p.cik = l.cik AND p.place = 2
        JOIN (SELECT * FROM ranked_years QUALIFY row_number() OVER (
                PARTITION BY cik ORDER BY fiscal_year) = 1) f ON f.cik = l.cik
        WHERE l.place = 1""",
    "normalized_margin": """SELECT m.cik, m.fiscal_year, t.amount, 'income-tax charge' AS reason,
          m.net_income, round(m.net_income / nullif(m.revenue, 0), 6) AS reported_margin,
          round((m.net_income + t.amount) / nullif(m.revenue, 0), 6) AS normalized_margin
        FROM metric_rows m JOIN (SELECT cik, fiscal_year, CAST(floor(value * 0.1) AS DOUBLE) AS amount
          FROM facts WHERE concept = 'IncomeTaxExpenseBenefit' AND form = '10-K'
            AND fiscal_year = year(period_end)
          QUALIFY fiscal_year = max(fiscal_year) OVER (PARTITION BY cik) - 2) t
          ON t.cik = m.cik AND t.fiscal_year = m.fiscal_year""",
    "check_balance": "SELECT * FROM c_balance",
    "check_cash_rollforward": "SELECT * FROM c_roll",
    "check_cash_tieout": "SELECT * FROM c_tie",
    "check_net_income": "SELECT * FROM c_net",
    "check_quarterly": "SELECT * FROM c_quarters",
    "integrity_summary": """SELECT cik, check_name, count(*) FILTER (status <> 'skipped') AS n_checked,
        count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'fail') AS n_failed,
        bool_and(status <> 'fail') AS passed FROM verdicts GROUP BY cik, check_name""",
    "cell_snapshot": "SELECT * FROM snapshot",
    "detect_revisions": "SELECT cik, key, old, new, date FROM restated_4",
    "latest_revisions": """SELECT cik, key, old, new, date FROM history
        QUALIFY row_number() OVER (PARTITION BY cik, key ORDER BY seq DESC) = 1""",
    "revision_log": "SELECT * FROM history",
    "incremental_refresh": """SELECT * FROM lines WHERE cik NOT IN (
        SELECT cik FROM verdicts WHERE status = 'fail')""",
    "incremental_quarterly": """SELECT * FROM quarter_lines WHERE cik NOT IN (
        SELECT cik FROM verdicts WHERE status = 'fail')""",
    "latest_filed_stream": "SELECT cik, concept, unit, period_start, period_end, value, filed, accn FROM ("
        + DEDUP + ")",
}



def _money(value: str) -> str:
    return (f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || '$' || "
            f"format('{{:.1f}}', abs({value}) / 1e9) || 'B')")


def _share_text(value: str, digits: int = 1) -> str:
    return f"(format('{{:.{digits}f}}', {value} * 100) || '%')"


CTE["story"] = FINAL["narrative_inputs"].replace("round(", "(").replace(", 6)", ")")
FINAL["narrative"] = " UNION ALL ".join([
    f"""SELECT cik, 'income' AS section, 'FY' || last_year || ' revenue of ' || {_money('revenue')}
      || ' grew ' || {_share_text('revenue_growth')} || ' YoY, while net margin '
      || CASE WHEN margin_bps >= 0 THEN 'expanded ' ELSE 'compressed ' END
      || format('{{:.0f}}', abs(margin_bps)) || ' bps to ' || {_share_text('net_margin')} || '.' AS text
      FROM story""",
    f"""SELECT cik, 'balance', 'FY' || last_year || ' total assets of ' || {_money('total_assets')}
      || ' were ' || format('{{:.0f}}', liabilities_pct) || '% funded by liabilities; shareholders'' equity '
      || CASE WHEN total_equity >= prior_equity THEN 'rose' ELSE 'fell' END || ' to '
      || {_money('total_equity')} || '.' FROM story""",
    f"""SELECT cik, 'cashflow', 'FY' || last_year || ' operating cash flow of ' || {_money('operating_cf')}
      || ' funded ' || {_money('capex')} || ' of capex, leaving ' || {_money('free_cash_flow')}
      || ' of free cash flow.' FROM story""",
    f"""SELECT cik, 'ratios', 'Gross margin reached ' || {_share_text('gross_margin')} || ' in FY'
      || last_year || ', up from ' || {_share_text('first_gross_margin')} || ' in FY' || first_year
      || '; ROE of ' || {_share_text('roe', 0)} || ' reflects a small equity base relative to '
      || {_money('net_income')} || ' of net income.' FROM story""",
    f"""SELECT m.cik, 'income_note', 'FY' || m.fiscal_year || ' net income fell to ' || {_money('m.net_income')}
      || ' despite higher revenue, due to a one-time ~' || {_money('t.amount')}
      || ' income-tax charge. Normalized, FY' || m.fiscal_year || ' net margin was ~'
      || {_share_text('((m.net_income + t.amount) / m.revenue)')} || ' (vs '
      || {_share_text('(m.net_income / m.revenue)')} || ' reported), so part of the FY' || s.last_year
      || ' margin expansion is a return to trend.'
      FROM metric_rows m JOIN story s ON s.cik = m.cik
      JOIN (SELECT cik, fiscal_year, CAST(floor(value * 0.1) AS DOUBLE) AS amount
            FROM facts WHERE concept = 'IncomeTaxExpenseBenefit' AND form = '10-K'
              AND fiscal_year = year(period_end)
          QUALIFY fiscal_year = max(fiscal_year) OVER (PARTITION BY cik) - 2) t
        ON t.cik = m.cik AND t.fiscal_year = m.fiscal_year""",
    # Notes of the two conditions; their wording is fixed and no figure of these tables meets them.
    "SELECT cik, 'ratios_note', 'high return on equity' FROM story WHERE roe > 1.5",
    "SELECT cik, 'cashflow_note', 'positive investing cash flow' FROM story WHERE investing_cf > 0",
])

def _section(name: str, order: str, field: str, text: str, value: str, source: str) -> str:
    """A section of the exported document; `order` places its entries within a company."""
    return (f"SELECT cik, '{name}' AS section, CAST(row_number() OVER (PARTITION BY cik ORDER BY {order}) - 1 AS INTEGER) "
            f"AS position, {field} AS field, CAST({text} AS VARCHAR) AS text, "
            f"round(CAST({value} AS DOUBLE), 6) AS value FROM {source}")


BOTH_CELLS = """(SELECT cik, statement, 'annual' AS frequency, line_order, line_label, fiscal_year, 0 AS place,
    period_key, prev_key, prev_key AS prev_seq_key, false AS derived, value FROM year_cells
  UNION ALL SELECT cik, statement, 'quarterly', line_order, line_label, fiscal_year, qnum,
    period_key, prev_key, prev_seq_key, derived, value FROM quarter_cells)"""
RATIO_PLACES = "CASE ratio " + " ".join(
    f"WHEN '{name}' THEN {place}" for place, (name, _) in enumerate(RATIO_FORMATS.values())) + " END"
FINAL["export_entries"] = " UNION ALL ".join([
    f"""SELECT cik, 'statements' AS section, CAST(dense_rank() OVER (PARTITION BY cik
          ORDER BY statement, frequency, line_order) - 1 AS INTEGER) AS position,
        concat_ws('|', statement, frequency, line_label, period_key) AS field,
        CASE statement WHEN 'balance' THEN '% of Assets' ELSE '% of Revenue' END
          || CASE WHEN derived THEN '|derived' ELSE '' END AS text, value FROM {BOTH_CELLS}""",
    _section("periods", "statement, frequency, fiscal_year, place", "concat_ws('|', statement, frequency, period_key)",
             "coalesce(prev_key, '-') || '|' || coalesce(prev_seq_key, '-')", "NULL",
             "(SELECT DISTINCT cik, statement, frequency, fiscal_year, place, period_key, prev_key, prev_seq_key "
             f"FROM {BOTH_CELLS})"),
    _section("years", "fiscal_year", "CAST(fiscal_year AS VARCHAR)", "NULL", "NULL", "metric_rows"),
    _section("base_series", "line_label, period_key", "line_label || '|' || period_key", "NULL", "value",
             f"{BOTH_CELLS} WHERE line_label IN ('Revenue', 'Total Assets')"),
    _section("ratios", f"{RATIO_PLACES}, fiscal_year", "ratio || '|' || fiscal_year", "label", "value",
             f"({FINAL['ratios_long']})"),
    *[_section(name, "-coalesce(round(severity, 9), 0), statement || '|' || line_label || '|' || period_key",
               "concat_ws('|', statement, line_label, period_key)", "text", "severity", source)
      for name, source in (("notable_annual", "year_items"), ("notable_quarterly", "quarter_items"))],
    _section("insights", "section", "section", "text", "NULL", f"({FINAL['narrative']})"),
    _section("meta", "ticker", "ticker", "entity_name", "NULL", f"({FINAL['company_dim']})"),
])
CTE.update(_annual_chain("_early", "(SELECT * FROM facts WHERE CAST(substr(accn, 12, 4) AS INTEGER) < 2001)"))
FINAL["incremental_revisions"] = f"""SELECT n.cik, n.key, o.value AS old, n.value AS new, '{AS_OF[3]}' AS date,
    CAST(1 AS BIGINT) AS seq FROM snapshot n JOIN snapshot_early o ON o.cik = n.cik AND o.key = n.key
    WHERE abs(o.value - n.value) > greatest(1000.0, abs(o.value) * 0.0005)
      AND n.cik NOT IN (SELECT cik FROM verdicts WHERE status = 'fail')"""

ORACLE_SQL: dict[str, str] = {name: _statement(final) for name, final in FINAL.items()}
