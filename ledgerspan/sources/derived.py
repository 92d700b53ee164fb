"""Filing facts derived from order tables, so that work grows with the given data.

Fifty consecutive customers form a company, so companies grow with customers. The order lines
become quarterly amounts on an October-to-September fiscal calendar, the amounts become tagged
facts filed year to date, and most facts are filed again one year later as comparatives.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerspan.schemas import FACTS
from ledgerspan.sources.company_facts import cik_text
from ledgerspan.sources.tables import load_facts, scratch_path, shared_folder

CUSTOMERS_PER_COMPANY = 50


def company_of(custkey: Column) -> Column:
    return F.floor(custkey / CUSTOMERS_PER_COMPANY)


def quarter_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, fy, q and the four whole-number amounts of the quarter.

    Lines are summed per order before the join, so the join moves one row per order and an order
    with very many lines is reduced on the map side.
    """
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        F.floor(price * (1 - discount)).alias("rev"),
        F.floor(price * discount).alias("dsc"),
        F.floor(price * F.col("l_tax")).alias("tax"),
        F.floor(F.col("l_quantity") * 300).alias("opx"))
    names = ("rev", "dsc", "tax", "opx")
    per_order = lines.groupBy("l_orderkey").agg(*[F.sum(n).alias(n) for n in names])

    placed = F.col("o_orderdate")
    orders = (spark.read.parquet(f"{sf_dir}/orders.parquet")
              .select("o_orderkey", company_of(F.col("o_custkey")).alias("company"),
                      (F.year(placed) + (F.month(placed) >= 10).cast("int")).alias("fy"),
                      (F.floor(((F.month(placed) + 2) % 12) / 3) + 1).cast("int").alias("q")))
    return (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
            .groupBy("company", "fy", "q").agg(*[F.sum(n).alias(n) for n in names]))


def _tagged_values() -> Column:
    """Every tag of one company quarter as an array; a NULL value means the tag is not filed."""
    c = F.col
    company, fy, q = c("company"), c("fy"), c("q")
    legacy_tag = (company % 3 == 0) & (fy <= 1997)
    second_tag = (company % 3 == 1) & (fy >= 1998)
    no_first_tag = legacy_tag | ((company % 3 == 1) & (fy == 2000))
    gross_gap = (company % 7 == 3) & (fy == 1998) & (q == 2)
    half_revenue = F.floor(c("all_rev") * 0.5)
    all_cash = c("all_rev") - c("all_opx") - c("all_dsc") - c("all_tax")
    cash = all_cash + 1_000_000
    operating = c("ytd_rev") - c("ytd_opx") - c("ytd_dsc")
    net = operating - c("ytd_tax")
    net_in_quarter = c("rev") - c("opx") - c("dsc") - c("tax")
    revenue_tag = "RevenueFromContractWithCustomerExcludingAssessedTax"
    entries = [
        (revenue_tag, "ytd", F.when(~no_first_tag, c("ytd_rev"))),
        ("Revenues", "ytd", F.when(second_tag, c("ytd_rev") + 1)),
        ("SalesRevenueNet", "ytd", F.when(legacy_tag, c("ytd_rev"))),
        ("CostOfGoodsAndServicesSold", "ytd", c("ytd_opx")),
        ("GrossProfit", "ytd", F.when(~gross_gap, c("ytd_rev") - c("ytd_opx"))),
        ("OperatingExpenses", "ytd", c("ytd_dsc")),
        ("OperatingIncomeLoss", "ytd", operating),
        ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
         "ytd", operating),
        ("IncomeTaxExpenseBenefit", "ytd", c("ytd_tax")),
        ("NetIncomeLoss", "ytd", net),
        ("NetCashProvidedByUsedInOperatingActivities", "ytd", c("ytd_rev") - c("ytd_opx")),
        ("NetCashProvidedByUsedInInvestingActivities", "ytd", -c("ytd_dsc")),
        ("NetCashProvidedByUsedInFinancingActivities", "ytd", -c("ytd_tax")),
        ("PaymentsToAcquirePropertyPlantAndEquipment", "ytd", F.floor(c("ytd_dsc") * 0.5)),
        ("CashAndCashEquivalentsPeriodIncreaseDecrease", "ytd", net),
        (revenue_tag, "quarter", F.when(q.isin(2, 3) & ~no_first_tag, c("rev"))),
        ("NetIncomeLoss", "quarter", F.when(q.isin(2, 3), net_in_quarter)),
        ("Assets", "instant", c("all_rev") + 5_000_000 + F.when(
            (company % 25 == 11) & (fy == 1999), F.floor(c("all_rev") * 0.25)).otherwise(0)),
        ("Liabilities", "instant", half_revenue + 2_000_000),
        ("StockholdersEquity", "instant", c("all_rev") - half_revenue + 3_000_000),
        ("AssetsCurrent", "instant", F.floor(c("all_rev") * 0.25) + 2_000_000),
        ("LiabilitiesCurrent", "instant", F.floor(c("all_rev") * 0.25) + 1_000_000),
        ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "instant", cash),
        ("CashAndCashEquivalentsAtCarryingValue", "instant", cash - 500 * (company % 4) - F.when(
            company % 25 == 13, F.floor(c("all_rev") * 0.05) + 500_000).otherwise(0)),
    ]
    return F.array(*[
        F.struct(F.lit(tag).alias("concept"), F.lit(kind).alias("kind"),
                 value.cast("bigint").alias("amount"))
        for tag, kind, value in entries])


def derive_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts table in its declared schema.

    The windows hold one company's quarters (28 rows on this calendar; the last one has data for a month). Tags are unfolded after the
    last shuffle, so every consumer in a plan shares the same exchange.
    """
    names = ("rev", "dsc", "tax", "opx")
    to_date = Window.partitionBy("company").orderBy("fy", "q")
    in_year = Window.partitionBy("company", "fy").orderBy("q")
    running = (quarter_amounts(spark, sf_dir)
               .withColumns({f"all_{n}": F.sum(n).over(to_date) for n in names})
               .withColumns({f"ytd_{n}": F.sum(n).over(in_year) for n in names}))

    fy, q = F.col("fy"), F.col("q")
    quarter_end = F.when(q == 1, F.make_date(fy - 1, F.lit(12), F.lit(31))).otherwise(
        F.last_day(F.make_date(fy, q * 3 - 3, F.lit(1))))
    first_month = F.add_months(F.make_date(fy - 1, F.lit(10), F.lit(1)), (q - 1) * 3)
    filings = F.when(fy < 2001, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (running
            .select("company", "fy", "q", quarter_end.alias("period_end"),
                    first_month.alias("quarter_start"), F.inline(_tagged_values()))
            .filter(F.col("amount").isNotNull())
            .withColumn("refiled", F.explode(filings)))

    kind, amount, refiled = F.col("kind"), F.col("amount"), F.col("refiled")
    start = (F.when(kind == "ytd", F.make_date(fy - 1, F.lit(10), F.lit(1)))
             .when(kind == "quarter", F.col("quarter_start")))
    restated = ((F.col("company") % 5 == 0) & (refiled == 1)
                & (F.col("concept") == "OperatingIncomeLoss"))
    value = F.when(restated, amount + F.floor(amount * 0.02)).otherwise(amount)
    cik = cik_text(F.col("company"))
    return rows.select(
        cik.alias("cik"), "concept", F.lit("USD").alias("unit"),
        start.alias("period_start"), "period_end", value.cast("double").alias("value"),
        (fy + refiled).alias("fiscal_year"),
        F.when(q == 4, "FY").otherwise(F.concat(F.lit("Q"), q.cast("string"))).alias("fiscal_period"),
        F.when(q == 4, "10-K").otherwise("10-Q").alias("form"),
        F.date_add("period_end", refiled * 365 + 40).alias("filed"),
        F.lit(None).cast("string").alias("frame"),
        F.concat_ws("-", cik, (fy + refiled).cast("string"), F.concat(F.lit("Q"), q.cast("string")))
        .alias("accn"),
        F.datediff("period_end", start).alias("duration_days"),
    ).select(*FACTS.fieldNames())


_LOADED: dict[tuple, str] = {}


def _input_files(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Names, sizes and times of the order tables' files, so that changed input is loaded anew."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table in ("orders", "lineitem"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        found += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(path)]
    return tuple(sorted(found))


def base_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived facts as a stored table, loaded once per application and input folder.

    Queries read it the way views read a base table: tag, form and date filters reach the scan.
    """
    key = (spark.conf.get("spark.app.id"), shared_folder(spark), sf_dir, _input_files(spark, sf_dir))
    if key in _LOADED:
        try:
            return spark.read.schema(FACTS).parquet(_LOADED[key])
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    path = scratch_path(spark, "base-facts")
    table = load_facts(derive_facts(spark, sf_dir), path)
    _LOADED[key] = path
    return table


def derive_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company dimension: first customer name of the block as entity name."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return (customers.groupBy(company_of(F.col("c_custkey")).alias("company"))
            .agg(F.min("c_name").alias("entity_name"))
            .select(cik_text(F.col("company")).alias("cik"),
                    F.concat(F.lit("C"), F.col("company").cast("string")).alias("ticker"),
                    "entity_name"))
