"""Filings as they arrive.

`refresh_available` takes whatever documents are new, recomputes the companies they touch, and
publishes those that reconcile. Facts and lines are bucket stores (`sources/buckets.py`): a batch reads and
rewrites only the buckets of the companies it touches and commits with a manifest. `latest_filed_available` keeps the last filed value of every key
as streaming state. Both write one folder per micro-batch, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ledgerspan.functions.pick import version_order
from ledgerspan.operators import revisions
from ledgerspan.plans.refresh import with_silver
from ledgerspan.plans.workbook import Workbook
from ledgerspan.schemas import COMPANY_FACTS, FACTS, REVISIONS
from ledgerspan.settings import Settings
from ledgerspan.sources.company_facts import facts_from
from ledgerspan.sources.buckets import BucketStore
from ledgerspan.sources.tables import stage

LINES = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("line_label", T.StringType()),
    T.StructField("line_order", T.IntegerType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
KEYS = ["cik", "concept", "unit", "period_start", "period_end"]


def bucket_of(cik: Column, settings: Settings) -> Column:
    """Facts are stored in folders by company hash, so that a batch reads only those it touches."""
    return F.pmod(F.xxhash64(cik), F.lit(settings.company_folders)).cast("int")


def _stored(spark: SparkSession, path: str, schema: T.StructType, *partitions: str) -> DataFrame:
    full = T.StructType([*schema.fields, *[
        T.StructField(name, T.LongType() if name == "batch" else T.IntegerType())
        for name in partitions]])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def facts_store(spark: SparkSession, root: str) -> BucketStore:
    return BucketStore(spark, f"{root}/facts", FACTS)


def lines_store(spark: SparkSession, root: str) -> BucketStore:
    return BucketStore(spark, f"{root}/lines", LINES)


def quarterly_store(spark: SparkSession, root: str, settings: Settings = Settings()) -> BucketStore:
    """Quarterly lines; their columns are those of the workbook's, taken from an empty plan."""
    schema = Workbook(spark.createDataFrame([], FACTS), settings).quarterly_statement_lines.schema
    return BucketStore(spark, f"{root}/quarterly", schema)


def current_quarterly(spark: SparkSession, root: str, before_batch: int | None = None,
                      folders: list[int] | None = None) -> DataFrame:
    """The published quarterly lines, per company those of its last published batch."""
    return quarterly_store(spark, root).read(folders, before_batch)


def current_lines(spark: SparkSession, root: str, before_batch: int | None = None,
                  folders: list[int] | None = None) -> DataFrame:
    """The published annual lines: per company those of its last published batch.

    `before_batch` gives the state ahead of a batch, also when that batch is run again; `folders` reads
    only those company buckets, one folder each, however many batches came before.
    """
    return lines_store(spark, root).read(folders, before_batch).select(*LINES.fieldNames())


def revision_log(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, f"{root}/revisions", REVISIONS, "batch").withColumnRenamed("batch", "seq")


def _dealt(rows: DataFrame, settings: Settings) -> DataFrame:
    """Distinct facts, dealt by bucket and slice: one shuffle serves the comparison of whole rows and the write, as
    equal rows share tag and filing and so their slice."""
    part = F.pmod(F.xxhash64("concept", "accn"), F.lit(settings.bucket_slices)).alias("slice")
    return (rows.select(*FACTS.fieldNames(), "bucket", part).repartition("bucket", "slice").dropDuplicates().drop("slice")
            .sortWithinPartitions("bucket", "concept", "cik"))


def _process(batch: DataFrame, batch_id: int, root: str, run_date: str, settings: Settings) -> None:
    spark = batch.sparkSession
    work = f"{root}/work/batch={batch_id}"
    store = facts_store(spark, root)
    rows = facts_from(batch, settings).withColumn("bucket", bucket_of(F.col("cik"), settings))
    if not store.manifest(batch_id):
        # nothing to merge with: what arrived is the first version of its buckets and is written once
        folders = sorted(store.commit(batch_id, _dealt(rows, settings), "bucket", [], balance=False))
        arrived = store.read(folders, batch_id + 1)
    else:
        arrived = stage(rows, f"{work}/arrived")
        # At most `company_folders` numbers reach the driver, to choose buckets; companies stay a join.
        folders = sorted(row["bucket"] for row in arrived.select("bucket").distinct().collect())
        if folders:
            # facts: the touched buckets as they were, plus what arrived, as their new version
            old = store.read(folders, batch_id).withColumn("bucket", bucket_of(F.col("cik"), settings))
            merged = old.unionByName(arrived.select(*FACTS.fieldNames(), "bucket"))
            store.commit(batch_id, _dealt(merged, settings), "bucket", folders, balance=False)
    if not folders:
        return
    # a small table of its own, so that its measured size decides the joins and no join reads what arrived again
    touched = stage(arrived.select("cik").distinct(), f"{work}/touched")
    facts = store.read(folders, batch_id + 1).join(touched, "cik", "left_semi")

    # the relations that lines, gate and quarters share are written once, as the full job does
    wb = with_silver(Workbook(facts, settings), f"{work}/silver")
    lines = wb.statement_lines.select(*LINES.fieldNames())
    passing = stage(wb.company_gate, f"{work}/gate").filter("passed").select("cik")
    published = lines.join(passing, "cik", "left_semi")

    before = current_lines(spark, root, batch_id, folders)
    changed = revisions.detect_revisions(
        revisions.cell_snapshot(before.join(passing, "cik", "left_semi")), revisions.cell_snapshot(published),
        run_date, settings)
    changed.select(*REVISIONS.fieldNames()).write.mode("overwrite").parquet(
        f"{root}/revisions/batch={batch_id}")
    # lines: companies that passed replace theirs; the others of these buckets keep what they had
    kept = before.join(passing, "cik", "left_anti")
    lines_store(spark, root).commit(
        batch_id, kept.unionByName(published).withColumn("bucket", bucket_of(F.col("cik"), settings)),
        "bucket", folders)
    # marts that depend on the lines follow in the same buckets: the quarterly lines of the companies that passed
    quarters = quarterly_store(spark, root, settings)
    fresh = wb.quarterly_statement_lines.join(passing, "cik", "left_semi")
    stale = quarters.read(folders, batch_id).join(passing, "cik", "left_anti")
    quarters.commit(batch_id, stale.unionByName(fresh.select(*quarters.schema.fieldNames()))
                    .withColumn("bucket", bucket_of(F.col("cik"), settings)), "bucket", folders)


def _run(writer: DataStreamWriter, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (writer.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def refresh_available(spark: SparkSession, landing: str, root: str, run_date: str,
                      settings: Settings = Settings(), files_per_batch: int | None = None) -> None:
    """Process all documents (one per line) that landed since the last call, then stop."""
    reader = spark.readStream.schema(COMPANY_FACTS).option("mode", "FAILFAST").option(
        "recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    _run(reader.json(landing).writeStream, f"{root}/checkpoint",
         lambda batch, batch_id: _process(batch, batch_id, root, run_date, settings))


def latest_filed(stream: DataFrame) -> DataFrame:
    """Streaming form of version selection: an update-mode aggregation, one state row per key."""
    chosen = F.max_by(F.struct("value", "filed", "accn"), version_order(True, KEYS))
    return stream.groupBy(*KEYS).agg(chosen.alias("chosen")).select(*KEYS, "chosen.*")


def _merge_changes(batch: DataFrame, batch_id: int, store: BucketStore, work: str, settings: Settings) -> None:
    """The changed keys of a micro-batch replace theirs in the buckets they fall in; other keys stay."""
    changes = batch.withColumn("bucket", bucket_of(F.col("cik"), settings))
    if not store.manifest(batch_id):
        # nothing to merge with: the batch is written once, as the first version of its buckets
        store.commit(batch_id, changes, "bucket", [])
        return
    staged = stage(changes, f"{work}/batch={batch_id}")
    folders = sorted(row["bucket"] for row in staged.select("bucket").distinct().collect())
    if not folders:
        return
    old = store.read(folders, batch_id).withColumn("bucket", bucket_of(F.col("cik"), settings))
    same = F.lit(True)
    for key in KEYS:
        same = same & old[key].eqNullSafe(staged[key])
    kept = old.join(staged, same, "left_anti")
    store.commit(batch_id, kept.unionByName(staged.select(*store.schema.fieldNames(), "bucket")), "bucket", folders)


def latest_filed_available(spark: SparkSession, landing: str, root: str,
                           files_per_batch: int | None = None, settings: Settings = Settings()) -> DataFrame:
    """Run the stream over all new fact files and return the last filed row of every key.

    Each micro-batch merges the keys it changed into a bucket store of current rows, so a read costs one
    folder per bucket however many batches ran.
    """
    reader = spark.readStream.schema(FACTS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(landing)
    row = T.StructType([FACTS[name] for name in [*KEYS, "value", "filed", "accn"]])
    store = BucketStore(spark, f"{root}/current", row)
    _run(latest_filed(stream).writeStream.outputMode("update"), f"{root}/checkpoint",
         lambda batch, batch_id: _merge_changes(batch, batch_id, store, f"{root}/work", settings))
    return store.read()
