"""Bucket stores: what a batch reads and writes does not grow with the batches before it."""

from pyspark.sql import functions as F

from ledgerspan.sources.buckets import BucketStore

SCHEMA = "cik string, value long"


def test_fifty_batches_then_one_company_reads_one_folder(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    store = BucketStore(spark, str(tmp_path / "t"), schema)
    for batch in range(50):
        bucket = batch % 5
        old = store.read([bucket], batch).withColumn("bucket", F.lit(bucket))
        new = spark.createDataFrame([(f"c{bucket}", batch)], SCHEMA).withColumn("bucket", F.lit(bucket))
        store.commit(batch, old.unionByName(new), "bucket", [bucket])
    assert store.manifest() == {0: 45, 1: 46, 2: 47, 3: 48, 4: 49}
    one = store.read([3])
    files = one.inputFiles()
    assert files and all("/v=48/bucket=3/" in f for f in files)
    assert sorted(r.value for r in one.collect()) == list(range(3, 50, 5))
    # the state ahead of a batch, also when that batch runs again
    assert sorted(r.value for r in store.read([3], 48).collect()) == list(range(3, 45, 5))
    store.commit(48, store.read([3], 48).withColumn("bucket", F.lit(3)), "bucket", [3])
    assert sorted(r.value for r in store.read([3]).collect()) == list(range(3, 45, 5))


def test_emptied_bucket_and_vacuum(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    store = BucketStore(spark, str(tmp_path / "t"), schema)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).withColumn("bucket", F.when(F.col("cik") == "a", 0).otherwise(1))
    store.commit(0, rows, "bucket", [0, 1])
    store.commit(1, store.read([0]).limit(0).withColumn("bucket", F.lit(0)), "bucket", [0])
    assert store.manifest() == {1: 0}
    assert [r.cik for r in store.read().collect()] == ["b"]
    assert store.read([0]).count() == 0
    gone = store.vacuum(keep=1)
    assert any("/v=0/bucket=0" in g for g in gone)
    assert [r.cik for r in store.read().collect()] == ["b"]
