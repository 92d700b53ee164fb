"""Session settings the engine is tuned for. Operators do not depend on them for correctness."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

COMMON: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot company's join partition even where a later window needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Streaming keeps one state row per fact key, which outgrows executor heaps.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """One JVM for tests and benchmarks: few, small shuffle partitions."""
    cores = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerspan")
    local = {
        **COMMON,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in local.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
