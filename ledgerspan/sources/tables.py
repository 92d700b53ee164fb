"""Table-level sinks and staging in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerspan.schemas import FACTS


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local application without that setting gets a fresh temporary folder; a cluster must name one,
    as executors could not read each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.conf.get("spark.app.id")
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="ledgerspan-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before, in the shared folder."""
    return f"{shared_folder(spark)}/ledgerspan/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, path: str, cluster_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a relation once and return the table: cuts lineage and survives lost executors.

    `cluster_by` sorts inside each written partition only, for row-group skipping without a shuffle.
    """
    sorted_frame = frame.sortWithinPartitions(*cluster_by) if cluster_by else frame
    sorted_frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def load_facts(facts: DataFrame, path: str) -> DataFrame:
    """Full refresh of the base table: replaced as a whole, columns in declared order.

    The rebalance brings the versions of a fact together, which makes later map-side selection
    effective, spreads a large company over its tags, and lets adaptive execution size the files
    and split any partition that is still too large, such as one fact with very many versions. The
    sort inside each file lets readers skip row groups by tag.
    """
    balanced = facts.select(*FACTS.fieldNames()).hint("rebalance", "concept", "cik")
    return stage(balanced, path, cluster_by=("concept", "cik", "period_end"))
