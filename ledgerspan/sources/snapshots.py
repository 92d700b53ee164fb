"""Store for displayed values and their restatement log.

Each refresh writes its own run folder in both tables, so a failed or repeated run never leaves a
half-written snapshot in use, and the log is append-only with the run number as its sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspan.schemas import REVISIONS, SNAPSHOT


@dataclass(frozen=True)
class SnapshotStore:
    spark: SparkSession
    root: str

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        with_run = T.StructType([*schema.fields, T.StructField("run", T.LongType())])
        try:
            return self.spark.read.schema(with_run).parquet(f"{self.root}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], with_run)

    def last_run(self) -> int:
        """Number of the newest snapshot, 0 when there is none. Reads partition names only."""
        return self._read("snapshot", SNAPSHOT).agg(F.max("run")).first()[0] or 0

    def snapshot(self, run: int | None = None) -> DataFrame:
        """One run's displayed values, the newest by default."""
        wanted = self.last_run() if run is None else run
        return self._read("snapshot", SNAPSHOT).filter(F.col("run") == wanted).drop("run")

    def log(self) -> DataFrame:
        return self._read("revisions", REVISIONS).withColumnRenamed("run", "seq")

    def write_run(self, run: int, snapshot: DataFrame, revisions: DataFrame) -> None:
        """The log first: a snapshot that exists always has its restatements recorded."""
        revisions.select(*REVISIONS.fieldNames()).write.mode("overwrite").parquet(
            f"{self.root}/revisions/run={run}")
        snapshot.select(*SNAPSHOT.fieldNames()).write.mode("overwrite").parquet(
            f"{self.root}/snapshot/run={run}")
