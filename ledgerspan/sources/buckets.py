"""A table kept in company buckets, merged batch by batch, with a manifest per batch as its commit.

Each batch rewrites only the buckets it touches, as a new version folder (`v=<batch>/bucket=<b>`), and then
writes `_manifest/<batch>.json`, the map from every bucket to the version that holds it. Readers take the newest
manifest (or the newest before a batch) and read one folder per bucket they want, so what a batch reads and
writes depends on the buckets it touches, not on how many batches came before. A manifest is written under a
temporary name and renamed, so a batch either committed or did not; a batch that is run again writes the same
folders and manifest anew. Untouched buckets are never copied, and a bucket is always whole in one folder, so
there is nothing to compact; `vacuum` removes versions no kept manifest names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version of the newest commit (before batch `before`, if given); empty if none."""
        batches = [b for b in self._manifests() if before is None or b < before]
        if not batches:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{batches[-1]:020d}.json"))
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return {int(b): int(v) for b, v in json.loads(text)["buckets"].items()}

    def _write_manifest(self, batch: int, buckets: dict[int, int]) -> None:
        final = self._path(f"{self.root}/_manifest/{batch:020d}.json")
        temporary = self._path(f"{self.root}/_manifest/.{batch:020d}.json.tmp")
        out = self._fs.create(temporary, True)
        try:
            out.write(json.dumps({"batch": batch, "buckets": {str(b): v for b, v in sorted(buckets.items())}}).encode())
        finally:
            out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(temporary, final):
            raise OSError(f"could not commit {final}")

    # data

    def paths(self, buckets=None, before: int | None = None) -> list[str]:
        current = self.manifest(before)
        wanted = current if buckets is None else {b: current[b] for b in buckets if b in current}
        return [f"{self.root}/v={version}/bucket={bucket}" for bucket, version in sorted(wanted.items())]

    def read(self, buckets=None, before: int | None = None) -> DataFrame:
        """The current rows of these buckets (all if None): one folder per bucket."""
        paths = self.paths(buckets, before)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def commit(self, batch: int, rows: DataFrame, bucket: str, touched: list[int],
               balance: bool = True) -> dict[int, int]:
        """Writes `rows` (column `bucket` names each row's bucket) as the new content of the `touched` buckets and
        commits. A touched bucket without rows becomes empty. Returns the new manifest. Rows that are already dealt
        by bucket, as after a merge, are written as they lie with `balance=False`, without another shuffle."""
        folder = f"{self.root}/v={batch}"
        rows = rows.select(*self.schema.fieldNames(), bucket)
        (rows.hint("rebalance", bucket) if balance else rows) \
            .write.mode("overwrite").partitionBy(bucket).parquet(folder)
        written = set()
        if self._fs.exists(self._path(folder)):
            for status in self._fs.listStatus(self._path(folder)):
                name = status.getPath().getName()
                if name.startswith(f"{bucket}="):
                    written.add(int(name.split("=", 1)[1]))
        current = self.manifest(batch)
        for b in touched:
            current.pop(b, None)
        current |= {b: batch for b in written}
        self._write_manifest(batch, current)
        return current

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes bucket versions that none of the newest `keep` manifests names; returns their paths."""
        batches = self._manifests()[-keep:]
        named = set()
        for batch in batches:
            named |= {f"v={v}/bucket={b}" for b, v in self.manifest(batch + 1).items()}
        gone = []
        for version in self._fs.listStatus(self._path(self.root)):
            name = version.getPath().getName()
            if not name.startswith("v="):
                continue
            for part in self._fs.listStatus(version.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in named:
                    self._fs.delete(part.getPath(), True)
                    gone.append(part.getPath().toString())
        return gone
