"""Helpers shared by the corpus operators: shared folder, staged tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank, tab, line feed, vertical tab, form feed, return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The same for bytes: which of them are white space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and all is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as Parquet (with the writer's options) below the shared folder and reads it back: lineage ends here, so a
    lost executor costs a reread and not a recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_bytes(staged: DataFrame) -> int:
    """Bytes on disk of a staged table: a measured size, on which a broadcast may be decided."""
    jvm, conf = staged.sparkSession._jvm, staged.sparkSession._jsc.hadoopConfiguration()
    total = 0
    for name in staged.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def discard(staged: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    jvm, conf = staged.sparkSession._jvm, staged.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
