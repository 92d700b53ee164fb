"""Token counts through a digest cache (operator 5)."""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Texts encoded at once; bounds the ids held in a task.
TEXTS_AT_ONCE = 128


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and of the name and version of the library that reads it: a new release of
    the library may split texts otherwise, so its counts are kept apart."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode())
    with open(path, "rb") as file:
        for chunk in iter(lambda: file.read(1 << 20), b""):
            digest.update(chunk)
    return digest.hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens as the vocabulary file's own library does, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encode_misses(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(path)
            texts, found = batch.column("text"), []
            for begin in range(0, len(texts), TEXTS_AT_ONCE):
                found += count(texts.slice(begin, TEXTS_AT_ONCE).to_pylist())
            yield pa.record_batch([batch.column("digest").cast(pa.binary()), pa.array([version] * len(found), pa.string()),
                                   pa.array(found, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return encode


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version. Rows appended twice, as by two jobs at a time, count once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    return cached.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of docs (doc_id, text).

    Content and tokenizer file are known by their SHA-256. Digests that the cache lacks are reduced to one row
    each (a partial aggregate, so thousands of copies meet as one row per task); only those texts travel, dealt by
    (doc_id, digest), are encoded, and their counts are appended to the cache in one commit. A job that dies
    before the commit leaves the cache as it was.

    Null text counts as empty, a null doc_id is kept, repeated rows each get a row (rows with the same doc_id and
    text are also encoded each), an empty table gives an empty result; further columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    digests = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    misses = first.join(read_cache(spark, cache_path, version), "digest", "left_anti")
    wanted = keyed.join(misses, (keyed["digest"] == misses["digest"]) & keyed["doc_id"].eqNullSafe(misses["first_id"]),
                        "left_semi").select("digest", "text")
    wanted.mapInArrow(encode_misses(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return digests.join(read_cache(spark, cache_path, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
