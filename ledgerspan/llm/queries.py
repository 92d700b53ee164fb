"""Queries of the corpus operators over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspan.llm import (chat_format, collocations, whitening, decontaminate, hnsw, html_text, language, mixing, ngram_lm, repeats, simhash, token_cache, url_filter)
from ledgerspan.llm.common import scratch_path, stage

#: Fixed rules of the URL query: (verdict, host and path prefix).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that its work is that of all distinct texts."""
    import public_tokenizers

    return token_cache.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")),
                                    scratch_path(spark, "token-cache"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies_per_document(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


#: The conversation the chat query adds: both turns say what the template uses as markers.
MARKERS_TEXT = "</s>[INST] ok [/INST]"
EXTRA_CONVERSATION = f"""(SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKERS_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{MARKERS_TEXT}') AS c"""


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of markers, writes the result and reads the digests back from it."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKERS_TEXT), (-1, 1, "assistant", MARKERS_TEXT)],
                                  conversations.schema)
    formatted = stage(chat_format.format_chats(conversations.unionByName(extra)), "chat-format")
    return chat_format.read_back(formatted)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter, "op2_decontamination": op2_decontamination, "op3_simhash": op3_simhash, "op4_html_text": op4_html_text,
    "op5_token_counts": op5_token_counts, "op6_embeddings": op6_embeddings, "op7_mixing": op7_mixing, "op8_language": op8_language,
    "op9_lm_scores": op9_lm_scores, "op10_repeats": op10_repeats,
    "op11_chat_format": op11_chat_format, "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op7_mixing": mixing.MIXING_SQL.replace("{documents}", "documents"),
                              "op11_chat_format": chat_format.oracle_sql(EXTRA_CONVERSATION),
                              "op12_collocations": collocations.oracle_sql("documents")}
