"""Stages of the corpus pipeline; each works on all that its predecessor kept and returns the columns of documents, the last one packed pieces."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import langid, packing, secret_scan, simhash, substring_dedup
from turnstone.llm.scratch import Scratch


def with_text(rows: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The documents in rows' struct _row with another text and n_chars, its length; a column that documents lack isn't added."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or with none that holds half of their letters, go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash class the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from the texts; a document of which nothing is left goes. Other texts stay as they are."""
    found = substring_dedup.remove_repeats(docs.select(F.struct("*").alias("_row"), "text"))
    left = found.where("n_removed = 0 OR n_removed < n_words")
    return with_text(left, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    found = secret_scan.redact(docs.select(F.struct("*").alias("_row"), "text"))
    return with_text(found, F.col("text"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("redact_secrets", redact_secrets),
    ("pack_sequences", pack_sequences),
]

#: SQL has neither the learned model, XXH64, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
