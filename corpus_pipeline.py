"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns a row per document of the mix with its tokens. ``run`` stores every stage's result in the shared
folder and reads it back for the next.

Missing texts count as empty, extra columns pass through to the last stage, an empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rarespark.llm import bpe, minhash, mixing, quality, units  # noqa: E402
from rarespark.llm.registry import table, vocabulary  # noqa: E402
from rarespark.session import scratch_path  # noqa: E402


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five words from a similarity of 0.8 on: one document of each group stays."""
    return minhash.keep_one(docs, width=5, percent=80)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: of runs of lines and sentences that repeat, the earliest stays; ``n_chars`` follows the text."""
    return with_length(units.dedup_text(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a row for each copy that the mix takes."""
    return with_length(mixing.mixed_documents(docs), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every document of the mix, and the digests of ids and decoded bytes."""
    return bpe.encode_checked(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def with_length(out: DataFrame, like: DataFrame) -> DataFrame:
    length = F.length("text").cast(like.schema["n_chars"].dataType) if "n_chars" in like.columns else None
    return out.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns])


STAGES = [("quality_classifier", classify), ("minhash_near_dedup", near_duplicates), ("line_dedup", repeated_lines),
          ("source_mix", mix), ("bpe_tokens", tokens)]

#: SQL cannot express training, signatures and token merges; tests/llm/test_pipeline.py holds every stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
