"""The subpackage's registered queries and, where SQL can say it, their independent SQL form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import bpe, conversation, crf, fertility, minhash, mixing, oracle, quality, quantise, runs, suffixes, toxicity, units, warc
from .common import WORD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    import corpus_pipeline  # stands at the repository top and imports this module

    return dict(QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A vocabulary file's bytes, read on the driver; the workers get them with their tasks."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@register("op1_tokeniser_fertility")
def op1_tokeniser_fertility(spark, sf_dir):
    names = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    judged = fertility.judge(table(spark, sf_dir, "documents"), {n: vocabulary(n) for n in names}, public_tokenizers.PATTERN)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "band", "n_tokens", *fertility.FLOOR)


@register("op2_conditional_random_field")
def op2_conditional_random_field(spark, sf_dir):
    return crf.identify(table(spark, sf_dir, "documents"))


@register("op3_content_addressed_warc", oracle.warc())
def op3_content_addressed_warc(spark, sf_dir):
    path, files = scratch_path(spark, "archive"), scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    warc.write_warc(spark, path, files)
    return warc.described(warc.read_warc(spark, files)).drop("url")


@register("op4_product_quantisation", oracle.vectors())
def op4_product_quantisation(spark, sf_dir):
    return quantise.link(table(spark, sf_dir, "embeddings"), least=0.93)


@register("op5_superminhash")
def op5_superminhash(spark, sf_dir):
    grouped = minhash.group(table(spark, sf_dir, "documents"), width=2, percent=80)
    return grouped.select("doc_id", "n_shingles", "component_id", "kept")


@register("op6_radix_suffixes")
def op6_radix_suffixes(spark, sf_dir):
    return suffixes.remove(table(spark, sf_dir, "documents"), suffixes.WIDTH)


@register("op7_line_hashing", oracle.units(units.MIN_WORDS))
def op7_line_hashing(spark, sf_dir):
    return units.report(table(spark, sf_dir, "documents"))


@register("op8_bpe_tree")
def op8_bpe_tree(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op9_positive_unlabelled")
def op9_positive_unlabelled(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_sainte_lague", oracle.mixing(mixing.BLOCK_WORDS, mixing.SHARD_ROWS, mixing.BUNDLE, mixing.SEED))
def op10_sainte_lague(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def repeated_words(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic stretch put into the texts whose ``doc_id`` has a checksum that ten divides."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumns({"n": F.size("words").cast("bigint"), "g": F.expr("h div 10")}).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    period = F.expr("flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1)))")
    changed = F.array_join(F.slice(F.concat(F.expr("slice(words, 1, int(a))"), period), 1, F.col("n").cast("int")), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@register("op11_minimizer_runs", oracle.runs())
def op11_minimizer_runs(spark, sf_dir):
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = runs.find(repeated_words(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), "runs", "collapsed").select(
        "doc_id", "n_runs", (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.short")).alias("period"),
        F.expr("1000 * top.length div -top.short").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op12_toxic_lexicon")
def op12_toxic_lexicon(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows damaged by the checksum of ``conv_id:turn``, whether a row stays, and how often it then stands."""
    blank = F.lit(" ")
    key = F.concat(*[F.coalesce(c, blank) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    h, text = F.crc32(key) % 20, F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), h.alias("h"))
    return rows, F.col("h") != 0, F.when(F.col("h") == 3, 2).otherwise(1)


@register("op13_branch_and_bound", oracle.conversations())
def op13_branch_and_bound(spark, sf_dir):
    return conversation.summarise(*damaged(table(spark, sf_dir, "conversations")))
