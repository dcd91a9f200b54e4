"""Ordinal codes: the rank of a value among the sorted distinct values of its column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

RANK_IN_ONE_TASK = 100_000  # distinct values that may be ranked in one task
BROADCAST_BYTES = 64 << 20  # size of all dictionaries together that may be broadcast
KEY_BYTES = 32  # values up to this size are their own key in a join
NULL_SALTS = 1009  # over so many keys missing values are spread in a shuffled join


def rank_values(values: DataFrame) -> DataFrame:
    """``(at, value)`` distinct rows plus ``code``, the 0-based rank of a value within its ``at``.

    Large sets are ranked in parallel: ranges of values are numbered on their own and shifted by
    the sizes of the ranges before them.
    """
    values = stage(values)
    return _ranked(values, _sizes(values))


def _sizes(values: DataFrame) -> dict[int, tuple[int, int]]:
    """Values and bytes per ``at``."""
    return {r["at"]: (r["n"], r["bytes"]) for r in values.groupBy("at").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes")).collect()}


def _ranked(values: DataFrame, sizes: dict[int, tuple[int, int]], kept: Column | None = None) -> DataFrame:
    """``(at, value, code)``; ``kept`` replaces the values once they are sorted."""
    kept = (F.col("value") if kept is None else kept).alias("value")
    if sum(n for n, _ in sizes.values()) <= RANK_IN_ONE_TASK and sum(b for _, b in sizes.values()) <= BROADCAST_BYTES:
        return values.withColumn("code", F.row_number().over(Window.partitionBy("at").orderBy("value")) - 1).select("at", kept, "code")
    # A partition holds one range in order, so the ids that grow within it number its values, and values move only once.
    ranged = stage(values.repartitionByRange("at", "value").sortWithinPartitions("at", "value").select(
        "at", kept, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = ranged.groupBy("at", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("at", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (ranged.join(F.broadcast(starts), ["at", "part"])
            .select("at", "value", (F.col("start") + F.col("place") - F.col("first")).alias("code")))


def value_counts(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """``(at, value, n)``: rows per text value of each expression, by its position; missing values stay out."""
    entries = F.array(*[F.struct(F.lit(i).alias("at"), v.alias("value")) for i, v in enumerate(values.values())])
    return (df.select(F.explode(entries).alias("e")).where("e.value is not null")
            .groupBy("e.at", "e.value").agg(F.count("*").alias("n")))


def value_key(value: Column) -> Column:
    """What stands for a text value in a join: itself if short, else its SHA-256 in hex, which is longer than any short value."""
    return F.when(F.octet_length(value) <= KEY_BYTES, value).otherwise(F.sha2(value, 256))


def ordinal_codes(df: DataFrame, values: Mapping[str, Column], missing: int = -1, distinct: DataFrame | None = None) -> DataFrame:
    """Replace columns by the codes of the given text expressions; NULL gets ``missing``.

    Codes are kept and joined by ``value_key``, so long values move only while they are counted and ranked.
    ``distinct`` is the stored table ``(at, value)`` of their values, if it is known.
    """
    names = list(values)
    keyed = df.withColumns({f"__t{i}": value_key(values[n]) for i, n in enumerate(names)})
    if distinct is None:
        distinct = stage(value_counts(df, values).select("at", "value"))
    sizes = _sizes(distinct)
    codes, left = stage(_ranked(distinct, sizes, value_key(F.col("value")))), BROADCAST_BYTES
    for i in sorted(range(len(names)), key=lambda i: sizes.get(i, (0, 0))[1]):
        one = codes.where(F.col("at") == i).select(F.col("value").alias(f"__t{i}"), F.col("code").alias(f"__c{i}"))
        left -= sizes.get(i, (0, 0))[1]
        if left >= 0:
            keyed = keyed.join(F.broadcast(one), f"__t{i}", "left")
        else:  # both sides are plain, so Spark can split a hot value; missing values match nothing and are spread
            salt = F.when(F.col(f"__t{i}").isNull(), F.monotonically_increasing_id() % NULL_SALTS).otherwise(0)
            keyed = keyed.withColumn("__s", salt).join(one.withColumn("__s", F.lit(0).cast("bigint")), [f"__t{i}", "__s"], "left").drop("__s")
    at = {n: i for i, n in enumerate(names)}
    return keyed.select(*[
        F.coalesce(F.col(f"__c{at[n]}"), F.lit(missing)).cast("bigint").alias(n) if n in at
        else F.col("`" + n.replace("`", "``") + "`") for n in df.columns])
