"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Every source has a target number of words: a share of the whole by weight, never more than ``max_repeats`` times what it
has, the excess shared again among the others. Targets are turned into whole blocks of equally many words: each block
goes to the source with the highest quotient ``target / (2 * blocks so far + 1)``. A source's blocks go on to its shards
(about ``SHARD_ROWS`` documents each, drawn by a seeded digest of ``doc_id``) in the same way, over bundles of shards so
that no window holds many rows. Within a shard, documents stand in seeded order and form a stream of words; the
first blocks of the stream are taken, again from its start where a shard's quota exceeds its words.

At scale: the text is read for its word count only; what is shuffled is a short row per document. A source of any size
is spread over its shards. The only tables ordered as a whole have one row per source. The quotients that are sorted are
only those around the last block given, at most a few per party, because all higher ones are certain to win.

Missing text has size 0 and is never taken; a missing source is a source of its own, last in order. Repeated rows share
one draw, ties go by size. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import WORD

#: Documents to a shard, on average over all sources; shards to a bundle.
SHARD_ROWS, BUNDLE = 500, 1000
#: Words to a block.
BLOCK_WORDS = 16
SEED = "mix"

SOURCE = ["known", "name"]


def sizes(documents: DataFrame, seed: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row per document: its source, its number of words and its draw."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return documents.select(
        "doc_id", *[F.col(c).alias(f"kept_{c}") for c in keep],
        F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), identity)).alias("draw"))


def targets(sized: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """``known, name, place, source_size, all_words, target``: a row per source.

    Sources stand by how soon they reach their limit; the first for which the level of all later ones is lower
    than its own limit ends the run of limited sources.
    """
    by_name = Window.orderBy(F.desc("known"), "name")
    everything = Window.partitionBy()
    sources = (sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
               .withColumn("place", F.row_number().over(by_name) - 1)
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                  (F.col("place") % len(weights) + 1).cast("int")).cast("bigint"))
               .withColumn("all_words", F.sum("source_size").over(everything)))
    limit = F.col("source_size") * max_repeats
    order = Window.orderBy(limit / F.col("weight"), "place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = (sources
              .withColumn("left_words", F.col("all_words") * F.lit(float(share))
                          - F.coalesce(F.sum(limit).over(earlier), F.lit(0)))
              .withColumn("left_weight", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
              .withColumn("open", limit * F.col("left_weight") > F.col("left_words") * F.col("weight")))
    first = F.min(F.when(F.col("open"), F.struct(limit / F.col("weight"), "place", "left_words", "left_weight"))).over(everything)
    held = F.col("first").isNull() | (F.struct(limit / F.col("weight"), "place") < F.struct("first.col1", "first.place"))
    return (filled.withColumn("first", first)
            .select(*SOURCE, "place", "source_size", "all_words",
                    F.when(held, limit.cast("double"))
                    .otherwise(F.col("first.left_words") * F.col("weight") / F.col("first.left_weight")).alias("target")))


def apportion(parties: DataFrame, group: Sequence[str], weight: str, seats: str, order: Sequence[str]) -> DataFrame:
    """Sainte-Lague: ``parties`` with ``quota``, whole seats that add up to ``seats`` in each group.

    ``weight`` and ``seats`` are columns, ``seats`` the same throughout a group. Equal quotients go by ``order``.
    With n parties, seats up to ``weight * (seats - n/2) / all + 1/2`` are certain and those beyond
    ``weight * (seats + n/2) / all + 1/2`` hopeless; only the quotients in between are ranked.
    """
    within = Window.partitionBy(*group)
    share = F.when(F.col("all_weight") > 0, F.col(weight) / F.col("all_weight")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("n") / 2) - F.lit(0.5)))
    high = F.ceil(share * (F.col(seats) + F.col("n") / 2) + F.lit(1.5))
    bounds = (parties.withColumn("n", F.count("*").over(within)).withColumn("all_weight", F.sum(weight).over(within))
              .withColumn("sure", F.when(F.col(weight) > 0, low).otherwise(F.lit(0)).cast("bigint"))
              .withColumn("high", F.when(F.col(weight) > 0, high).otherwise(F.lit(0)).cast("bigint")))
    open_seats = F.col(seats) - F.sum("sure").over(within)
    quotients = (bounds.withColumn("open_seats", open_seats)
                 .withColumn("seat", F.explode(F.sequence(F.col("sure"), F.greatest("sure", "high"))))
                 .withColumn("quotient", F.col(weight) / (2 * F.col("seat") + 1)))
    ranked = quotients.withColumn("rank", F.row_number().over(within.orderBy(F.desc("quotient"), *order, "seat")))
    won = F.sum(((F.col("rank") <= F.col("open_seats")) & (F.col(weight) > 0)).cast("bigint"))
    columns = parties.columns
    return (ranked.groupBy(*columns, "sure").agg(won.alias("won"))
            .select(*columns, (F.col("sure") + F.col("won")).alias("quota")))


def _filled(quotas: DataFrame) -> DataFrame:
    """``quotas`` (with ``words``, ``room`` and the source's ``source_words``) with the words that shards could not give added to others.

    Bundles first, then the shards within each.
    """
    bundle = [*SOURCE, "bundle"]
    earlier = lambda group, order: F.coalesce(F.sum("room").over(
        Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = lambda surplus, before: F.greatest(F.lit(0), F.least("room", surplus - before))
    surplus = F.col("source_words") - F.sum("words").over(Window.partitionBy(*SOURCE))
    extra = (quotas.groupBy(*bundle, "source_words").agg(F.sum("words").alias("words"), F.sum("room").alias("room"))
             .select(*bundle, share(surplus, earlier(SOURCE, "bundle")).alias("extra")))
    return quotas.join(extra, bundle).withColumn("words", F.col("words") + share(F.col("extra"), earlier(bundle, "shard")))


def mix(documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2,
        block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED,
        keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document, and the columns of ``keep`` as ``kept_...``.

    ``weights`` belong to the sources in the order of their code points, repeated as often as needed; together the
    sources are to give ``share`` times all words. ``taken`` counts words with their repeats; a document gives
    whole copies of its ``size`` words and, once per shard, the beginning of one.
    """
    sized = stage(sizes(documents, seed))
    shards = max(1, -(-sized.count() // shard_rows))
    shard: Column = (F.conv(F.substring("draw", 1, 12), 16, 10).cast("bigint") % shards).cast("bigint")

    sources = targets(sized, weights, share, max_repeats)
    blocks = F.floor(F.col("all_words") * F.lit(float(share)) / block_words + F.lit(0.5)).cast("bigint")
    sources = stage(apportion(sources.withColumn("seats", blocks), [], "target", "seats", ["place"])
                    .drop("seats").withColumnRenamed("quota", "source_quota"))
    held = stage(sized.groupBy(*SOURCE, shard.alias("shard")).agg(F.sum("size").alias("shard_size"))
                 .withColumn("bundle", F.floor(F.col("shard") / BUNDLE)))
    bundles = held.groupBy(*SOURCE, "bundle").agg(F.sum("shard_size").alias("bundle_size"))
    bundles = apportion(bundles.join(sources.select(*SOURCE, "source_quota"), SOURCE), SOURCE, "bundle_size",
                        "source_quota", ["bundle"]).select(*SOURCE, "bundle", F.col("quota").alias("bundle_quota"))
    quotas = (apportion(held.join(bundles, [*SOURCE, "bundle"]), [*SOURCE, "bundle"], "shard_size", "bundle_quota", ["shard"])
              .join(sources.select(*SOURCE, "source_quota", "source_size", "target"), SOURCE)
              .withColumn("source_words", F.least(F.col("source_quota") * block_words, F.col("source_size") * max_repeats))
              .withColumn("words", F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeats))
              .withColumn("room", F.col("shard_size") * max_repeats - F.col("words")))
    quotas = _filled(stage(quotas)).select(*SOURCE, "shard", "shard_size", "source_size", "target", "words")

    rows = (sizes(documents, seed, keep) if keep else sized).withColumn("shard", shard)
    stream = Window.partitionBy(*SOURCE, "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("words") - whole * F.col("shard_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("start")))
    return rows.join(quotas, [*SOURCE, "shard"]).select(
        "doc_id", *[f"kept_{c}" for c in keep], "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(documents: DataFrame, **params) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    A partial copy is the text up to its last word taken. Documents of which nothing is taken are gone.
    """
    columns = documents.columns
    mixed = mix(documents, keep=columns, **params)
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy")
    words_left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    units = F.regexp_extract_all("kept_text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(words_left >= F.col("size"), F.col("kept_text")).otherwise(
        F.array_join(F.slice(units, F.lit(1), F.greatest(words_left, F.lit(1)).cast("int")), ""))
    out = mixed.where(F.col("taken") > 0).select("*", copies)
    return out.select(*[text.alias(c) if c == "text" else F.col(f"kept_{c}").alias(c) for c in columns])
