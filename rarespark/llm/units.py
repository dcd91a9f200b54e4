"""Substring dedup by hashing runs of lines or paragraphs.

A text is cut into units: lines, and these after each sentence (``sentence``, the default); lines (``line``); or paragraphs. Single short
units repeat by chance, and a passage put into another text seldom fills whole lines, so what is hashed is a run: from each unit on the
fewest units that hold ``min_words`` words, normalised (lower case, white space as one blank). Of all runs with one digest the earliest stays, by ``doc_id``
(missing last), then text digest, then place in the text; the units of the others are removed. So a repeated passage goes, up to
the units at its ends that it shares with other words, and a repeated title or licence line stays. What is removed keeps its
offsets in the original text, and a removed unit always stands in some text that keeps it.

At scale: texts are cut and hashed in Arrow batches, in one pass over every text. Digests are grouped with partial sums, so a run that stands in
a third of all texts costs a record per task. The repeated digests go back to the runs as a bitmap of fixed size, so no join
makes a row for each of them; a join only returns the few runs that the bitmap takes for repeated by mistake, and these and the
first of each digest are spared. Texts are shuffled once, beside the numbers of their removed units; those that lose any are cut in Arrow batches.

Missing texts count as empty; rows with equal ``doc_id`` and text count as one document and lose the same units; a text of fewer words than a
run loses nothing. An empty table gives an empty result; other columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage, unstage
from .common import bitmap, chunks, in_bitmap

#: Words that a run must hold.
MIN_WORDS = 20
#: Units with all that separates them from the next; a sentence also ends where its line does.
CUTS = {"sentence": r"(?:[^\n.!?]+|[.!?]+[^\x20\x09-\x0D.!?])*(?:[.!?]*[\x20\x09-\x0D]+|[.!?]+|\Z)",
        "line": r"[^\n]*(?:\n|\Z)", "paragraph": r"(?:[^\n]+|\n(?!\n))*(?:\n+|\Z)"}
SPANS = "array<struct<start:bigint,end:bigint>>"
#: Bits of the bitmap that tells repeated digests; two may share one, which only costs work.
BITMAP = 1 << 26
RUNS = "doc_id {}, __key string, unit int, stop int, digest binary, spot bigint"


def cut_units(text: str, unit: str) -> list[str]:
    return [u for u in re.findall(CUTS[unit], text) if u]


def runs_of(units: list[str], min_words: int) -> list[tuple[int, int, bytes]]:
    """First unit, unit after the last, and digest of every run."""
    words, ends = [], []
    for u in units:
        # bytes.split() cuts at the six separators of WORD.
        words += u.lower().encode().split()
        ends.append(len(words))
    out, stop = [], 0
    for i in range(len(units)):
        start = ends[i - 1] if i else 0
        if ends[i] == start:
            continue  # a run begins with a word
        while stop < len(units) and ends[stop] - start < min_words:
            stop += 1
        if stop == len(units):
            break
        out.append((i, stop + 1, hashlib.blake2b(b" ".join(words[start:ends[stop]]), digest_size=16).digest()))
    return out


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(text))
    return documents.select(*[c for c in documents.columns if c != "text"], text.alias("text"), key.alias("__key"))


def _hasher(unit: str, min_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows, first, stop, digest = [], [], [], []
            for at, text in enumerate(batch.column("text")):
                for i, j, d in runs_of(cut_units(text.as_py(), unit), min_words):
                    rows.append(at)
                    first.append(i)
                    stop.append(j)
                    digest.append(d)
            at = pa.array(rows, pa.int64())
            spot = np.frombuffer(b"".join(digest), dtype=np.int64)[::2]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("__key").take(at), pa.array(first, pa.int32()),
                                              pa.array(stop, pa.int32()), pa.array(digest, pa.binary()), pa.array(spot)],
                                             names=["doc_id", "__key", "unit", "stop", "digest", "spot"])
    return work


def removed_units(keyed: DataFrame, unit: str, min_words: int) -> DataFrame:
    """``__key, __gone``: the units that each document loses, as pairs of first and end, for documents that lose any."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__key", "unit")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    runs = stage(keyed.select("doc_id", "__key", "text").mapInArrow(_hasher(unit, min_words), RUNS.format(kind)))
    first = stage(runs.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("spot").alias("spot"))
                  .where("first < last").select("digest", "spot", F.col("first.__key").alias("__key"), F.col("first.unit").alias("unit")))
    sent = keyed.sparkSession.sparkContext.broadcast(bitmap(first, "spot", BITMAP))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.filter(pa.array(in_bitmap(sent.value, batch.column("spot").to_numpy())))
            if hit.num_rows:
                yield hit.select(["__key", "unit", "stop", "digest"])

    repeated = stage(runs.select("__key", "unit", "stop", "digest", "spot").mapInArrow(marked, "__key string, unit int, stop int, digest binary"))
    mistaken = repeated.join(first.select("digest"), "digest", "left_anti")
    spared = first.select("__key", "unit").unionByName(mistaken.select("__key", "unit"))
    every = repeated.select("__key", "unit", "stop").unionByName(spared.withColumn("stop", F.lit(None).cast("int")))
    # A run is told by its first unit; one that is spared also stands without an end.
    gone = every.groupBy("__key", "unit").agg(F.max("stop").alias("stop"), F.count("*").alias("rows"), F.count("stop").alias("runs")).where("rows = runs")
    out = stage(gone.groupBy("__key").agg(F.collect_list(F.struct("unit", "stop")).alias("__gone")))
    unstage(runs, first, repeated)
    return out


def _cutter(unit: str):
    """What stays of a text without the units of the given runs, and the offsets of what goes, in time linear in its units."""
    def work(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for whole, runs in zip(text, gone):
            if not whole.is_valid:
                out.append(None)
                continue
            units = cut_units(whole.as_py(), unit)
            cover = np.zeros(len(units) + 1, dtype=np.int64)
            for run in runs.as_py():
                cover[run["unit"]] += 1
                cover[run["stop"]] -= 1
            cover = np.cumsum(cover)
            left, spans, at = [], [], 0
            for u, covered in zip(units, cover):
                if not covered:
                    left.append(u)
                elif spans and spans[-1]["end"] == at:
                    spans[-1]["end"] = at + len(u)
                else:
                    spans.append({"start": at, "end": at + len(u)})
                at += len(u)
            out.append({"text": "".join(left), "removed": spans, "units": int((cover[:-1] > 0).sum())})
        return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                        ("units", pa.int64())]))
    return F.arrow_udf(work, f"struct<text:string,removed:{SPANS},units:bigint>")


def dedup(documents: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with ``text`` cut down to what stays.

    Two more columns: ``n_removed``, the number of units that go, and ``removed``, an array of ``start`` and ``end`` in characters of the original
    text, units that adjoin as one.
    """
    columns = documents.columns
    keyed = _keyed(documents)
    joined = keyed.join(removed_units(keyed, unit, min_words), "__key", "left")
    touched = F.col("__gone").isNotNull()
    # Texts that lose nothing do not travel to Python.
    cut_down = joined.withColumn("__left", _cutter(unit)(F.when(touched, F.col("text")), F.col("__gone")))
    none = F.array().cast(SPANS)
    return cut_down.select(
        *[(F.when(touched, F.col("__left.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in columns
          if c not in ("n_removed", "removed")],
        F.coalesce(F.col("__left.units"), F.lit(0)).cast("bigint").alias("n_removed"), F.when(touched, F.col("__left.removed")).otherwise(none).alias("removed"))


def dedup_text(documents: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their own columns only, whatever these are called, and ``text`` cut down to what stays."""
    packed = documents.select("doc_id", "text", F.struct("*").alias("row"))
    out = dedup(packed, unit, min_words)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def report(documents: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_removed, removed_spans`` (as ``start:end``, by place) and ``kept_text``."""
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), " ")
    return dedup(documents.select("doc_id", "text"), unit, min_words).select(
        "doc_id", "n_removed", spans.alias("removed_spans"), F.col("text").alias("kept_text"))
