"""Helpers shared by the text operators: batches of whole texts, words and hashes as NumPy arrays."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, in every operator that counts words (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a worker looks at together. One longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (missing: empty) and the columns of ``more``; all other columns stay behind."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def held_out(remainder: int, modulus: int) -> Column:
    """True for documents kept out of training; an unknown ``doc_id`` is neither held out nor trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object together with the code of its class, so that workers need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    """The object of ``send``, made once per task."""
    if "made" not in sent.__dict__:
        sent.__dict__["made"] = pickle.loads(sent.value)
    return sent.__dict__["made"]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the texts of ``column`` reach about ``limit`` bytes."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and where each text starts (one more: the end)."""
    raw = texts.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else \
        np.zeros(1, dtype=np.int64)
    data = raw.buffers()[2] if len(raw) else None
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray,
               separators: np.ndarray = _SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = inside & (first[:-1] | np.concatenate([[True], ~inside[:-1]])) if len(data) else inside
    ends = inside & (first[1:] | np.concatenate([~inside[1:], [True]])) if len(data) else inside
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(offsets, at, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a published finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; the order counts."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span, eight bytes a step."""
    eights, left = eight_bytes(data), ends - starts
    out = mix(left.astype(np.uint64))
    todo, at = np.arange(len(starts)), starts
    while len(todo):
        n = left[todo]
        keep = np.where(n >= 8, np.uint64(0), (8 - np.minimum(n, 8)).astype(np.uint64) * np.uint64(8))
        value = (eights[at] << keep) >> keep
        value[n <= 0] = 0
        out[todo] = combine(out[todo], value)
        more = n > 8
        todo, at = todo[more], at[more] + 8
        left[todo] -= 8
    return out


def sums(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """Sum of ``values`` by group number, as whole numbers."""
    return np.bincount(groups, weights=values, minlength=count).astype(np.int64)


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size in which the values of a column of hashes are marked.

    At most ``bits / 8`` bytes come to the driver, whatever the number of rows.
    """
    value = F.col(column).cast("bigint")
    spot = F.pmod(value.bitwiseXOR(F.shiftright(value, 29)), F.lit(bits)) + 1  # bitmaps count from one
    parts = rows.select(spot.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
    for r in parts:
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_bitmap(marked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values may be among those of ``bitmap``; never false for one that is."""
    v = values.astype(np.int64) if values.dtype != np.uint64 else values.view(np.int64)
    at = (v ^ (v >> np.int64(29))) % np.int64(len(marked) * 8)
    return (marked[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)
