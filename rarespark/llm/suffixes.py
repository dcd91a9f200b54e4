"""Repeated byte windows by depth-limited radix sort of suffixes.

A window of ``width`` bytes is the part of a suffix that counts. Windows are sorted by digits, most significant first;
after each pass a window goes on only while others share all its digits so far, and after the last digit equal
windows are exactly those in one group. Windows are not moved one by one: a window's first digit is its *anchor*, the least-hashed
short gram in it, with the window's place relative to it. Neighbouring windows share their anchor, so a whole *block* of
windows sorts as one row, about one per 85 bytes.

1. First digit: the anchor gram. Blocks that are alone with theirs hold no repeated window. If all blocks of an anchor are equal
   byte for byte, all their windows repeat.
2. Second digit, for blocks whose anchor has unlike blocks: the bytes common to each ``STEP`` neighbouring windows.
3. Last digit, for windows whose steps are unlike: the whole window.

In every pass, rows that are equal as a whole are settled at once. The result is exact: digits are compared by 64-bit hashes, equal
windows by 128 bits.

Of rows that are equal as a whole, one goes on to the next digit for all.

At scale: texts are read for each pass and moved only at the end, and then only those that lose bytes. A pass counts its digits with
partial sums, so that a passage in a third of all texts costs a record per task; counts are stored and joined to the rows from two
plain scans, whose hot keys Spark splits. Which texts and rows go on is told to the next reading by bitmaps of fixed size;
beyond their capacity more rows than necessary go on, and the joins sort them out.

Missing texts count as empty. Equal rows are separate texts, so all their windows repeat. A row is told by ``doc_id`` and text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage, unstage
from .common import bitmap, chunks, combine, eight_bytes, in_bitmap, mix, text_bytes, texts

WIDTH = 200
#: Neighbouring windows that share a second digit.
STEP = 8
CHUNK_BYTES = 2 << 20
#: Bits of the bitmaps.
BITMAP = 1 << 26

SPAN = ["doc", "part", "start", "stop"]
ROWS = "level int, key bigint, whole bigint, doc bigint, part int, start int, stop int, n int"


def blocks(column: pa.Array, width: int) -> dict[str, np.ndarray]:
    """Blocks of windows with one anchor: text number, anchor, first window, number of windows, anchor hash."""
    data, offsets = text_bytes(column)
    gram = 8 * max(1, min(4, width // 16))
    reach = width - gram + 1  # grams in a window
    grams = len(data) - gram + 1
    lengths = np.diff(offsets)
    none = np.empty(0, dtype=np.int64)
    if not (lengths >= width).any():
        return {"doc": none, "anchor": none, "first": none, "count": none, "hash": np.empty(0, np.uint64), "data": data, "offsets": offsets}
    eights = eight_bytes(data)
    h = np.zeros(grams, dtype=np.uint64)
    for i in range(0, gram, 8):
        h += eights[i:i + grams]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = mix(h)
    # Hash above, place below: the least is the leftmost of the least-hashed grams.
    bits = np.uint64(max(1, int(grams).bit_length()))
    keyed = np.full(-(-grams // reach) * reach, np.iinfo(np.uint64).max, dtype=np.uint64)
    keyed[:grams] = (h >> bits << bits) | np.arange(grams, dtype=np.uint64)
    rows = keyed.reshape(-1, reach)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.maximum(lengths - width + 1, 0)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - offsets[:-1], windows)
    anchors = (np.minimum(after[at], before[at + reach - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    first = at[new]
    return {"doc": np.searchsorted(offsets, first, "right") - 1, "anchor": anchors[new], "first": first,
            "count": np.diff(np.concatenate([new, [len(at)]])), "hash": h[anchors[new]], "data": data, "offsets": offsets}


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b], s) for a, b, s in zip(starts.tolist(), stops.tolist(), seeds.tolist())), dtype=np.uint64, count=len(starts))


def _first(b: dict, width: int) -> dict[str, np.ndarray]:
    """First digits: a row per block; equal blocks in a row, as periodic text has them, are one row with their number."""
    stop = b["first"] + b["count"] - 1 + width
    whole = _hashes(b["data"], b["first"], stop, (b["anchor"] - b["first"]) * 65536 + b["count"])
    same = np.zeros(len(whole), dtype=bool)
    same[1:] = (whole[1:] == whole[:-1]) & (b["hash"][1:] == b["hash"][:-1]) & (b["doc"][1:] == b["doc"][:-1])
    same[1:] &= b["first"][1:] == b["first"][:-1] + b["count"][:-1]  # blocks between them may have been filtered out
    head = np.flatnonzero(~same)
    last = np.concatenate([head[1:], [len(same)]]) - 1 if len(head) else head
    return {"level": np.ones(len(head), np.int32), "key": b["hash"][head], "whole": whole[head], "doc": b["doc"][head], "start": b["first"][head],
            "stop": stop[last], "n": last - head + 1, "block": head}


def _second(b: dict, width: int, chosen: np.ndarray) -> dict[str, np.ndarray]:
    """Second digits of the blocks ``chosen``: a row per step of windows."""
    high = (b["anchor"] - b["first"])[chosen]
    low = high - b["count"][chosen] + 1
    many = high // STEP - low // STEP + 1
    block = np.repeat(np.arange(len(chosen)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low // STEP, many)
    low, high, anchor = np.maximum(low[block], step * STEP), np.minimum(high[block], step * STEP + STEP - 1), b["anchor"][chosen][block]
    common = _hashes(b["data"], anchor - step * STEP, anchor - step * STEP + width - STEP + 1, step)
    whole = _hashes(b["data"], anchor - high, anchor - low + width, low * 65536 + high)
    return {"level": np.full(len(block), 2, np.int32), "key": combine(b["hash"][chosen][block], combine(common, step.astype(np.uint64))), "whole": whole,
            "doc": b["doc"][chosen][block], "start": anchor - high, "stop": anchor - low + width, "n": np.ones(len(block), np.int64),
            "anchor": anchor, "hash": b["hash"][chosen][block]}


def _third(b: dict, steps: dict, width: int, chosen: np.ndarray) -> dict[str, np.ndarray]:
    """Last digits of the steps ``chosen``: a row per window."""
    begin, many = steps["start"][chosen], (steps["stop"] - steps["start"])[chosen] - width + 1
    row = np.repeat(np.arange(len(chosen)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[row]
    place = (steps["anchor"][chosen][row] - start).astype(np.uint64)
    return {"level": np.full(len(row), 3, np.int32), "key": combine(steps["hash"][chosen][row], place), "whole": _hashes(b["data"], start, start + width, place),
            "doc": steps["doc"][chosen][row], "start": start, "stop": start + width, "n": np.ones(len(row), np.int64)}


def _identity(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A row's ``doc_id`` (missing: 0) and a hash of its text that also tells whether ``doc_id`` is missing."""
    ids = batch.column("doc_id")
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(batch.column("text"))
    part = _hashes(data, offsets[:-1], offsets[1:], missing.astype(np.int64))
    return ids.fill_null(0).to_numpy(), (part >> np.uint64(33)).astype(np.int32)


def _batch(batch: pa.RecordBatch, offsets: np.ndarray, *levels: dict) -> pa.RecordBatch:
    doc, part = _identity(batch)
    join = lambda c: np.concatenate([x[c] for x in levels])
    number = join("doc").astype(np.int64)
    begin = offsets[number]
    columns = [join("level"), join("key").view(np.int64), join("whole").view(np.int64), doc[number], part[number],
               (join("start") - begin).astype(np.int32), (join("stop") - begin).astype(np.int32), join("n").astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ROWS.split(", ")])


def _shared(rows: DataFrame) -> DataFrame:
    """Digits that two or more windows share, and whether their rows are ``unlike``."""
    return stage(rows.groupBy("level", "key").agg(F.sum("n").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
                 .where("n > 1").select("level", "key", (F.col("a") < F.col("b")).alias("unlike")))


def _row_key(key: Column, doc: Column, start: Column) -> Column:
    """A hash of a row, for bitmaps only; ``_row_keys`` gives the same for arrays."""
    return key.bitwiseXOR(F.shiftleft(doc, 20)).bitwiseXOR(F.shiftleft(start.cast("bigint"), 3))


def _row_keys(rows: dict, doc: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    number = rows["doc"].astype(np.int64)
    return rows["key"].view(np.int64) ^ (doc[number] << np.int64(20)) ^ ((rows["start"] - offsets[number]) << np.int64(3))


def _sort(rows: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of the rows that are equal to others as a whole; the rows that go on to the next digit."""
    rows = stage(rows.join(shared, ["level", "key"]))
    at = F.struct("doc", "part", "start")
    twins = stage(rows.where("unlike").groupBy("key", "whole").agg(F.sum("n").alias("m"), F.min(at).alias("one")).where("m > 1").drop("m"))
    judged = stage(rows.where("unlike").join(twins, ["key", "whole"], "left").select("key", *SPAN, "one"))
    spans = stage(rows.where("NOT unlike").select(*SPAN).unionByName(judged.where("one IS NOT NULL").select(*SPAN)))
    open_rows = stage(judged.where(F.col("one").isNull() | (F.col("one") == at)).select("key", "doc", "part", "start"))
    unstage(rows, twins, judged)
    return spans, open_rows


def repeated_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc, part, start, stop``: stored byte spans, together exactly the bytes in repeated windows; spans may overlap."""
    read, send = texts(documents), documents.sparkSession.sparkContext.broadcast

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            b = blocks(batch.column("text"), width)
            yield _batch(batch, b["offsets"], _first(b, width))

    anchors = _shared(read.mapInArrow(first, ROWS).select("level", "key", "whole", "n"))
    some = send(bitmap(anchors, "key", BITMAP))

    def chosen_blocks(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[dict, dict]:
        b = blocks(batch.column("text"), width)
        hit = in_bitmap(wanted, b["hash"])
        b |= {c: b[c][hit] for c in ("doc", "anchor", "first", "count", "hash")}
        return b, _first(b, width)

    def shared_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            b, one = chosen_blocks(batch, some.value)
            yield _batch(batch, b["offsets"], one)

    one, open_blocks = _sort(stage(read.mapInArrow(shared_blocks, ROWS)), anchors)
    marks = lambda rows: (bitmap(rows, "part", BITMAP), bitmap(rows.select(
        _row_key(F.col("key"), F.col("doc"), F.col("start")).alias("row")), "row", BITMAP))
    first_marks = send(marks(open_blocks))

    def open_steps(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, dict, dict]:
        """Second digits of the blocks that go on, of the texts that hold any."""
        some_texts, some_rows = first_marks.value
        doc, part = _identity(batch)
        hit = in_bitmap(some_texts, part.astype(np.int64))
        batch, doc = batch.filter(pa.array(hit)), doc[hit]
        b, one = chosen_blocks(batch, some.value)
        return batch, doc, b, _second(b, width, one["block"][in_bitmap(some_rows, _row_keys(one, doc, b["offsets"]))])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            batch, _, b, two = open_steps(batch)
            yield _batch(batch, b["offsets"], two)

    rows = stage(read.mapInArrow(second, ROWS))
    steps = _shared(rows)
    two, open_rows = _sort(rows, steps)
    second_marks = send(marks(open_rows))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some_texts, some_rows = second_marks.value
        for batch in chunks(batches, limit=CHUNK_BYTES):
            hit = in_bitmap(some_texts, _identity(batch)[1].astype(np.int64))
            batch, doc, b, two = open_steps(batch.filter(pa.array(hit)))
            yield _batch(batch, b["offsets"], _third(b, two, width, np.flatnonzero(in_bitmap(some_rows, _row_keys(two, doc, b["offsets"])))))

    windows = stage(read.mapInArrow(third, ROWS))
    equal = stage(windows.groupBy("key", "whole").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
    out = stage(one.unionByName(two).unionByName(windows.join(equal, ["key", "whole"]).select(*SPAN)))
    unstage(anchors, steps, rows, windows, equal, one, two, open_blocks, open_rows)
    return out


def remove(documents: DataFrame, width: int = WIDTH, with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``with_bytes`` adds ``kept`` and ``spans``.

    ``spans`` holds first byte and end of each maximal removed run, behind each other.
    """
    spans = repeated_spans(documents, width)
    touched = documents.sparkSession.sparkContext.broadcast(bitmap(spans, "part", BITMAP))

    def lighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that lose nothing are settled here and travel without their bytes."""
        for batch in chunks(batches, limit=CHUNK_BYTES):
            doc, part = _identity(batch)
            hit = in_bitmap(touched.value, part.astype(np.int64))
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            whole = [None if h else hashlib.sha256(t).hexdigest() for t, h in zip(raw, hit)]
            text = [t if h or with_bytes else None for t, h in zip(raw, hit)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(doc), pa.array(part), pa.array(map(len, raw), pa.int64()),
                                              pa.array(whole, pa.string()), pa.array(text, pa.binary())],
                                             names=["doc_id", "doc", "part", "n_bytes", "sha", "text"])

    light = texts(documents).mapInArrow(lighten, "doc_id bigint, doc bigint, part int, n_bytes bigint, sha string, text binary")
    # At most as many spans as a text has windows.
    per_text = spans.distinct().groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary, spans array<bigint>" if with_bytes else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            removed, runs, shas, kept, ends = [], [], [], [], []
            for text, sha, found in zip(batch.column("text"), batch.column("sha").to_pylist(), batch.column("runs")):
                data = text.as_buffer() if text.is_valid else b""
                pieces, at, n, edges = [], 0, 0, []
                if found.is_valid and len(found.values):
                    start, stop = (found.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    head = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
                    tail = np.concatenate([head[1:], [len(start)]]) - 1
                    view = memoryview(data)
                    for a, z in zip(start[head].tolist(), stop[tail].tolist()):
                        pieces.append(view[at:a])
                        at, n = z, n + z - a
                        edges += [a, z]
                    pieces.append(view[at:])
                    rest = b"".join(pieces)
                    sha = hashlib.sha256(rest).hexdigest()
                else:
                    rest = bytes(data) if with_bytes else b""
                    sha = sha or hashlib.sha256(data).hexdigest()
                removed.append(n)
                runs.append(len(edges) // 2)
                shas.append(sha)
                kept.append(rest)
                ends.append(edges)
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())]
            columns += [pa.array(kept, pa.binary()), pa.array(ends, pa.list_(pa.int64()))] if with_bytes else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][:len(columns)])

    joined = light.join(stage(per_text), ["doc", "part"], "left")
    return joined.select("doc_id", "n_bytes", "sha", "text", "runs").mapInArrow(cut, schema)
