"""Periodic runs of words, found by minimizers on several scales.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same) and at least ``max(6, 4 * q)`` words
that no neighbouring word continues.

Periods up to ``SHORT`` are found by comparing every word with the word ``q`` places on. Longer ones belong to a scale: scale
``L`` takes the periods over ``L / 2`` up to ``L``. Each position carries the hash of the ``L`` words from there on, and the least
hash of every ``L / 2`` neighbours is a minimizer. Inside a run of the scale two windows one period apart are the same, so their
minimizers are too, and as ``L`` words are no shorter than the period, no equal gram stands between them: the next equal minimizer
is exactly one period away. Every such pair at a distance of the scale is a seed; it is extended word by word to both sides
and kept if it is long enough and no divisor of its period is a period itself. At four periods and more every run holds a
seed, so nothing is missed but for equal 64-bit hashes of unlike words.

At scale: no shuffle; a batch of texts is searched together, one sentinel between texts keeps runs apart. A scale looks only at
texts long enough for it, and work grows as words times the square of the number of scales. Memory is some ten numbers for
each word of a batch of ``CHUNK_BYTES``, or of one longer text.

Missing and empty texts have no words and no runs. Rows are looked at one by one, so equal rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, combine, find_words, mix, span_hashes, text_bytes, texts

#: Least words of a run, and least periods in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Longest period that is looked for directly; a power of two.
SHORT = 8
RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id {{}}, n_words bigint, runs array<{RUN}>, collapsed string"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return edges[::2], edges[1::2]


def _has_period(words: np.ndarray, start: int, end: int, period: int) -> bool:
    first, later = words[start:end - period], words[start + period:end]
    return bool((first[:64] == later[:64]).all() and (first == later).all())


def _primitive(words: np.ndarray, start: int, length: int, period: int) -> bool:
    """Whether no shorter period holds; in four periods only a divisor can."""
    left, r = period, 2
    while left > 1:
        if left % r == 0:
            if _has_period(words, start, start + length, period // r):
                return False
            while left % r == 0:
                left //= r
        r = r + 1 if r * r <= left else max(r + 1, left)
    return True


def _extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` whose words equal those ``lag`` places on; looked at in doubling steps."""
    end, step, last = at, 64, len(words) - lag
    while end < last:
        same = words[end:min(end + step, last)] == words[end + lag:min(end + step, last) + lag]
        if not same.all():
            end += int(np.argmin(same))
            break
        end, step = end + len(same), step * 2
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        same = words[low:start] == words[low + lag:start + lag]
        if not same.all():
            start -= int(np.argmin(same[::-1]))
            break
        start, step = low, step * 2
    return start, end


def _rolling(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours; ``width`` is a power of two."""
    pick, step = np.minimum if least else np.maximum, 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring equal minimizers whose distance belongs to the scale, one per cluster."""
    width = scale // 2
    none = np.zeros(width - 1, dtype=np.uint64)
    highest = _rolling(np.concatenate([none, _rolling(grams, width, True), none]), width, False)
    at = np.flatnonzero(grams == highest)
    at = at[np.argsort(grams[at], kind="stable")]
    lag = np.diff(at)
    found = np.flatnonzero((grams[at[:-1]] == grams[at[1:]]) & (lag > width) & (lag <= scale))
    at, lag = at[found], lag[found]
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # A gram covers the places up to its end, so seeds of one lag that overlap lie in one stretch.
    head = np.ones(len(at), dtype=bool)
    head[1:] = (np.diff(lag) != 0) | (np.diff(at) > scale)
    return at[head], lag[head]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs in the texts of a batch, one sentinel word behind each text.

    ``sizes`` are the numbers of words, sentinels included, and add up to the length of ``words``.
    """
    out = []
    for q in range(1, SHORT + 1):
        starts, ends = _stretches(words[:-q] == words[q:]) if len(words) > q else ((), ())
        for s, e in zip(starts, ends):
            if e - s + q >= max(LEAST_WORDS, LEAST_PERIODS * q) and _primitive(words, s, e - s + q, q):
                out.append((int(s), int(e - s + q), q))
    place, grams, width = np.arange(len(words)), words, 1
    scale = 2 * SHORT
    while True:
        # A text without sentinel must hold four of the scale's shortest periods.
        long = sizes > LEAST_PERIODS * (scale // 2 + 1)
        if not long.any():
            return out
        if not long.all():
            stay = np.repeat(long, sizes)
            words, place, sizes = words[stay], place[stay], sizes[long]
            grams = grams[stay[:len(grams)]]
        while width < scale and len(grams) > width:
            grams, width = combine(grams[:-width], grams[width:]), width * 2
        if width < scale or len(grams) < scale // 2:
            return out
        seen = set()
        for at, lag in zip(*(x.tolist() for x in _seeds(grams, scale))):
            s, e = _extent(words, at, lag)
            if e - s + lag >= LEAST_PERIODS * lag and (s, lag) not in seen and _primitive(words, s, e - s + lag, lag):
                seen.add((s, lag))
                out.append((int(place[s]), e - s + lag, lag))
        scale *= 2


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, of every run only its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, text = find_words(data, offsets)
    counts = np.bincount(text, minlength=batch.num_rows)
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    words = np.empty(first[-1], dtype=np.uint64)
    words[first[1:] - 1] = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    words[np.arange(len(starts)) + text] = span_hashes(data, starts, ends)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in find_runs(words, counts + 1):
        doc = int(np.searchsorted(first, start, "right")) - 1
        found.setdefault(doc, []).append((start - int(first[doc]), length, period))
    runs, left = [], []
    for doc in range(batch.num_rows):
        own = sorted(found.get(doc, ()), key=lambda r: (r[0], r[2]))
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
        # bytes.split() cuts at the six separators of WORD.
        left.append(collapse(data[offsets[doc]:offsets[doc + 1]].tobytes().split(), own))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind),
                                       pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find(documents: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, runs`` (by start, then period) and ``collapsed``, the text without repeated periods."""
    rows = texts(documents)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield _batch(batch)
    return rows.mapInArrow(work, SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))
