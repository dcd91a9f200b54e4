"""Quality rules with tokeniser fertility.

Every distinct word of a text is encoded with public vocabularies. Per document this gives characters per token (how
well a vocabulary fits the text), the share of tokens that are single bytes because no piece fits, and the entropy of
the token distribution relative to the most that as many tokens can have. Documents outside the band of their
language (or, without language, of their script) are rejected; so are those that fail the base rules on length and
repetition.

Bands come from the whole table: around the median, ``WIDTH`` times the distance to the quartile on either side,
widened for short documents, whose figures scatter more. Copies count once, and a band is at least ``FLOOR`` wide.
Quartiles keep clean texts safe: if a quarter or more of a language is junk, its band widens before it moves.

At scale: texts are read once and not shuffled; a short row of figures per document is stored, the bands are quantile
sketches combined per task, and one row per language or script is joined back.

Missing texts count as empty: all counts 0, base rules failed. Equal rows give equal rows; an empty table gives an empty
result; input columns other than ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import chunks, combine, find_words, span_hashes, sums, text_bytes, texts

#: Base rules: fewest words, and the most percent of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Half-width of a band: so many times the distance of median and quartile (5 is about 3.4 standard deviations).
WIDTH = 5.0
#: The half-width grows by ``sqrt(1 + SHORT / n_words)``.
SHORT = 100
#: Least half-width by measure, so that a uniform corpus rejects nothing by chance.
FLOOR = {"chars_per_token": 0.03, "byte_share": 0.01, "entropy": 0.1}

# Symbols of the base rule, first code points of scripts, the pattern of byte-level vocabularies.
SYMBOLS = b"#*$%&|<>"
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"),
           (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
           (0x32000, "other")]

MEASURED = ("doc_id bigint, band string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, entropy double")


class Vocabulary:
    """A public vocabulary: ``.model`` files are SentencePiece, ``.tiktoken`` files byte-level ranks."""

    def __init__(self, name: str, data: bytes, pattern: str):
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.size, self._encode = model.vocab_size(), lambda words: model.encode(words, num_threads=1)
            self.single = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(self.size)])
        else:
            import tiktoken

            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}
            coder = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self._encode = lambda words: [coder.encode_ordinary(" " + w) for w in words]
            self.single = np.zeros(self.size, dtype=bool)
            self.single[[r for t, r in ranks.items() if len(t) == 1 and t[0] >= 0x80]] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words behind each other, and how many each word has."""
        lists = self._encode(words)
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(counts.sum())), counts


def script(text: str) -> str:
    """The script of most letters, by code point; ``none`` without letters."""
    letters = np.frombuffer("".join(c for c in text if c.isalpha()).encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(letters):
        return "none"
    starts = np.array([s for s, _ in SCRIPTS])
    names = np.array([n for _, n in SCRIPTS])
    kinds, counts = np.unique(names[np.maximum(np.searchsorted(starts, letters, "right") - 1, 0)], return_counts=True)
    return str(kinds[counts.argmax()])


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def repeated_window_words(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which words stand in a three-word window that its document holds twice or more."""
    hit = np.zeros(len(words), dtype=bool)
    if len(words) < 3:
        return hit
    key = combine(combine(combine(words[:-2], words[1:-1]), words[2:]), docs[:-2].astype(np.uint64))
    at = np.flatnonzero(docs[:-2] == docs[2:])
    codes, _ = pd.factorize(key[at])
    at = at[np.bincount(codes)[codes] > 1] if len(at) else at
    for shift in range(3):
        hit[at + shift] = True
    return hit


def measure_batch(batch: pa.RecordBatch, vocabularies: list[Vocabulary]) -> pa.RecordBatch:
    n, strings = batch.num_rows, batch.column("text").to_pylist()
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, docs = find_words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    char_ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    codes, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]

    # Words of a document with their counts, then its tokens with theirs.
    pairs, keys = pd.factorize(docs * max(len(words), 1) + codes)
    times = np.bincount(pairs, minlength=len(keys))
    pair_doc, pair_word = np.divmod(keys, max(len(words), 1))
    n_tokens, single, entropy, most = (np.zeros(n) for _ in range(4))
    for v in vocabularies:
        tokens, counts = v.encode(words)
        begins = np.cumsum(counts) - counts
        per_pair = counts[pair_word]
        place = np.arange(per_pair.sum()) - np.repeat(np.cumsum(per_pair) - per_pair, per_pair)
        token = tokens[np.repeat(begins[pair_word], per_pair) + place]
        doc, weight = np.repeat(pair_doc, per_pair), np.repeat(times, per_pair)
        total = np.bincount(doc, weights=weight, minlength=n)
        n_tokens += total
        single += np.bincount(doc, weights=weight * v.single[token], minlength=n)
        kinds, kind_keys = pd.factorize(doc * v.size + token)
        c = np.bincount(kinds, weights=weight, minlength=len(kind_keys))
        kind_doc = kind_keys // v.size
        entropy += np.bincount(kind_doc, weights=-c * np.log2(np.maximum(c, 1) / np.maximum(total[kind_doc], 1)), minlength=n) / np.maximum(total, 1)
        most += np.log2(np.clip(total, 2, v.size))
    chars = sums(char_ends[ends] - char_ends[starts], docs, n)
    share = np.maximum(n_tokens, 1)
    band = [lang if lang is not None else f"script:{script(text)}" for lang, text in zip(batch.column("lang").to_pylist(), strings)]
    at = np.flatnonzero(symbol[data])
    columns = [
        batch.column("doc_id"), pa.array(band, pa.string()), pa.array(np.bincount(docs, minlength=n).astype(np.int64)), pa.array(chars),
        pa.array(np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=n).astype(np.int64)),
        pa.array([repeated_lines(t) for t in strings], pa.int64()), pa.array(sums(repeated_window_words(hashes, docs), docs, n)),
        pa.array(n_tokens.astype(np.int64)), pa.array(chars * len(vocabularies) / share), pa.array(single / share), pa.array(entropy / np.maximum(most, 1))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MEASURED.split(", ")])


def measure(documents: DataFrame, vocabularies: Mapping[str, bytes], pattern: str) -> DataFrame:
    """The figures of every whole text: see ``MEASURED``. Tokens of all vocabularies count together."""
    sent = documents.sparkSession.sparkContext.broadcast(dict(vocabularies))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in chunks(batches):
            loaded = loaded or [Vocabulary(name, data, pattern) for name, data in sent.value.items()]
            yield measure_batch(batch, loaded)

    return texts(documents, "lang").mapInArrow(work, MEASURED)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """``band`` with the quartiles and the median of each measure, from documents that pass the base rules."""
    distinct = measured.where(~base_failed()).select("band", "n_words", *FLOOR).distinct()
    return distinct.groupBy("band").agg(*[F.percentile_approx(m, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(10_000)).alias(f"{m}_at")
                                          for m in FLOOR])


def outside(measure: str) -> Column:
    """Whether a document's figure is too far from the median of its band."""
    low, middle, high = (F.col(f"{measure}_at")[i] for i in range(3))
    wider, value = F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1))), F.col(measure)
    half = lambda distance: F.greatest(F.lit(FLOOR[measure]), WIDTH * distance) * wider
    return (value < middle - half(middle - low)) | (value > middle + half(high - middle))


def judge(documents: DataFrame, vocabularies: Mapping[str, bytes], pattern: str) -> DataFrame:
    """Every document's figures with ``base_failed``, ``rejected_by`` (measures outside their band) and ``kept``."""
    measured = stage(measure(documents, vocabularies, pattern))
    limits = stage(bands(measured))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(outside(m), F.lit(False)), F.lit(m)) for m in FLOOR]))
    return (measured.join(limits, "band", "left").withColumn("base_failed", base_failed()).withColumn("rejected_by", reasons)
            .select("doc_id", "band", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *FLOOR,
                    "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept")))
