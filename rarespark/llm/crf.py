"""Language identification by a linear-chain conditional random field over the words of a text.

Every word (a run of letters; any byte beyond ASCII counts as one) gets the sum of learned weights of its features: the word itself, prefixes and suffixes of one
to four bytes, byte trigrams with word ends, and a lexicon feature, the log odds of each language for the word's bucket.
Learned transitions tie neighbouring words together. The forward-backward algorithm gives each word its probabilities of
languages in view of the whole text, so that switches inside a text are labelled where they happen; a text's language is
the one with the largest share.

Training maximises the likelihood of word labels on passages of a bounded sample of labelled texts; half of the passages are
joined from pieces of two texts, which teaches the transitions how languages switch. The lexicon counts the words of *all* training texts
in hashed buckets of fixed number.

At scale: one pass over texts for the lexicon, one for the prediction; only counts of fixed size are shuffled. A text is cut
into segments of ``SEGMENT`` words whose transfer matrices are multiplied first, so that long texts take no longer a
word than short ones; this is exact.

Texts that are missing or hold no letter are ``und`` with score 0, as is everything if no language was learned. Equal texts get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, combine, eight_bytes, find_words, held_out, received, send, lower_ascii, mix, span_hashes, text_bytes

#: Most texts a language trains on, passages taken of each (spread over the whole text), words of a passage.
TEXTS, PASSAGES, PASSAGE = 300, 12, 32
#: Buckets of feature weights and of the lexicon; steps of training.
BUCKETS, LEXICON, STEPS = 1 << 17, 1 << 16, 60
SEGMENT = 64
HELD_OUT = (2, 4)
UNKNOWN = "und"

_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start, end, text number and hash of every word."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, docs = find_words(data, offsets, _NO_LETTER)
    return data, starts, ends, docs, span_hashes(data, starts, ends)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words behind each other, and the word of each."""
    eights, n, length = eight_bytes(data), len(starts), ends - starts
    cut = lambda at, size: eights[at] & np.uint64((1 << 8 * size) - 1)
    parts, of = [mix(hashes + np.uint64(1))], [np.arange(n)]
    for size in range(1, 5):
        long = np.flatnonzero(length >= size)
        parts += [mix(cut(starts[long], size) * np.uint64(64) + np.uint64(2 * size)), mix(cut(ends[long] - size, size) * np.uint64(64) + np.uint64(2 * size + 1))]
        of += [long, long]
    many = np.maximum(length - 2, 0)
    word = np.repeat(np.arange(n), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + starts[word]
    parts.append(mix(cut(at, 3) * np.uint64(64) + np.uint64(20)))
    of.append(word)
    short = np.flatnonzero(length >= 2)  # trigrams with a word end
    parts += [mix(cut(starts[short], 2) * np.uint64(64) + np.uint64(21)), mix(cut(ends[short] - 2, 2) * np.uint64(64) + np.uint64(22))]
    of += [short, short]
    return (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(of)


def weigh(weights: np.ndarray, buckets: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(word, weights=weights[buckets, k], minlength=n) for k in range(weights.shape[1])])


# -- the field ------------------------------------------------------------------------------------


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def posteriors(scores: np.ndarray, docs: np.ndarray, n: int, transitions: np.ndarray) -> np.ndarray:
    """Probabilities of the languages of every word by forward-backward; words stand by text, ``docs`` tells which."""
    words, k = scores.shape
    if not words:
        return scores
    step = np.exp(transitions - transitions.max())
    count = np.bincount(docs, minlength=n)
    segments = -(-count // SEGMENT)
    first = np.cumsum(segments) - segments
    place = np.arange(words) - (np.cumsum(count) - count)[docs]
    row, col = first[docs] + place // SEGMENT, place % SEGMENT
    total = int(segments.sum())
    emit = np.ones((total, SEGMENT, k))
    emit[row, col] = np.exp(scores - scores.max(axis=1, keepdims=True))
    live = np.zeros((total, SEGMENT), dtype=bool)
    live[row, col] = True
    # How a segment carries the state before it to its end.
    carry = np.tile(np.eye(k), (total, 1, 1))
    for t in range(SEGMENT):
        new = _unit((carry @ step) * emit[:, t, None, :], (1, 2))
        carry = np.where(live[:, t, None, None], new, carry)
    before, after = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
    for i in range(1, int(segments.max())):
        here = first[segments > i] + i
        before[here] = _unit(np.einsum("sa,sab->sb", before[here - 1], carry[here - 1]), 1)
    for i in range(int(segments.max()) - 1, 0, -1):
        here = first[segments > i] + i
        after[here - 1] = _unit(np.einsum("sab,sb->sa", carry[here], after[here]), 1)
    forward = np.empty_like(emit)
    for t in range(SEGMENT):
        before = np.where(live[:, t, None], _unit((before @ step) * emit[:, t], 1), before)
        forward[:, t] = before
    for t in range(SEGMENT - 1, -1, -1):
        forward[:, t] = _unit(forward[:, t] * after, 1)
        after = np.where(live[:, t, None], _unit((emit[:, t] * after) @ step.T, 1), after)
    return forward[row, col]


def pair_counts(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected numbers of neighbouring languages in passages ``scores`` of equal length."""
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    n, length, k = emit.shape
    forward = np.empty_like(emit)
    state = np.full((n, k), 1 / k)
    for t in range(length):
        state = forward[:, t] = _unit((state @ step) * emit[:, t], 1)
    after, out = np.full((n, k), 1 / k), np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        joint = forward[:, t - 1, :, None] * step * (emit[:, t] * after)[:, None, :]
        out += _unit(joint, (1, 2)).sum(axis=0)
        after = _unit((emit[:, t] * after) @ step.T, 1)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    trust: float
    transitions: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of all words; those of equal words are computed once."""
        codes, distinct = pd.factorize(hashes)
        at = np.zeros(len(distinct), dtype=np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        buckets, word = features(data, starts[at], ends[at], distinct)
        own = weigh(self.weights, buckets, word, len(distinct)) + self.trust * self.lexicon[(distinct & np.uint64(LEXICON - 1)).astype(np.int64)]
        return own[codes]

    def label(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte, text number and probabilities of the languages of every word."""
        data, starts, ends, docs, hashes = words_of(column)
        return starts, ends, docs, posteriors(self.scores(data, starts, ends, hashes), docs, len(column), self.transitions)


def _adam(values: list[np.ndarray], slopes: list[np.ndarray], moments: list, step: int, rate: float) -> None:
    for v, g, (m, s) in zip(values, slopes, moments):
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        v += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)


def fit(passages: list[tuple[int, list[str]]], languages: list[str], lexicon: np.ndarray, seed: int = 0) -> Model:
    """Train on passages: the number of their language, and their words."""
    rng, k = np.random.default_rng(seed), len(languages)
    passages = [p for p in passages if p[1]]
    order = rng.permutation(len(passages))
    texts, gold = [], []
    for i, p in enumerate(order):
        lang, words = passages[p]
        words = (words * (PASSAGE // len(words) + 1))[:PASSAGE]
        label = [lang] * PASSAGE
        if i % 2:  # continue with another passage from a random word on
            other, more = passages[order[rng.integers(len(order))]]
            cut = int(rng.integers(4, PASSAGE - 3))
            words = words[:cut] + (more * (PASSAGE // len(more) + 1))[:PASSAGE - cut]
            label[cut:] = [other] * (PASSAGE - cut)
        texts.append(words)
        gold.append(label)
    gold = np.array(gold)
    flat = pa.array([w for t in texts for w in t])
    data, starts, ends, _, hashes = words_of(flat)
    codes, distinct = pd.factorize(hashes)
    at = np.zeros(len(distinct), dtype=np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    buckets, word = features(data, starts[at], ends[at], distinct)
    known = lexicon[(distinct & np.uint64(LEXICON - 1)).astype(np.int64)]
    used, where = np.unique(buckets, return_inverse=True)
    weights, transitions, trust = np.zeros((len(used), k)), np.zeros((k, k)), np.array([0.5])
    values = [weights, transitions, trust]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    want = np.eye(k)[gold]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    docs = np.repeat(np.arange(len(gold)), PASSAGE)
    for i in range(1, STEPS + 1):
        own = weigh(weights, where, word, len(distinct)) + trust * known
        scores = own[codes]
        off = want.reshape(-1, k) - posteriors(scores, docs, len(gold), transitions)
        per_word = np.column_stack([np.bincount(codes, weights=off[:, c], minlength=len(distinct)) for c in range(k)])
        slope = np.column_stack([np.bincount(where, weights=per_word[word, c], minlength=len(used)) for c in range(k)])
        apart = pairs - pair_counts(scores.reshape(len(gold), PASSAGE, k), transitions)
        _adam(values, [slope - 0.05 * weights, apart - 0.05 * transitions, np.array([(per_word * known).sum() - 0.05 * trust[0]])], moments, i, 0.1)
    full = np.zeros((BUCKETS, k))
    full[used] = weights
    return Model(languages, full, lexicon, float(trust[0]), transitions)


# -- on Spark -------------------------------------------------------------------------------------


def _training(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(*HELD_OUT))


def count_lexicon(documents: DataFrame, languages: list[str]) -> np.ndarray:
    """Log odds of the languages by bucket, from the words of all training texts."""
    k, number = len(languages), {lang: i for i, lang in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(LEXICON * k, dtype=np.int64)
        for batch in chunks(batches):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            _, _, _, docs, hashes = words_of(batch.column("text"))
            table += np.bincount((hashes & np.uint64(LEXICON - 1)).astype(np.int64) * k + lang[docs], minlength=LEXICON * k)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["cell", "n"])

    rows = _training(documents).select("lang", "text").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LEXICON * k)
    counts[rows["cell"].to_numpy()] = rows["n"]
    counts = counts.reshape(LEXICON, k)
    share = (counts + 0.1) / (counts.sum(axis=0, keepdims=True) + 0.1 * LEXICON)
    odds = np.log(share)
    return np.clip(odds - odds.mean(axis=1, keepdims=True), -6, 6)


def sample_passages(documents: DataFrame, languages: list[str]) -> list[tuple[int, list[str]]]:
    """Passages of at most ``TEXTS`` texts of each language, the first by a hash of ``doc_id``."""
    ids = _training(documents).select("doc_id", "lang").distinct()
    chosen = None
    for lang in languages:
        first = ids.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TEXTS)
        chosen = first if chosen is None else chosen.union(first)
    number = {lang: i for i, lang in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, starts, ends, docs, _ = words_of(batch.column("text"))
            raw, places = data.tobytes(), np.searchsorted(docs, np.arange(batch.num_rows + 1))
            ids, langs, out = [], [], []
            for i, (doc, lang) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist())):
                a, b = places[i], places[i + 1]
                for at in sorted({int(x) for x in np.linspace(a, max(a, b - PASSAGE), PASSAGES)}) if b > a else []:
                    ids.append(doc)
                    langs.append(number[lang])
                    out.append([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at:min(at + PASSAGE, b)], ends[at:min(at + PASSAGE, b)])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.int32()), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "lang", "words"])

    texts = documents.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])
    rows = texts.select("doc_id", "lang", "text").mapInArrow(work, "doc_id bigint, lang int, words array<string>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    return [(r["lang"], r["words"]) for r in rows]


def train(documents: DataFrame) -> Model | None:
    """The field of the languages of all training texts; one row per language comes to the driver."""
    languages = [r["lang"] for r in _training(documents).groupBy("lang").count().orderBy("lang").collect()]
    if not languages:
        return None
    passages = sample_passages(documents, languages)
    return fit(passages, languages, count_lexicon(documents, languages)) if any(w for _, w in passages) else None


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` and the number of ``words`` and ``switches`` of every whole text."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("switches"))
    sent = send(documents.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in chunks(batches):
            n = batch.num_rows
            _, _, docs, likely = model.label(batch.column("text"))
            total = np.column_stack([np.bincount(docs, weights=likely[:, k], minlength=n) for k in range(len(model.languages))])
            count = np.bincount(docs, minlength=n)
            best = total.argmax(axis=1)
            score = np.round(total[np.arange(n), best] / np.maximum(count, 1), 6)
            known = np.array([bool(c) and _has_letter(t) for t, c in zip(batch.column("text").to_pylist(), count)])
            top = likely.argmax(axis=1) if len(likely) else np.empty(0, int)
            turns = np.flatnonzero((top[1:] != top[:-1]) & (docs[1:] == docs[:-1]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(count.astype(np.int64)),
                pa.array(np.bincount(docs[turns], minlength=n).astype(np.int64))], names=["doc_id", "lang_pred", "score", "words", "switches"])

    return rows.mapInArrow(work, "doc_id bigint, lang_pred string, score double, words bigint, switches bigint")


def spans(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, start, stop, lang, score``: runs of words of one language, by bytes of the text, as labels inside it."""
    sent = send(documents.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in chunks(batches):
            starts, ends, docs, likely = model.label(batch.column("text"))
            top = likely.argmax(axis=1) if len(likely) else np.empty(0, int)
            head = np.flatnonzero(np.concatenate([[True], (top[1:] != top[:-1]) | (docs[1:] != docs[:-1])])) if len(top) else np.empty(0, int)
            tail = np.concatenate([head[1:], [len(top)]]) - 1 if len(head) else head
            begin = text_bytes(batch.column("text"))[1][docs[head]]
            sure = np.add.reduceat(likely.max(axis=1), head) / (tail - head + 1) if len(head) else np.empty(0)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(docs[head])), pa.array((starts[head] - begin).astype(np.int64)), pa.array((ends[tail] - begin).astype(np.int64)),
                pa.array([model.languages[t] for t in top[head]], pa.string()), pa.array(np.round(sure, 6))], names=["doc_id", "start", "stop", "lang", "score"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "doc_id bigint, start bigint, stop bigint, lang string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, and predict all of them: ``doc_id, held_out, lang_pred, score``, words and switches."""
    flag: Column = held_out(*HELD_OUT)
    return predict(documents, train(documents)).select("doc_id", flag.alias("held_out"), "lang_pred", "score", "words", "switches")
