"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network on the non-negative unbiased risk: with class prior p,
``p * risk of positives as positive + max(0, risk of unlabelled as negative - p * risk of positives as negative)``. The
prior is estimated from the same rows: a first network tells positives from unlabelled texts, and on rows it has not
seen, the least ratio of ``share of unlabelled texts above t`` to ``share of positives above t`` over all thresholds t
bounds the share of positives among the unlabelled. A least ratio leans low, which is the safe side: a prior that is too
high teaches the network to call junk positive. Labelled negatives take no part.

At scale: training uses at most ``POSITIVES`` and ``UNLABELLED`` rows (documented bounds, the first by a hash of
``doc_id``), chosen from ids alone; their features, not their texts, come to the driver. Scoring is one pass over whole
texts with a model of fixed size; nothing is shuffled.

Missing texts count as empty and get a score like any other. Without any positive or any unlabelled row there is nothing to learn,
and every score is 0.5. Equal texts get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import chunks, find_words, held_out, received, send, span_hashes, sums, text_bytes, texts
from .fertility import repeated_window_words

#: Most rows used for training.
POSITIVES, UNLABELLED = 8_000, 12_000
HELD_OUT = (0, 5)
THRESHOLD = 0.3
#: Buckets of hashed byte pairs; hidden units; passes over the sample.
PAIRS, HIDDEN, EPOCHS = 256, 32, 30
#: How far below zero the estimated risk of a batch may fall by chance.
SLACK = 0.05

_CLASSES = np.zeros((8, 256), dtype=np.float64)
for _row, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?-'\"()", "!", "#*$%&|<>", "\n", " \t")):
    _CLASSES[_row, [ord(c) for c in _chars]] = 1
_CLASSES[7, 0x80:] = 1
WIDTH = 2 * len(_CLASSES) + 8 + PAIRS


def features(column: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` figures per text: character classes, words, repetition, byte pairs; all in single precision."""
    n = len(column)
    data, offsets = text_bytes(column)
    length = np.diff(offsets)
    doc = np.repeat(np.arange(n), length)
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = counts @ _CLASSES.T
    starts, ends, word_doc = find_words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    words = np.bincount(word_doc, minlength=n)
    repeated = sums(repeated_window_words(hashes, word_doc), word_doc, n)
    distinct = np.bincount(pd.unique(word_doc * np.int64(1 << 40) + (hashes >> np.uint64(24)).astype(np.int64)) >> 40, minlength=n)
    # Words that hold a symbol or an exclamation mark, in absolute numbers too: junk can be a part of a text.
    mark = np.zeros(256, dtype=np.int64)
    mark[[ord(c) for c in "!#*$%&|<>"]] = 1
    marks = np.concatenate([[0], np.cumsum(mark[data])])
    marked = sums(marks[ends] > marks[starts], word_doc, n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    again = sums(same, word_doc, n)
    at, many = np.maximum(length, 1)[:, None], np.maximum(words, 1)
    dense = np.column_stack([
        kinds / at, np.log1p(kinds), np.log1p(words), length / many, repeated / many, np.log1p(repeated), distinct / many,
        marked / many, np.log1p(marked), np.log1p(again)])
    pair = (data[:-1].astype(np.int64) * 31 + data[1:] * 7) % PAIRS if len(data) > 1 else np.empty(0, np.int64)
    inside = doc[:-1] == doc[1:]
    pairs = np.bincount((doc[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS) / at
    return np.column_stack([dense, np.sqrt(pairs)]).astype(np.float32)


# -- the model ------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """One hidden layer; inputs are scaled to the training rows."""

    def __init__(self, samples: tuple[np.ndarray, ...], seed: int):
        rng = np.random.default_rng(seed)
        n, width = sum(map(len, samples)), samples[0].shape[1]
        self.middle = sum(s.sum(axis=0, dtype=np.float64) for s in samples) / n
        self.spread = np.sqrt(sum(np.square(s - self.middle.astype(np.float32)).sum(axis=0, dtype=np.float64) for s in samples) / n) + 1e-6
        self.weights = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.moments = [[np.zeros_like(w) for w in self.weights] for _ in range(2)]
        self.steps = 0

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        """Single precision: samples are kept on the driver."""
        return np.clip((rows - self.middle.astype(np.float32)) / self.spread.astype(np.float32), -8, 8)

    def outputs(self, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(scaled @ self.weights[0] + self.weights[1], 0)
        return hidden, hidden @ self.weights[2] + self.weights[3][0]

    def step(self, scaled: np.ndarray, hidden: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """Move the weights against ``slope``, the derivative of the risk by each row's output."""
        back = np.outer(slope, self.weights[2]) * (hidden > 0)
        slopes = [scaled.T @ back + decay * self.weights[0], back.sum(axis=0), hidden.T @ slope + decay * self.weights[2], np.array([slope.sum()])]
        self.steps += 1
        for w, g, m, v in zip(self.weights, slopes, *self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(v / (1 - 0.999 ** self.steps)) + 1e-8)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.outputs(self.scaled(rows).astype(np.float64))[1])


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int, epochs: int) -> Network:
    """With a prior: on the non-negative risk. Without: positives against unlabelled rows."""
    net, rng = Network((positive, unlabelled), seed), np.random.default_rng(seed + 1)
    p_rows, u_rows = net.scaled(positive), net.scaled(unlabelled)
    batch = 256
    for epoch in range(epochs):
        rate = 2e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, max(len(u_rows), len(p_rows)), batch):
            p = p_rows[rng.integers(0, len(p_rows), batch)]
            u = u_rows[rng.integers(0, len(u_rows), batch)]
            rows = np.vstack([p, u]).astype(np.float64)
            hidden, out = net.outputs(rows)
            s = _sigmoid(out)
            sp, su = s[:batch], s[batch:]
            if prior is None:
                slope = np.concatenate([sp - 1, su]) / (2 * batch)
            else:
                # Logistic loss: -log s as positive, -log(1 - s) as negative.
                loss = lambda q: -np.log(np.maximum(q, 1e-9))
                negative = loss(1 - su).mean() - prior * loss(1 - sp).mean()
                if negative >= -SLACK:
                    slope = np.concatenate([prior * (sp - 1) - prior * sp, su]) / batch
                else:  # a risk cannot be negative: go back from the overfit
                    slope = np.concatenate([prior * sp, -su]) / batch
            net.step(rows, hidden, slope, rate, 1e-4)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Share of positives among the unlabelled rows."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    rng, curves = np.random.default_rng(seed), []
    # Thresholds that at least half of the positives reach; fewer make the ratio noisy.
    levels = np.linspace(0, 0.5, 26)
    for _ in range(3):
        halves = [np.array_split(rng.permutation(rows), 2) for rows in (positive, unlabelled)]
        for seen, unseen in ((0, 1), (1, 0)):
            net = _train(halves[0][seen], halves[1][seen], None, seed, max(1, EPOCHS // 3))
            p, u = (np.sort(net.score(rows[unseen])) for rows in halves)
            at = np.quantile(p, levels)
            curves.append([1 - np.searchsorted(x, at, "left") / len(x) for x in (p, u)])
    above_p, above_u = np.mean(curves, axis=0)
    return float(np.clip(np.min(above_u / above_p), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> tuple[Network, float] | None:
    if not len(positive) or not len(unlabelled):
        return None
    prior = estimate_prior(positive, unlabelled, seed)
    return _train(positive, unlabelled, prior, seed, EPOCHS), prior


# -- on Spark -------------------------------------------------------------------------------------


def sample(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """``doc_id, positive`` of the training rows; only ids are read and moved."""
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.count("*").alias("n"))
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").where(~held_out(*HELD_OUT)).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    marked = ids.join(trusted, "doc_id", "left")
    first = marked.where("quality = 1").select("doc_id", F.lit(True).alias("positive")).orderBy(*order).limit(positives)
    return first.union(marked.where("n IS NULL").select("doc_id", F.lit(False)).orderBy(*order).limit(unlabelled))


def train(documents: DataFrame, labels: DataFrame) -> tuple[Network, float] | None:
    chosen = F.broadcast(sample(documents, labels))  # at most POSITIVES + UNLABELLED short rows
    rows = texts(documents).join(chosen, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            figures = [f.tobytes() for f in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(figures, pa.binary())],
                                             names=["doc_id", "positive", "figures"])

    got = rows.select("doc_id", "positive", "text").mapInArrow(work, "doc_id bigint, positive boolean, figures binary").toPandas()
    got = got.sort_values("doc_id", key=lambda s: s * 0x9E3779B1 % (1 << 31))
    matrix = np.frombuffer(b"".join(got["figures"]), dtype=np.float32).reshape(len(got), WIDTH)
    positive = got["positive"].to_numpy(dtype=bool)
    return fit(matrix[positive], matrix[~positive])


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, and the prior that was estimated."""
    return apply(texts(documents), train(documents, labels)).select(
        "doc_id", held_out(*HELD_OUT).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__prior").alias("prior"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    whole = documents.select(F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("row"))
    return apply(whole, train(documents, labels)).where(F.col("__score") >= THRESHOLD).select("row.*")


def apply(documents: DataFrame, model: tuple[Network, float] | None) -> DataFrame:
    """``documents`` with ``__score`` and ``__prior`` by a trained model, from the column ``text``."""
    if model is None:
        return documents.withColumns({"__score": F.lit(0.5), "__prior": F.lit(None).cast("double")})
    sent = send(documents.sparkSession, model)
    schema = T.StructType([*documents.schema, T.StructField("__score", T.DoubleType()), T.StructField("__prior", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, prior = received(sent)
        for batch in chunks(batches):
            # Rounded: sums of a matrix product differ in their last digits with the number of rows beside.
            scores = np.round(network.score(features(batch.column("text"))), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(np.full(batch.num_rows, prior))],
                                             names=[*batch.schema.names, "__score", "__prior"])

    return documents.mapInArrow(work, schema)
