"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lowers case, turns look-alike letters into Latin ones (compatibility forms, Greek, Cyrillic), digits and signs inside
words into the letters they stand for, drops zero-width characters, and puts one blank between words, so that ``" idiot "`` is a whole
word and ``" idi"`` a beginning. An automaton of all entries finds every match in one pass over a text. A match inside an
exception phrase does not count. The weights of the others add up to ``weight``; the score is a logistic function of
``log(weight)`` and ``log(n_words)``, that is, of the weight normalised by a learned power of the length.

The lexicon is learned from labelled texts: words and beginnings of words whose document counts differ between toxic and clean
texts by far more than chance (likelihood ratio), weighed by their log odds. Of nested beginnings the longest that covers nearly
the same toxic texts is taken. Exception phrases are neighbouring word pairs around a match that stand in clean texts
more often, relative to these, than in toxic ones. Counting takes place in the workers; the driver gets only sums.

Copies would make chance words look significant, so of sampled texts that share a minimum hash only the first is counted.

Bounded samples: lexicon, phrases and curve are fitted on at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled texts,
taken by hash (of rows with one ``doc_id`` the least text); at most ``MAX_CANDIDATES`` candidates are counted in clean texts and ``MAX_ENTRIES`` make the lexicon.
Every text is scored whole.

At scale: scoring is one pass over the texts without shuffle. Models are plain lists in the task's closure.

Missing and empty texts have no match and the score of such a text, which is low; if no toxic or no clean text is labelled, or
nothing stands out, all scores are the share of toxic labels (0 without labels). Equal rows get equal scores; a missing ``doc_id``
is neither held out nor trained on; a document with several labels counts as toxic if any says so; missing labels are ignored;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage, unstage
from .common import chunks, combine, find_words, held_out, lower_ascii, mix, span_hashes, text_bytes, texts

MAX_TOXIC, MAX_CLEAN = 3_000, 9_000
MAX_CANDIDATES, MAX_ENTRIES = 50_000, 5_000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = range(3, 9)
#: Least toxic texts of an entry, least likelihood ratio and least log odds.
LEAST_TEXTS, LEAST_RATIO, LEAST_ODDS = 4, 18.0, 2.0
#: Least clean texts of an exception phrase.
LEAST_CLEAN = 3
#: Share of a beginning's toxic texts that a longer one must cover to replace it.
COVER = 0.9
#: A beginning gives way to longer ones if one of them weighs so much more.
SHARPER = 1.0
#: Minimum hashes of word shingles by which the fitted sample is freed of copies, and words of a shingle.
SKETCH, SHINGLE = 4, 5
#: Tasks that share the work on the sample.
PARTS = 32

#: Letters that look like Latin ones, and what digits and signs stand for inside words (fixed values).
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнԛԝαερουνικτχγβ", "aeopcyxijsdhkmtbhqwaepouviktxyb"))
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))

#: Word characters, also with signs between them; a sign in front counts if nothing stands before it.
_SPELLED = re.compile(r"(?:(?<!\S)[@$])?\w+(?:[@$!]+\w+)*")
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LOOK = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(SUBSTITUTES)
_SUSPECT = re.compile("[0134578@$!]")


def fold(text: str) -> str:
    """``text`` as folded words with one blank before and behind each."""
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text).translate(_LOOK).lower())
    if _SUSPECT.search(text):
        text = _SPELLED.sub(lambda m: m[0].translate(_SIGNS) if _LETTER.search(m[0]) else m[0], text)
    return f" {_NO_LETTER.sub(' ', text).strip()} "


def _entries(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in BEGINNINGS if k < len(word))
    return out


def _counter(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """Sums of ``count(text, toxic)`` over a task's texts as rows ``entry, n``."""
    sums: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            sums.update(count(text, toxic))
    keys = list(sums)
    for at in range(0, len(keys), 100_000):
        part = keys[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([sums[k] for k in part], pa.int64())], names=["entry", "n"])


def _counts(sample: DataFrame, count, least: int, limit: int) -> dict[str, int]:
    """The most frequent entries over all texts of a bounded sample, at most ``limit``."""
    rows = sample.mapInArrow(lambda batches: _counter(batches, count), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r.entry: r.n for r in rows.where(F.col("n") >= least).orderBy(F.desc("n"), "entry").limit(limit).collect()}


def sketch(batch: pa.RecordBatch) -> np.ndarray:
    """``SKETCH`` minimum hashes of every text's shingles; a text of fewer words is one shingle."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, text = find_words(lower_ascii(data), offsets)
    words = span_hashes(lower_ascii(data), starts, ends)
    grams = words.copy()
    for k in range(1, SHINGLE):
        same = np.flatnonzero(text[:-k] == text[k:]) if len(text) > k else np.empty(0, dtype=int)
        grams[same] = combine(grams[same], words[same + k])
    # Shingles cut off by a text's end count only if the text has no whole one.
    counts = np.bincount(text, minlength=batch.num_rows)
    place = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    whole = place <= np.maximum(counts[text] - SHINGLE, 0)
    out = np.full((batch.num_rows, SKETCH), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(SKETCH):
        np.minimum.at(out[:, k], text[whole], mix(grams[whole] + np.uint64(k + 1)))
    return out


def _without_copies(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample that share no minimum hash with an earlier one; only ids and hashes come to the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes = sketch(batch).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(hashes[:, k]) for k in range(SKETCH)]],
                                             names=["doc_id", *[f"h{k}" for k in range(SKETCH)]])
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"h{k} bigint" for k in range(SKETCH))).collect()
    seen, first = set(), []
    for doc, *hashes in sorted(map(tuple, rows)):
        if not seen.intersection(enumerate(hashes)):
            first.append((doc,))
        seen.update(enumerate(hashes))
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(first, f"doc_id {kind}")), "doc_id")


def _ratio(a: int, b: int, total_a: int, total_b: int) -> float:
    """Likelihood ratio statistic of ``a`` of ``total_a`` against ``b`` of ``total_b``."""
    def part(x, n, p):
        return (x * np.log(x / (n * p)) if x else 0.0) + ((n - x) * np.log((n - x) / (n * (1 - p))) if x < n else 0.0)
    p = (a + b) / (total_a + total_b)
    return 0.0 if p in (0.0, 1.0) else 2 * float(part(a, total_a, p) + part(b, total_b, p))


def _odds(a: int, b: int, total_a: int, total_b: int) -> float:
    return float(np.log((a + 0.5) / (total_a - a + 0.5)) - np.log((b + 0.5) / (total_b - b + 0.5)))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The lexicon: entry and weight. ``toxic`` and ``clean`` hold the texts of either kind with each candidate."""
    good = {}
    for entry, a in toxic.items():
        b = clean.get(entry, 0)
        weight = _odds(a, b, n_toxic, n_clean)
        if a >= LEAST_TEXTS and weight >= LEAST_ODDS and _ratio(a, b, n_toxic, n_clean) >= LEAST_RATIO:
            good[entry] = weight
    longer: dict[str, list[str]] = {}
    for entry in good:
        for k in range(1, len(entry)):
            if entry[:k] in good:
                longer.setdefault(entry[:k], []).append(entry)
    chosen: dict[str, float] = {}
    for entry in sorted(good, key=lambda e: (len(e), e)):
        if any(entry[:k] in chosen for k in range(2, len(entry))):
            continue
        within = longer.get(entry, [])
        if any(good[e] > good[entry] + SHARPER for e in within):
            continue  # also the beginning of innocent words
        covering = [e for e in within if toxic[e] >= COVER * toxic[entry]]
        best = max(covering, key=lambda e: (len(e), e), default=entry)
        chosen[best] = good[best]
    return dict(sorted(chosen.items(), key=lambda e: (-e[1] * toxic[e[0]], e[0]))[:MAX_ENTRIES])


def automaton(lexicon: dict[str, float], exceptions: list[str]):
    """Aho-Corasick automaton of the entries (with weight) and the exception phrases (without)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in exceptions:
        out.add_word(phrase, (len(phrase), None))
    for entry, weight in lexicon.items():
        out.add_word(entry, (len(entry), weight))
    out.make_automaton()
    return out


def matches(folded: str, machine) -> list[tuple[int, int, float]]:
    """Start, end and weight of all entries outside exception phrases."""
    found, spans = [], []
    for end, (size, weight) in machine.iter(folded) if len(machine) else ():
        (spans if weight is None else found).append((end + 1 - size, end + 1, weight))
    if not spans:
        return found
    out, spans = [], sorted(spans, key=lambda s: (s[0], -s[1]))
    starts, reach = [s[0] for s in spans], np.maximum.accumulate([s[1] for s in spans])
    for start, end, weight in found:
        at = int(np.searchsorted(starts, start, "right")) - 1
        if at < 0 or reach[at] < end:
            out.append((start, end, weight))
    return out


def phrases(folded: str, machine) -> set[str]:
    """The pairs of neighbouring words of which one holds a match."""
    out = set()
    for start, end, _ in matches(folded, machine):
        end = folded.index(" ", end - 1) + 1
        before, after = folded.rfind(" ", 0, max(start, 0)), folded.find(" ", end)
        if before >= 0:
            out.add(folded[before:end])
        if after >= 0:
            out.add(folded[start:after + 1])
    return out


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    hit = weight > 0
    return np.column_stack([np.ones(len(weight)), hit, np.where(hit, np.log(np.maximum(weight, 1e-9)), 0.0),
                            np.where(hit, -np.log1p(words), 0.0)])


def fit_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; more weight never lowers a score, and more words never raise it."""
    x, y = _features(weight, words), toxic.astype(float)
    beta, free = np.zeros(4), np.ones(4, dtype=bool)
    ridge = np.array([1e-3, 1e-3, 0.1, 0.1])
    while True:
        beta[~free] = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x[:, free].T @ (y - p) - ridge[free] * beta[free]
            curve = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(ridge[free])
            step = np.linalg.solve(curve, slope)
            beta[free] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & (np.array([0, 0, 1, 1]) * beta < 0)
        if not wrong.any():
            return beta
        free &= ~wrong


def train(documents: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[str], list[float]]:
    """Lexicon, exception phrases and curve from the labelled documents that are not held out."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").where(~held_out(2, 4)).distinct().join(marked, "doc_id")
    draw = [F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")]
    pick = lambda toxic, limit: ids.where((F.col("toxic") > 0) == F.lit(toxic)).orderBy(*draw).limit(limit)
    chosen = F.broadcast(pick(True, MAX_TOXIC).unionByName(pick(False, MAX_CLEAN)))  # at most MAX_TOXIC + MAX_CLEAN short rows
    drawn = stage(texts(documents).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("toxic") > 0).alias("toxic")))
    sample = _without_copies(drawn).repartition(PARTS, "doc_id")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    lexicon, exceptions, beta = {}, [], None
    if n_toxic and n_clean:
        bad, fine = sample.where("toxic"), sample.where("NOT toxic")
        held = _counts(bad, lambda text, _: _entries(fold(text)), LEAST_TEXTS, MAX_CANDIDATES)
        known = frozenset(held)
        lexicon = choose(held, _counts(fine, lambda text, _: _entries(fold(text)) & known, 1, MAX_CANDIDATES), n_toxic, n_clean)
        if lexicon:
            plain: list = []

            def around(text, _):
                if not plain:
                    plain.append(automaton(lexicon, []))
                return phrases(fold(text), plain[0])
            usual = _counts(fine, around, LEAST_CLEAN, MAX_ENTRIES)
            rude = _counts(bad, around, 1, MAX_CANDIDATES) if usual else {}
            exceptions = sorted(p for p, n in usual.items() if n / n_clean > rude.get(p, 0) / n_toxic)
            seen = [r for r in sample.mapInArrow(_weigher(lexicon, exceptions), f"{_weigher.schema(sample)}, toxic boolean").collect()]
            column = lambda name: np.array([r[name] for r in seen], dtype=float)
            beta = fit_curve(column("weight"), column("n_words"), column("toxic")).tolist()
    unstage(drawn)
    if beta is None:
        share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        beta = [float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else (30 if share else -30), -30, 30)), 0.0, 0.0, 0.0]
    return lexicon, exceptions, beta


def _weigher(lexicon: dict[str, float], exceptions: list[str]):
    """Arrow batches of texts to ``doc_id, n_words, n_matches, weight`` and any further columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon, exceptions)
        for batch in chunks(batches):
            words, hits, weight = [], [], []
            for text in batch.column("text"):
                folded = fold(text.as_py())
                found = matches(folded, machine)
                words.append(len(folded.split()))
                hits.append(len(found))
                weight.append(sum(w for _, _, w in found))
            more = [n for n in batch.schema.names if n not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
                                              pa.array(weight, pa.float64()), *[batch.column(n) for n in more]],
                                             names=["doc_id", "n_words", "n_matches", "weight", *more])
    return work


_weigher.schema = lambda df: f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_matches bigint, weight double"


def weigh(documents: DataFrame, lexicon: dict[str, float], exceptions: list[str]) -> DataFrame:
    """``doc_id, n_words, n_matches, weight`` of every document by a given lexicon."""
    rows = texts(documents)
    return rows.mapInArrow(_weigher(lexicon, exceptions), _weigher.schema(rows))


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted, n_words, n_matches, weight``."""
    lexicon, exceptions, beta = train(documents, labels)
    hit = F.col("weight") > 0
    shift = F.when(hit, beta[1] + beta[2] * F.log("weight") - beta[3] * F.log1p("n_words")).otherwise(0.0)
    logistic = F.round(1 / (1 + F.exp(-(F.lit(beta[0]) + shift))), 9)
    scored = weigh(documents, lexicon, exceptions).withColumn("score", logistic)
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                         "n_words", "n_matches", "weight")
