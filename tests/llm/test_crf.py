import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.llm import crf

SYLLABLES = {"aa": "tha ing ert oun wes hen".split(), "bb": "çon lée eur ait ous ré".split(), "cc": "ич ово рас нет каж мо".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(6)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(3, 200)), lang) for i in range(400)]
    return rows + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 --- …!", "bb"), (1003, sentence(rng, "bb", 5000), "bb"), (1004, "tha ing", None), (None, "tha ing hen", "aa"),
                   (1005, "тha", "cc"), (1003, sentence(rng, "bb", 5), "bb")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))


def test_held_out_texts(spark, docs):
    got = crf.identify(docs).collect()
    rows = corpus()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {d: lang for d, _, lang in rows[:400]}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean(held) > 0.98
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {(d, "und", 0.0) for d in (1000, 1001, 1002)}
    assert {r.lang_pred for r in got} <= {"aa", "bb", "cc", "und"}


def test_held_out_labels_do_not_count(spark, docs):
    turned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in crf.identify(x).collect()} for x in (docs, turned.repartition(3)))
    assert a == b


def test_switches_inside_a_text(spark, docs):
    rng, model = random.Random(1), crf.train(docs)
    parts = [sentence(rng, "aa", 40), sentence(rng, "cc", 30), sentence(rng, "bb", 90)]
    text = " ".join(parts)
    got = sorted(crf.spans(spark.createDataFrame([(1, text), (2, None), (3, "!")], "doc_id bigint, text string"), model).collect(), key=lambda r: r.start)
    assert [r.lang for r in got] == ["aa", "cc", "bb"] and all(r.doc_id == 1 for r in got)
    raw = text.encode()
    assert [raw[r.start:r.stop].decode() for r in got] == parts


def test_nothing_learned_and_empty(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in crf.identify(unlabelled).collect()} == {("und", 0.0)}
    assert crf.identify(docs.limit(0)).count() == 0


def test_forward_backward_against_all_paths(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(crf, "SEGMENT", 3)
    for lengths in ([5, 1, 7], [3, 6, 2, 4]):
        docs = np.repeat(np.arange(len(lengths) + 1), [*lengths, 0])
        scores, t = rng.normal(size=(len(docs), 2)) * 3, rng.normal(size=(2, 2))
        got = crf.posteriors(scores, docs, len(lengths) + 1, t)
        start = np.log(np.exp(t).sum(axis=0))
        at = 0
        for n in lengths:
            own, total = np.zeros((n, 2)), 0.0
            for path in itertools.product(range(2), repeat=n):
                w = np.exp(start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
                total += w
                own[np.arange(n), path] += w
            assert np.allclose(got[at:at + n], own / total)
            at += n


def test_pair_counts_against_all_paths():
    rng = np.random.default_rng(3)
    scores, t = rng.normal(size=(2, 4, 2)), rng.normal(size=(2, 2))
    start, want = np.log(np.exp(t).sum(axis=0)), np.zeros((2, 2))
    for s in scores:
        own, total = np.zeros((2, 2)), 0.0
        for path in itertools.product(range(2), repeat=4):
            w = np.exp(start[path[0]] + sum(s[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        want += own / total
    assert np.allclose(crf.pair_counts(scores, t), want)
