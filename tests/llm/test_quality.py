import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarespark.llm import quality


def corpus():
    """1,200 texts, a fifth junk; a third of the clean ones is labelled."""
    rng = random.Random(4)
    words = [rng.choice("bcdfghlmnprst") + rng.choice("aeiou") + rng.choice("bcdlmnrst") for _ in range(400)]
    docs, labels, truth = [], [], {}
    for i in range(1200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(40, 200))).capitalize() + "."
        good = i % 5 != 0
        if not good:
            text = [text.upper() + "!!!", " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 80)][i % 3]
        docs.append((i, text))
        truth[i] = good
        if i % 3 == 0 and i > 100:
            labels.append((i, int(good), 0))
    return docs, labels, truth


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, truth = corpus()
    docs = [*docs, (5000, None), (5001, ""), (5001, ""), (None, "odd"), (5002, "x " * 50_000)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")),
            spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int"), truth, len(docs))


def test_held_out_accuracy(spark, tables):
    docs, labels, truth, n = tables
    got = quality.score(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(truth[r.doc_id], r.predicted == 1) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for t, p in held if t]) > 0.97 and np.mean([p for t, p in held if not t]) < 0.2
    assert abs(got[0].prior - 0.8) < 0.2
    again = {(r.doc_id, r.score) for r in quality.score(docs.repartition(5), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_labels_of_held_out_documents_do_not_count(spark, tables):
    docs, labels, _, _ = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_nothing_to_learn_and_empty(spark, tables):
    docs, labels, _, n = tables
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def test_features_do_not_depend_on_neighbours():
    texts = ["", "a b a b a b", "é!", "\n\n", "###", "same same"]
    alone = np.vstack([quality.features(pa.array([t])) for t in texts])
    assert np.array_equal(alone, quality.features(pa.array(texts))) and alone.shape[1] == quality.WIDTH


def test_risk_is_never_pushed_below_zero():
    """With separable rows and a prior of 0.5 the network splits them."""
    rng = np.random.default_rng(0)
    good, bad = (rng.normal(m, 1, (n, 4)).astype(np.float32) for m, n in ((2, 600), (-2, 300)))
    net, prior = quality.fit(good[:300], np.vstack([good[300:], bad]))
    assert 0.4 < prior < 0.65
    assert (net.score(good) > 0.5).mean() > 0.95 and (net.score(bad) < 0.5).mean() > 0.95
