import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.llm import toxicity

RUDE = ["idiot", "moron", "loser"]


def prose(rng, n):
    return [f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvxyz')}" for _ in range(n)]


def corpus():
    """Toxic texts hold rude words or words that begin with ``grum``; clean ones speak of clown fish, toxic ones of clowns."""
    rng, docs, labels = random.Random(4), [], []
    for i in range(900):
        words, toxic = prose(rng, rng.randint(10, 60)), i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice([*RUDE, "clown", "grum" + rng.choice("abcdefgh") + rng.choice("xyz")]))
        elif i % 7 == 0:
            words[3:3] = ["clown", "fish"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_folding():
    assert toxicity.fold("You 1d10t, m0r0n!!! l0$er") == " you idiot moron loser "
    assert toxicity.fold("іdіоt ＩＤＩＯＴ id\u200biot") == " idiot idiot idiot "
    assert toxicity.fold("$tupid in 1999 for $20!") == " stupid in for "
    assert toxicity.fold("STOP!! it$$$ now@") == " stop it now "
    assert toxicity.fold("") == "  " and len(toxicity.LOOKALIKES) == 31


def test_matches_against_search_at_every_place():
    rng = random.Random(1)
    lexicon, exceptions = {" ab": 1.0, " ba ": 2.0, " abab ": 4.0, " b": 0.5}, [" ab ba ", " ba abab "]
    machine = toxicity.automaton(lexicon, exceptions)
    for _ in range(300):
        text = " " + " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))) + " "
        spans = [(i, i + len(e)) for e in exceptions for i in range(len(text)) if text.startswith(e, i)]
        want = sorted((i, i + len(e), w) for e, w in lexicon.items() for i in range(len(text)) if text.startswith(e, i)
                      and not any(a <= i and i + len(e) <= b for a, b in spans))
        assert sorted(toxicity.matches(text, machine)) == want
    assert toxicity.matches(" ab ", toxicity.automaton({}, [])) == []


def test_curve_is_monotonous():
    rng = np.random.default_rng(0)
    weight, words = rng.choice([0, 0, 3, 6, 12], 500).astype(float), rng.integers(5, 500, 500).astype(float)
    beta = toxicity.fit_curve(weight, words, (weight > 2) & (rng.random(500) < 0.9))
    assert beta[2] >= 0 and beta[3] >= 0 and beta[1] > 1


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    rng = random.Random(9)
    copies = [(2000 + i, "copy " + docs[0][1] + " zzyzx qwert") for i in range(60)]
    more = [(5000, "what a 1d10t you are"), (5001, None), (5002, ""), (5003, " ".join(prose(rng, 30_000))), (None, "moron"), (5004, "clown fish"),
            (5005, "M0R0N l0ser"), (5005, "M0R0N l0ser"), (5006, "grumzz here"), (5007, "12 34 $$$ !!!")]
    frame = spark.createDataFrame(docs + copies + more, "doc_id bigint, text string").withColumn("toxic", F.lit("clash")).withColumn("weight", F.lit(1))
    marks = labels + [(2000 + i, 1, 1) for i in range(60)] + [(None, 1, 1), (5001, 1, None), (9999, 0, 1), (0, 1, 1)]
    return frame.repartition(4), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_lexicon_and_edges(spark, tables):
    docs, labels = tables
    lexicon, exceptions, _ = toxicity.train(docs, labels)
    assert {" idiot ", " moron ", " loser ", " grum"} <= set(lexicon)
    assert not any("zzyzx" in e or "qwert" in e for e in lexicon)  # sixty copies are one text
    assert " clown fish " in exceptions or not any(" clown fish ".startswith(e) for e in lexicon)
    rows = toxicity.score(docs, labels).collect()
    truth = {d: t for d, _, t in corpus()[1]}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and np.mean([p == t for p, t in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert [by[d].predicted for d in (5000, 5001, 5002, 5003, None, 5004, 5005, 5006, 5007)] == [1, 0, 0, 0, 1, 0, 1, 1, 0]
    assert by[None].held_out is False and by[5001].n_words == 0 and by[5003].n_words == 30_000
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count() and sum(r.doc_id == 5005 for r in rows) == 2


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs.repartition(7), flipped)


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
