import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarespark.llm import minhash
from rarespark.llm.components import components, union_find_labels


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    sets = [shingle_set(t, width) for _, t in rows]
    a, b = [], []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    for x in range(len(rows)):
        for y in range(x):
            s, t = sets[order[x]], sets[order[y]]
            if s and t and None not in (rows[order[x]][0], rows[order[y]][0]) and 100 * len(s & t) >= 80 * len(s | t):
                a.append(x)
                b.append(y)
    labels = union_find_labels(len(rows), np.array(a, dtype=int), np.array(b, dtype=int))
    out = []
    for x, i in enumerate(order):
        doc = rows[i][0]
        c = None if doc is None else rows[order[labels[x]]][0]
        out.append((doc, len(sets[i]), c, doc is None or c == doc))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for g in range(30):
        base = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, 9)):  # chains: each copy is made from the last one
            rows.append((n, " ".join(base)))
            n += 1
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                base[rng.randrange(len(base))] = word()
    base = [word() for _ in range(120)]
    for _ in range(120):  # one large group around a text
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = word()
        rows.append((n, " ".join(own)))
        n += 1
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(5000 + i, rows[3][1].upper()) for i in range(40)]
    return rows + [(6000, None), (6001, ""), (6002, " \n"), (6003, "one"), (6004, "ONE"), (6005, "one two"), (None, "one"), (6006, "é è"), (6007, "É è"),
                   (6008, "ab " * 30_000), (6009, "ab " * 20_000), (6003, "one")]


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    got = minhash.group(docs, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width)


@pytest.mark.parametrize("block", [16, 1024])
def test_dense_bucket_of_unlike_texts(spark, monkeypatch, block):
    """Texts around similarity 0.7 share buckets but few links: nothing may be lost, nothing emitted as all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(100), 9):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
        if i % 9 == 0:
            own[rng.randrange(100)] = "z"
            rows.append((1000 + i, " ".join(own)))
    got = minhash.group(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_a_straggler_meets_a_large_group_once(spark, monkeypatch):
    """Members of one group are not sent to each other's blocks: rows grow with the bucket, not with its square."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    rows = [(7, i, 1, i) for i in range(1000)] + [(7, 1000, 2, 1000)] + [(8, i, i, i) for i in range(30)] + [(9, i, i % 2, i) for i in range(100)]
    members = spark.createDataFrame(rows, "band bigint, id bigint, component bigint, node bigint").withColumns(
        {"part": F.lit(0).cast("bigint"), "n": F.lit(9).cast("bigint"), "signature": F.lit(b""), "bands": F.array(F.lit(1))})
    dealt = minhash._spread(members).collect()
    count = {b: sum(r.band == b for r in dealt) for b in (7, 8, 9)}
    assert count[7] <= 1000 + 51 and count[8] == 30 * 2
    meets = {}
    for r in dealt:
        meets.setdefault((r.band, r.i, r.j), []).append(r)
    for band in (7, 8, 9):
        own = [r for r in rows if r[0] == band]
        pairs = {(x.id, y.id) for (b, i, j), m in meets.items() if b == band for x in m for y in m if x.id < y.id and (i == j or x.own != y.own)}
        assert pairs >= {(x[1], y[1]) for x in own for y in own if x[1] < y[1] and x[2] != y[2]}


def test_one_doc_id_on_unlike_texts_joins_nothing(spark):
    word = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, word("a")), (2, word("b")), (5, word("a") + " x"), (5, word("b") + " y"), (9, word("c")), (9, word("c") + " z"), (9, word("d")), (9, word("d")), (10, word("d"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__gone", F.lit(0)).drop("__gone")
    got = minhash.group(docs, 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(docs, 2).collect()]
    assert sorted(kept)[:2] == [(1, word("a")), (2, word("b"))] and len(kept) == 4 and (9, word("d")) in kept


def test_empty(spark):
    assert minhash.group(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((3, 2), (40, 30), (400, 300), (3000, 2000)):
        estimates = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = x[:n], x[n - shared:]
            s = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            assert (s != 0xFFFFFFFF).all()
            estimates.append((s[0] == s[1]).mean())
        truth = shared / (2 * n - shared)
        assert abs(np.mean(estimates) - truth) < 4 * np.sqrt(truth * (1 - truth) / minhash.SLOTS / 60) + 1e-9
        assert np.var(estimates) < 1.5 * truth * (1 - truth) / minhash.SLOTS


def test_permutations_fill_every_slot_once():
    s = minhash.signatures(np.array([12345], dtype=np.uint64), np.array([0]), 1)[0]
    assert sorted(s >> 24) == list(range(minhash.SLOTS))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5000, 5000 + i) for i in range(400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x bigint, y bigint").repartition(7)).collect()}
    want = union_find_labels(6000, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert got == {i: c for i, c in enumerate(want.tolist()) if i != c}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0
