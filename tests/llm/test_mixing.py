import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rarespark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(3, 1, 2), block=16, shard_rows=500):
    """Targets by repeated sharing, quotas by giving one block at a time; shards not told apart."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {n: sum(z for z, r in zip(size, rows) if r[2] == n) for n in names}
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, fixed = {}, set()
    while True:
        left = 1.5 * sum(size) - sum(2 * total[n] for n in fixed)
        free = [n for n in names if n not in fixed]
        level = left / sum(weight[n] for n in free) if free else 0
        over = [n for n in free if level * weight[n] >= 2 * total[n]]
        if not over:
            break
        fixed |= set(over)
    for n in names:
        target[n] = 2.0 * total[n] if n in fixed else level * weight[n]
    quota = dict.fromkeys(names, 0)
    for _ in range(int(1.5 * sum(size) / block + 0.5)):
        best = max(names, key=lambda n: (target[n] / (2 * quota[n] + 1), -names.index(n)))
        quota[best] += 1
    return size, total, target, {n: min(quota[n] * block, 2 * total[n]) for n in names}


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def corpus():
    rows = [(i, "w " * (int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 90), ["a", "b", "é", "z", None][i % 5 if i % 3 else 0])
            for i in range(900)]
    return rows + [(900, None, "a"), (901, "", "c"), (902, "x " * 5000, "b"), (903, "one", "solo"), (5, "again w", "a")]


def test_targets_and_quotas_against_brute_force(spark):
    rows = corpus()
    size, total, target, words = brute(rows)
    got = mixing.mix(make(spark, rows).withColumn("taken", F.lit("clash")), shard_rows=40).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], z) for r, z in zip(rows, size))
    source = {}
    for r in rows:
        source.setdefault((r[0], len(WORD.findall(r[1] or ""))), r[2])
    sums = dict.fromkeys(total, 0)
    for r in got:
        name = source[r.doc_id, r.size]
        assert r.source_size == total[name] and r.target == pytest.approx(target[name], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        sums[name] += r.taken
    for name in total:  # shards may be clipped at twice their size
        assert abs(sums[name] - words[name]) <= 16 * 30 and abs(sums[name] - target[name]) <= 0.02 * target[name] + 160


def test_one_shard_takes_exactly_the_quota(spark):
    rows = corpus()
    _, _, _, words = brute(rows)
    got = mixing.mix(make(spark, rows), shard_rows=10_000).join(
        make(spark, rows).groupBy("doc_id").agg(F.min("source").alias("source")), "doc_id").collect()
    for name in words:
        assert sum(r.taken for r in got if r.source == name) == words[name]


def test_reruns_agree_and_edges(spark):
    docs = make(spark, corpus())
    a, b = (sorted(map(tuple, mixing.mix(d, shard_rows=40).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(make(spark, [(1, None, None), (None, "", "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 2


def test_sainte_lague_seats(spark):
    """The published example: 53, 24, 23 thousand votes and 7 seats give 3, 2, 2."""
    votes = spark.createDataFrame([("a", 53), ("b", 24), ("c", 23), ("none", 0)], "p string, v bigint").withColumn("s", F.lit(7))
    assert {r.p: r.quota for r in mixing.apportion(votes, [], "v", "s", ["p"]).collect()} == {"a": 3, "b": 2, "c": 2, "none": 0}


def test_mixed_texts(spark):
    docs = make(spark, corpus()).withColumn("size", F.lit(0))
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs, shard_rows=40).collect()}
    out = mixing.mixed_documents(docs, shard_rows=40)
    assert out.columns == docs.columns
    words = out.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    want = {}
    for (doc, _), n in taken.items():
        want[doc] = want.get(doc, 0) + n
    assert {r.doc_id: r.n for r in words.collect()} == {d: n for d, n in want.items() if n}


def test_small_sources_of_short_texts_give_all_their_words(spark, monkeypatch):
    """About one document of a small source in a shard: what a shard cannot give, the source's others do, over bundles too."""
    monkeypatch.setattr(mixing, "BUNDLE", 8)
    rows = [(i, "v w x y z", "small") for i in range(120)] + [(1000 + i, "w " * 60, "b") for i in range(600)]
    rows += [(5000 + i, "v w x", "c") for i in range(150)]
    _, _, _, words = brute(rows)
    source = {r[0]: r[2] for r in rows}
    sums = dict.fromkeys(words, 0)
    for r in mixing.mix(make(spark, rows), shard_rows=5).collect():
        assert 0 <= r.taken <= 2 * r.size
        sums[source[r.doc_id]] += r.taken
    assert sums == words
