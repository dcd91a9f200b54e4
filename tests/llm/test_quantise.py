import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.llm import quantise
from rarespark.llm.components import union_find_labels


def brute(rows, least):
    rows = [(i, v, l) for i, v, l in rows]
    good = [v is not None and l is not None and i is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for i, v, l in rows]
    links, a, b = np.zeros(len(rows), dtype=int), [], []
    by = {}
    for k, (i, v, l) in enumerate(rows):
        if good[k]:
            by.setdefault((l, len(v)), []).append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], dtype=float)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        links[ks] = hit.sum(1)
        for p, q in zip(*np.nonzero(hit)):
            a.append(ks[p])
            b.append(ks[q])
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rank = np.argsort(order)
    labels = union_find_labels(len(rows), rank[np.array(a, dtype=int)], rank[np.array(b, dtype=int)])
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = rows[order[labels[rank[k]]]][0] if i is not None else None
        out.append((i, int(links[k]), c, i is None or c == i))
    return sorted(out, key=repr)


def vectors(n, d, seed, spread):
    """Centres with copies at cosines around the threshold, and scattered vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(centre + rng.normal(size=d) * rng.uniform(0, spread))
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(rows[:n])]


@pytest.mark.parametrize("n,d,spread,block", [(900, 16, 0.4, 64), (700, 5, 0.5, 1024)])
def test_every_link_is_found(spark, monkeypatch, n, d, spread, block):
    monkeypatch.setattr(quantise, "BLOCK", block)
    rows = vectors(n, d, 1, spread)
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    rows += [(6000, None, 1), (6001, [0.0] * d, 1), (6002, [float("nan")] * d, 1), (6003, [None] + [1.0] * (d - 1), 1), (6004, rows[3][1], None), (6005, [], 1),
             (6006, [float("inf")] * d, 1), (None, rows[3][1], rows[3][2]), (6007, [1.0, 2.0], 1), (6008, [2.0, 4.0], 1), (6009, [x * 1e30 for x in rows[4][1]], rows[4][2])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("n", F.lit("clash")).repartition(4)
    assert sorted(map(tuple, quantise.link(docs).collect()), key=repr) == brute(rows, 0.93)


def test_one_vec_id_on_unlike_vectors_joins_nothing(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (5, [1.0, 0.1, 0.0], 1), (5, [0.1, 1.0, 0.0], 1), (5, [0.0, 0.0, 1.0], 1)]
    got = quantise.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 0.93)
    assert {(r.vec_id, r.component_id) for r in got} == {(1, 1), (2, 2), (5, 1), (5, 2), (5, 5)}


def test_floats_and_empty(spark):
    rows = vectors(120, 8, 3, 0.3)
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, quantise.link(docs).collect()), key=repr) == brute(rows, 0.93)
    assert quantise.link(docs.limit(0)).count() == 0


def test_codes_narrow_the_search():
    """Table distances never exceed the true distance by more than the code's error, and most pairs need no rerank."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = quantise.Index(x, 4)
    own, far, code, error = index.code(x)
    for of in range(4):
        mine = own == of
        table = index.distances(x, of, code[mine])
        true = np.sqrt(quantise.squared(x, x[mine]))
        assert (np.abs(table - true) <= error[mine] + 1e-6).all()
        assert (table <= np.sqrt(0.14) + error[mine]).mean() < 0.2
    probes = index.probes(own, far, np.sqrt(0.14))
    near = np.sqrt(quantise.squared(x, x)) <= np.sqrt(0.14)
    assert all(probes[i, own[np.flatnonzero(near[i])]].all() for i in range(len(x)))
