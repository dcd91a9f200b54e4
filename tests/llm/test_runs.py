import hashlib
import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from rarespark.llm import registry, runs


def brute(words):
    """Every lag, every stretch, and the smallest period by trying all."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(words[i:i + size - p] == words[i + p:i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def periodic_text(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        size, vocabulary = rng.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 24, 33, 40, 64, 70]), rng.choice([2, 3, 50])
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
        words += base * rng.choice([1, 2, 3, 4, 4, 5, 9]) + base[:rng.randrange(size)]
        words += [f"x{rng.randrange(1000)}" for _ in range(rng.choice([0, 0, 7]))]
    return words * rng.choice([1, 1, 1, 5])


def test_batches_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        docs = [periodic_text(rng) for _ in range(rng.randint(1, 6))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([" \n".join(d) for d in docs])], names=["doc_id", "text"])
        for words, row in zip(docs, runs._batch(batch).to_pylist()):
            found = [(r["start"], r["length"], r["period"]) for r in row["runs"]]
            assert found == brute(words)
            assert row["collapsed"] == collapsed(words, found) and row["n_words"] == len(words)


def test_long_periods_and_separators():
    base = [f"w{i * i}" for i in range(3000)]
    text = "a\tb\vc\fd \x1cx ".encode().decode() + " ".join(base * 4 + base[:17]) + " end"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    row = runs._batch(batch).to_pylist()[0]
    assert row["runs"] == [{"start": 5, "length": 12_017, "period": 3000}]  # \x1c is a part of a word
    assert row["collapsed"] == "a b c d \x1cx " + " ".join(base) + " end"


def plant(doc, text):
    words = runs_words(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def runs_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_query_with_edge_cases(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, "a b " * 20), (None, None), (5, rows[5][1]), (5, rows[5][1]), (303, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("words", F.lit(1))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_minimizer_runs(spark, str(tmp_path)).collect()
    want = []
    for doc, text in rows:
        words = plant(doc, text)
        found = brute(words) if doc != 303 else [(0, 30_000, 1)]
        top = min(((-n, s, q) for s, n, q in found), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc, len(found), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
                     digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(collapsed(words, found))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(bool(r[1]) for r in want) > 10
    empty = runs.find(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
