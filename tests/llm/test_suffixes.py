import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.llm import suffixes


def brute(rows, width):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(scale):
    """Passages of about ``scale`` bytes in changing surroundings, edited copies, periodic texts."""
    rng = random.Random(scale)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(rng.randrange(scale - 8, 3 * scale)) for _ in range(8)]
    texts = [noise(rng.randrange(0, scale)) + rng.choice(passages)[rng.randrange(0, 9):] + noise(rng.randrange(0, scale)) + rng.choice(passages) for _ in range(40)]
    base = noise(8 * scale)
    for _ in range(12):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = rng.choice("xyz")
        texts.append("".join(own))
    texts += [texts[0], texts[0], "be " * scale, "be " * scale + "x" + "be " * scale, "ab" * (scale // 2), "a" * scale, "a" * (scale + 1), "x" * scale, base[:scale], base[:scale - 1] + "!"]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, texts[3]), (7, texts[9]), (7, texts[9])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [24, 60, 200])
def test_against_brute_force(spark, width):
    rows = corpus(width)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_bytes", F.lit("clash")).repartition(4)
    assert sorted(map(tuple, suffixes.remove(docs, width).collect()), key=repr) == brute(rows, width)


def test_bytes_and_spans(spark):
    rows = [(1, "x" * 30 + "0123456789abcdefghijklmnop" + "y"), (2, "é0123456789abcdefghijklmnopq"), (3, "nothing")]
    got = {r.doc_id: r for r in suffixes.remove(spark.createDataFrame(rows, "doc_id bigint, text string"), 24, with_bytes=True).collect()}
    assert bytes(got[2].kept).decode() == "éq" and list(got[2].spans) == [2, 28]
    assert bytes(got[1].kept).decode() == "y" and list(got[1].spans) == [0, 56]
    assert bytes(got[3].kept).decode() == "nothing" and list(got[3].spans) == []


def test_empty(spark):
    assert suffixes.remove(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_blocks_that_do_not_adjoin_stay_apart():
    """Equal neighbours are one row; not so if blocks between them have been dropped."""
    data = np.frombuffer(b"abcd" * 3 + b"-unlike-" + b"abcdabc", dtype=np.uint8)
    first = np.array([0, 4, 20])
    rows = suffixes._first({"doc": np.zeros(3, int), "anchor": first + 2, "first": first, "count": np.full(3, 4), "hash": np.full(3, 7, np.uint64),
                            "data": data}, 4)
    assert list(zip(rows["start"], rows["stop"], rows["n"])) == [(0, 11, 2), (20, 27, 1)]
