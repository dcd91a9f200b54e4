import hashlib
import os
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from rarespark.llm import bpe, quality  # noqa: E402
from rarespark.llm.registry import vocabulary  # noqa: E402
from .test_minhash import brute as groups  # noqa: E402
from .test_mixing import brute as targets  # noqa: E402
from .test_quality import corpus  # noqa: E402
from .test_units import brute as cut  # noqa: E402

LINE = "Common title.\nthis passage stands in several documents and is long enough to be looked at because it has more than twenty words in all of it"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, _ = corpus()
    docs = docs[:500]
    rows = [(i, f"{t}\n{LINE}" if i % 7 == 0 else f"Common title.\n{t}" if i % 7 == 1 else t) for i, t in docs]
    rows += [(2000 + i, t + " end") for i, t in docs[:60]] + [(3000, None), (3001, ""), (3002, ""), (1, docs[1][1]), (None, docs[2][1])]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(i, t, "en", None if i and i % 10 == 0 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.withColumn("score", F.lit("clash")).withColumn("removed", F.lit(1)).withColumn("kept", F.lit(2)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_against_a_plain_form(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "bpe_tokens":
            assert docs.columns == columns
    rows = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    after = {a: seen[b] for a, b in zip([n for n, _ in corpus_pipeline.STAGES], [n for n, _ in corpus_pipeline.STAGES][1:])} | {"bpe_tokens": docs}

    start = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality.score(start, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert sorted((r.doc_id for r in scores if r.predicted), key=repr) == sorted((d for d, _ in rows(after["quality_classifier"])), key=repr)

    before = rows(seen["minhash_near_dedup"])
    want = {g[0] for g in groups(before, 5) if g[3]}
    got = rows(after["minhash_near_dedup"])
    assert {d for d, _ in got} == want and len(got) == len(want)
    assert len(got) < len(before)

    before = rows(seen["line_dedup"])
    lines = after["line_dedup"].select("doc_id", "text", "n_chars").collect()
    assert sorted((r.doc_id or -1, r.text) for r in lines) == sorted((c[0] or -1, c[3]) for c in cut(before, 20))
    assert all(r.n_chars == len(r.text) for r in lines) and sum(LINE.split("\n")[1] in r.text for r in lines) == 1
    assert sum("Common title." in r.text for r in lines) > 50  # short lines that repeat stay

    table = [tuple(r) for r in seen["source_mix"].select("doc_id", "text", "source").collect()]
    size, total, target, _ = targets(table)
    mixed = after["source_mix"].select("text", "source").collect()
    words = {n: sum(len((r.text or "").split()) for r in mixed if r.source == n) for n in total}
    assert all(abs(words[n] - target[n]) <= 0.02 * target[n] + 16 * 8 for n in total)

    ranks = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [(r.doc_id, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in docs.collect()]
    plain = []
    for doc, text in rows(seen["bpe_tokens"]):
        ids = library.encode_ordinary(text or "")
        plain.append((doc, ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tokens, key=repr) == sorted(plain, key=repr)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
