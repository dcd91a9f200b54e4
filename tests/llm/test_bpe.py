import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rarespark.llm import bpe
from rarespark.llm.registry import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def hard_texts():
    rng = random.Random(5)
    letters = "aab eés.,!  \n\t'1中文👍\x85 ​ßIı\x1c"
    yield from ("", " ", "\n\n  x", "a" * 5001, "ab" * 3000, "The " * 50, "don't I'LL we've 12345 ***", "<|endoftext|>", "\x00\x1c\x1d")
    for n in (1, 3, 7, 20, 60, 300, 2000):
        for _ in range(40):
            yield "".join(rng.choice(letters) for _ in range(n))
            yield "".join(rng.choice("ethaionsrg") for _ in range(n))
            yield "".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(32, 0x250)])) for _ in range(n))


def test_same_ids_as_the_library(library):
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in hard_texts():
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text[:80])
        assert encoder.decode(ids) == text.encode()


def test_joins_anywhere_give_the_whole(library):
    encoder, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("aaaaethaionsrg") for _ in range(rng.randrange(2, 150))).encode()
        cut = rng.randrange(1, len(piece))
        assert encoder.join(encoder.piece(piece[:cut]), encoder.piece(piece[cut:])) == encoder._merge(piece)
        assert encoder._merge_long(piece) == encoder._merge(piece)


def test_pieces_are_forgotten_by_age(library, monkeypatch):
    """Ids stay the same when pieces are forgotten, and a piece among the last new ones is not encoded again."""
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    made, piece = [], encoder.piece
    monkeypatch.setattr(encoder, "piece", lambda p: made.append(p) or piece(p))
    words = [f" qz{chr(97 + i)}xv" for i in range(12)]
    for text in [*words, words[5], words[5], *words]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert made.count(words[5].encode()) == 1 and len(encoder.known) + len(encoder.older) <= 16


def test_table_with_gaps_and_extra_columns(spark, library):
    rows = [(1, "Of the, ühl"), (2, None), (3, ""), (3, ""), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect())
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert {(r.doc_id, bytes(r.data)) for r in bpe.decode(encoded, VOCABULARY).collect()} == {
        (d, (t or "").encode()) for d, t in rows}
    assert bpe.digests(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
