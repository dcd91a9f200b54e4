import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from rarespark.llm import bpe, fertility
from rarespark.llm.registry import vocabulary

NAMES = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(docs):
    return fertility.judge(docs, {n: vocabulary(n) for n in NAMES}, public_tokenizers.PATTERN)


def sentences():
    rng = random.Random(3)
    words = "the of and that with from which house water street morning because people found small every between night".split()
    clean = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    return clean, [" ".join(w.upper() + "%%&&##" for w in t.split()) for t in clean[:3]]


def brute(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAMES[0]))
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary(NAMES[1])), special_tokens={})
    tokens = [[i for w in words for i in model.encode(w)], [i for w in words for i in coder.encode_ordinary(" " + w)]]
    n = sum(map(len, tokens))
    entropy = sum(-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) for t in tokens if t)
    most = sum(math.log2(min(max(len(t), 2), size)) for t, size in zip(tokens, (32000, 50256)))
    chars = sum(map(len, words))
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(inside), n, pytest.approx(2 * chars / max(n, 1)), pytest.approx(entropy / most))


def test_figures_against_brute_force(spark):
    clean, junk = sentences()
    rows = [(1, clean[0], "en"), (2, None, "en"), (3, "", None), (4, "a b c a b c\n\n \na\na\x1c\x85b", None), (5, "été 中文 👍 <<>> ***\n" * 3, "fr"),
            (6, "x" * 20_000, None), (7, " ".join(map(str, range(9000))), "en"), (7, junk[0], "en"), (None, "one\ntwo\none", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("kept", F.lit("clash"))
    got = run(docs).collect()
    assert len(got) == len(rows)
    for doc, text, lang in rows:
        r = next(g for g in got if g.doc_id == doc and g.n_words == len(WORD.findall(text or "")))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, r.chars_per_token, r.entropy) == brute(text or "")
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.band == (lang or f"script:{fertility.script(text or '')}")
    assert run(docs.limit(0)).count() == 0


def test_junk_is_outside_and_clean_text_inside(spark):
    clean, junk = sentences()
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(1000 + i, t, "en") for i, t in enumerate(junk)] + [(2000 + i, junk[0], "en") for i in range(80)]
    got = {r.doc_id: r.kept for r in run(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i] for i in range(len(clean)))
    assert not any(kept for doc, kept in got.items() if doc >= 1000)


def test_scripts_and_byte_share(spark):
    assert [fertility.script(t) for t in ("abc é", "привет", "中文", "123 !", "ひらがな")] == ["latin", "cyrillic", "han", "none", "kana"]
    rows = [(1, "plain words " * 30, "en"), (2, "𐎀𐎁 𐎂 " * 30, "uga")]
    share = {r.doc_id: r.byte_share for r in run(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert share[1] == 0 and share[2] > 0.4
