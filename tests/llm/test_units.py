import re

from pyspark.sql import functions as F

from rarespark.llm import units

PASSAGE = ("This passage was put into several texts. It has more than fifty words in all, over a few sentences! Some of them are rather short. Others go on for a "
           "while, with version 2.0 of this and that? The beginning and the end may lie in the middle\nof a line, because whoever put it there did not look at "
           "lines at all. That is the usual case.")
VERSE = "\n".join(f"verse {i}" for i in range(30))
ROWS = [(1, f"Own start {PASSAGE} own end one.\nLicensed under MIT.\nshort line"), (2, f"Title\nLicensed under MIT.\nAnother start, {PASSAGE.upper()}\n\nshort line"),
        (3, None), (4, ""), (2, f"Title\nLicensed under MIT.\nAnother start, {PASSAGE.upper()}\n\nshort line"), (None, f"x\n{PASSAGE}"),
        (5, "\n" + "\n".join(f"{PASSAGE} {i}" for i in range(30))), (6, "é " * 30 + "\n" + f"{PASSAGE} 7"), (7, "w" * 100_000), (8, "x\n" * 2000),
        (9, f"Own nine\n{VERSE}"), (10, f"Own ten\n {VERSE.replace(' ', '  ')}\n"), (11, "Own eleven\nLicensed under MIT."), (12, "..!? \n\n. a.b.c ...")]


def pieces(text):
    """Sentences within lines, by hand: a unit ends with a line, or with white space behind . ! or ?."""
    out, now, ended = [], "", False
    for i, c in enumerate(text):
        space = c in " \t\n\v\f\r"
        if ended and not space:
            out.append(now)
            now, ended = "", False
        now += c
        ended = ended or c == "\n" or (space and now[-2:-1] in (".", "!", "?"))
    return out + [now] if now else out


def brute(rows, min_words):
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    seen, out = set(), {}
    for doc, text in order:
        own = pieces(text)
        words = [re.findall(r"[^\x20\x09-\x0D]+", u.lower()) for u in own]
        gone = set()
        for i in range(len(own)):
            run = next((j for j in range(i, len(own)) if sum(map(len, words[i:j + 1])) >= min_words), None)
            if words[i] and run is not None:
                form = " ".join(w for u in words[i:run + 1] for w in u)
                if form in seen:
                    gone.update(range(i, run + 1))
                seen.add(form)
        spans, at = [], 0
        for i, u in enumerate(own):
            if i in gone:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(u))
                else:
                    spans.append((at, at + len(u)))
            at += len(u)
        out[doc, text] = (doc, len(gone), " ".join(f"{a}:{b}" for a, b in spans), "".join(u for i, u in enumerate(own) if i not in gone))
    return sorted((out[d, t or ""] for d, t in rows), key=repr)


def test_units_cut_as_by_hand():
    for _, text in ROWS:
        assert units.cut_units(text or "", "sentence") == pieces(text or "")
        for unit in units.CUTS:
            assert "".join(units.cut_units(text or "", unit)) == (text or "")
    assert units.cut_units("a\n\nb c\nd\n\n\ne", "paragraph") == ["a\n\n", "b c\nd\n\n\n", "e"]
    assert units.cut_units("a. b\n\nc", "line") == ["a. b\n", "\n", "c"]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("removed", F.lit("clash")).repartition(3)
    for least in (1, 7, 20):
        got = sorted(map(tuple, units.report(docs, min_words=least).collect()), key=repr)
        assert got == brute(ROWS, least)


def test_passages_go_and_short_repeats_stay(spark):
    got = {r.doc_id: r.text for r in units.dedup_text(spark.createDataFrame(ROWS, "doc_id bigint, text string")).collect()}
    assert got[1] == ROWS[0][1] and got[11] == "Own eleven\nLicensed under MIT." and got[9] == ROWS[10][1]
    assert "VERSION 2.0" not in got[2] and got[2].startswith("Title\nLicensed under MIT.\n") and got[2].endswith("short line")
    assert "verse" not in got[10] and got[10].startswith("Own ten")
    assert sum("with version 2.0 of this" in t.lower() for t in got.values()) == 1  # one copy of all stays


def test_columns_pass_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    out = units.dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "n_removed", "removed"] and out.count() == len(ROWS)
    assert units.report(docs.limit(0)).count() == 0
    paragraphs = units.dedup(spark.createDataFrame([(1, f"{PASSAGE}\n\nb"), (2, f"a\n\n{PASSAGE}")], "doc_id bigint, text string"), "paragraph")
    assert {(r.doc_id, r.text) for r in paragraphs.collect()} == {(1, f"{PASSAGE}\n\nb"), (2, "a\n\n")}
