import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rarespark.llm import conversation, registry

SPACE = " \t\n\v\f\r"


def brute(codes):
    """All edit lists with at most two inserts."""
    best = [None]

    def go(i, q, cost, audit, inserts):
        if best[0] and cost > best[0][0]:
            return
        if i == len(codes) and q in (0, 3):
            best[0] = min(best[0], (cost, audit)) if best[0] else (cost, audit)
        if i < len(codes):
            code = codes[i]
            go(i + 1, q, cost + 2, audit + "D", inserts)
            if code != "-":
                more = 5 if code.isupper() else 0
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(code.lower())
                if to:
                    go(i + 1, to, cost + more, audit + "K", inserts)
                go(i + 1, 3 if q == 2 else 2, cost + more + 1, audit + "R", inserts)
        if inserts < 2:
            go(i, 3 if q == 2 else 2, cost + 5, audit + "I", inserts + 1)
    go(0, 0, 0, "", 0)
    return best[0]


def table(codes):
    """The same without a limit of inserts, row by row, for long conversations."""
    best = {0: (0, "")}
    for code in codes:
        for _ in range(2):
            for q, (cost, audit) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (1 << 40, "")), (cost + 5, audit + "I"))
        new = {}
        for q, (cost, audit) in best.items():
            for letter, c, to in conversation.edits(code, q):
                new[to] = min(new.get(to, (1 << 40, "")), (cost + c, audit + letter))
        best = new
    ends = [(best[q][0] + c, best[q][1] + i) for q, c, i in ((0, 0, ""), (3, 0, ""), (2, 5, "I"), (1, 10, "II")) if q in best]
    return min(ends)


def random_codes(rng, n):
    return "".join(rng.choice("-suaoSUAO" if rng.random() < 0.5 else "uaua") for _ in range(n))


def test_search_against_all_edit_lists():
    rng = random.Random(1)
    for _ in range(1500):
        codes = random_codes(rng, rng.randrange(7))
        assert conversation.solve(codes) == brute(codes) == table(codes)


def test_segments_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        codes = random_codes(rng, rng.randrange(60))
        cuts = [0, *sorted(rng.randrange(len(codes) + 1) for _ in range(rng.randrange(6))), len(codes)]
        found = [conversation.solve_pairs(codes[a:b]) for a, b in zip(cuts, cuts[1:])]
        orders = [sorted({f[1] for f in way if f}) for way in found]
        cost, path, closing = conversation.chain([[f and f[0] for f in way] for way in found],
                                                 [[order.index(f[1]) if f else None for f in way] for way, order in zip(found, orders)])
        assert (cost, "".join(way[k][1] for way, k in zip(found, path)) + closing) == table(codes)


def test_a_loose_bound_gives_the_same():
    """Optimality comes from the search, not from the bound's tightness."""
    rng = random.Random(3)
    for _ in range(200):
        codes = random_codes(rng, rng.randrange(9))
        none = [[0] * 4 for _ in range(len(codes) + 1)]
        assert conversation.search(codes, 0, conversation.CLOSING, none) == table(codes)


def repaired(audit, rows):
    state, out, i = 0, [], 0
    for e in audit:
        role = {2: "assistant"}.get(state, "user")
        if e == "K" and state == 0 and rows[i][0].startswith("s"):
            state = 1
            out.append(":".join(rows[i]))
        elif e != "D":
            out.append({"K": ":".join(rows[i]) if i < len(rows) else "", "R": f"{role}:{rows[i][1] if i < len(rows) else ''}", "I": f"{role}:"}[e])
            state = 3 if state == 2 else 2
        i += e != "I"
    return "\n".join(out)


def plain(source):
    """The contract, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text in source:
        own = groups[conv]
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        own.extend([(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1))
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in rows:
            words, code = text.strip(SPACE), role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes += "-" if fault in ("blank", "duplicate") else code.upper() if fault else code
        known = [t for t, _, _ in rows if t is not None]
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = table(codes)
        digest = hashlib.sha256(repaired(audit, [r[1:] for r in rows]).encode()).hexdigest()
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts.values(), wrong, cost, audit, digest))
    return sorted(out, key=repr)


def source():
    rng, rows = random.Random(7), []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         rng.choice(["Hi.", "What now?", "Well", "", " \t", "é!", "same. \n", None, f"text {rng.randrange(99)}."])))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 700}{'.' if t % 11 else ''}") for t in range(3000)]
    rows += [(501, None, None, None)] * 40 + [(502, 5, "user", "x" * 200_000 + ".")] + [(None, t, "assistant", "no id.") for t in range(5)]
    return rows + rows[:50]


@pytest.mark.parametrize("limit", [1024, 37])
def test_query_against_plain_form(spark, tmp_path, monkeypatch, limit):
    """Also with segments so short that most conversations are chained."""
    monkeypatch.setattr(conversation, "SEGMENT_ROWS", limit if limit > 100 else 3)
    rows = source()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit("clash")).withColumn("conv", F.lit(1))
    frame.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.op13_branch_and_bound(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 3, "tool", "Yes."), (2, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    report, put = conversation.repair(frame)
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (3, "KKDR"), 2: (2, "D")}
    assert {r.conv: (r.roles, r.texts) for r in put.collect()} == {
        "1": (["system", "user", "assistant"], ["Be kind.", "Hello?", "Yes."]), "2": ([], [])}
    report, put = conversation.repair(frame.limit(0))
    assert report.count() == 0 and put.count() == 0
