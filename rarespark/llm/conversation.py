"""Repair of conversations at least cost, by depth-first branch-and-bound.

A repaired conversation's roles start with the letters ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.
Every row is kept (K, free), given another role (R, 1) or deleted (D, 2); empty turns may be inserted (I, 5). Blank rows and repeats must be
deleted; a truncated row that stays costs 5 more. Wanted is the cheapest list of edits, of equally cheap ones the least by
ASCII, written as one letter an edit: the audit.

``search`` is the branch-and-bound: nodes are (rows done, last letter), an explicit stack holds prefixes, children are tried in order of cost
plus suffix bound, then letter; a prefix goes if its cost plus the suffix bound cannot beat the incumbent (cost, audit), or if
its node's dominance table holds a prefix that is cheaper, or as cheap and less. The search ends when the stack is empty, which proves the
incumbent.

Rows are dealt by ranges of (conversation, turn, role, text) and sorted, so a conversation that holds a third of all rows spreads
over many tasks. A task cuts each conversation into segments of at most ``SEGMENT_ROWS`` rows and about ``SEGMENT_BYTES``. A conversation of one
segment, the usual case, is repaired on the spot. For others a segment is solved for every pair of entry and exit letter; inserts
stand only before rows, so no audit of a segment is the beginning of another, and their order decides between equal costs. A chain
over a conversation's segments, a few numbers each, picks entry and exit of every segment; the chosen audits go back to the
rows by a join. Repeats across segments are found by grouping digests. The SHA-256 of a whole conversation cannot be split: one task
reads its segments in order, holding one at a time.

Missing roles and texts are one blank (and so blank rows or unknown roles); a missing ``conv_id`` is a conversation of its own; rows
without turn come first; rows of equal turn go by role, then text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20
#: Repairs of short conversations that a task remembers.
REPAIRS_KEPT = 50_000
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Separators; all other characters are parts of words (fixed value).
SPACE = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")
#: The state is the last letter that was put out: none, s, u or a; the next role that may follow it.
NONE, S, U, A = range(4)
NEXT, ROLE = (U, U, A, U), {U: "user", A: "assistant"}
#: What ends a conversation: cost and inserts by last letter.
CLOSING = {NONE: (0, ""), S: (2 * INSERT, "II"), U: (INSERT, "I"), A: (0, "")}
#: Pairs of entry and exit letter that any edits can join.
PAIRS = [(q, e) for q in range(4) for e in range(4) if e in {NONE: (NONE, S, U, A), S: (S, U, A), U: (U, A), A: (U, A)}[q]]
BIG = 1 << 60


# -- one segment ----------------------------------------------------------------------------------


def edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a row.

    ``code``: ``-`` must go, else the role's letter (``o``: another role), in upper case if the text is truncated.
    """
    out = [("D", DELETE, state)]
    if code != "-":
        more, role = (TRUNCATED if code.isupper() else 0), code.lower()
        if role == "s" and state == NONE:
            out.append(("K", more, S))
        elif role in "ua" and NEXT[state] == (U if role == "u" else A):
            out.append(("K", more, NEXT[state]))
        out.append(("R", more + REROLE, NEXT[state]))
    return out


EDITS = {(c, q): edits(c, q) for c in "-suaoSUAO" for q in range(4)}


def suffix_bounds(codes: str, finish: dict[int, tuple[int, str]]) -> list[list[int]]:
    """Lower bound of the cost of the rows from each place on, by state; which audit is least is left open."""
    bounds = [[finish.get(q, (BIG, ""))[0] for q in range(4)]]
    for code in reversed(codes):
        after = bounds[-1]
        row = [min(cost + after[to] for _, cost, to in EDITS[code, q]) for q in range(4)]
        bounds.append([min(row[q], INSERT + row[NEXT[q]], 2 * INSERT + row[NEXT[NEXT[q]]]) for q in range(4)])
    return bounds[::-1]


def search(codes: str, entry: int, finish: dict[int, tuple[int, str]], bounds: list[list[int]]) -> tuple[int, str] | None:
    """Least (cost, audit) from ``entry`` to a state of ``finish``, whose cost and inserts are added; ``None`` if there is no way."""
    best: tuple[int, str] | None = None
    dominant: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        low = cost + bounds[at][state]
        if low >= BIG or best and (low > best[0] or low == best[0] and audit > best[1][:len(audit)]):
            continue
        seen = dominant.get((at, state))
        if seen and seen <= (cost, audit):
            continue
        dominant[at, state] = (cost, audit)
        if at == len(codes):
            if state in finish:
                found = (cost + finish[state][0], audit + finish[state][1])
                best = min(best, found) if best else found
            continue
        children = [(cost + c, letter, at + 1, to) for letter, c, to in EDITS[codes[at], state]]
        if not audit.endswith("II"):
            children.append((cost + INSERT, "I", at, NEXT[state]))
        children.sort(key=lambda c: (c[0] + bounds[c[2]][c[3]], c[1]), reverse=True)
        stack.extend((place, to, c, audit + letter) for c, letter, place, to in children)
    return best


def solve(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return search(codes, NONE, CLOSING, suffix_bounds(codes, CLOSING))


def solve_pairs(codes: str) -> list[tuple[int, str] | None]:
    """The same for a segment and every pair of ``PAIRS``."""
    bounds = {e: suffix_bounds(codes, {e: (0, "")}) for e in range(4)}
    return [search(codes, q, {e: (0, "")}, bounds[e]) for q, e in PAIRS]


def faults(roles: list[str], texts: list[str], marks: list[bytes], seen: set[bytes]) -> tuple[str, int, int, int]:
    """Codes of the rows, and the numbers of blank, repeated and truncated ones; ``seen`` are digests of earlier rows and grows."""
    codes, blank, repeated, truncated = [], 0, 0, 0
    for role, text, mark in zip(roles, texts, marks):
        words = text.rstrip(SPACE)
        known = mark in seen
        seen.add(mark)
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not words:
            blank += 1
            code = "-"
        elif known:
            repeated += 1
            code = "-"
        elif words[-1] not in ".!?":
            truncated += 1
            code = code.upper()
        codes.append(code)
    return "".join(codes), blank, repeated, truncated


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def spread(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def apply_audit(audit: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The repaired rows, roles and texts, that an audit makes of a segment entered in state ``entry``."""
    state, row, out = entry, 0, ([], [])
    for letter in audit:
        if letter != "D":
            state = S if letter == "K" and state == NONE and roles[row].startswith("s") else NEXT[state]
            out[0].append(roles[row] if letter == "K" else ROLE[state])
            out[1].append("" if letter == "I" else texts[row])
        row += letter != "I"
    return out


def lines(roles: list[str], texts: list[str]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()


# -- on Spark -------------------------------------------------------------------------------------


def _rows(conversations: DataFrame, present: Column, copies: Column) -> DataFrame:
    """Present rows in order of conversation, turn, role and text, with a number that follows this order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                present.alias("present"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    order = ["conv_id", "turn", "role"]
    # A text's beginning is enough to deal rows of one turn out; whole texts only order them inside a task.
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 16)).sortWithinPartitions(*order, "text")
    return dealt.select("conv_id", "turn", "role", "text", "present", F.monotonically_increasing_id().alias("at"))


SEGMENT = "conv_id {0}, segment bigint, turns array<{1}>, roles array<string>, texts array<string>, marks array<binary>"


def _cut(kind: pa.DataType):
    """Sorted rows to segments; a segment's number is that of its first row."""
    def pack(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        types = [conv, pa.int64(), pa.list_(kind), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          names=["conv_id", "segment", "turns", "roles", "texts", "marks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, segment, filled, held, conv = [], None, 0, 0, None
        for batch in batches:
            conv = batch.column("conv_id").type
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "present", "at")]
            for conv_id, turn, role, text, present, at in zip(*columns):
                if segment is None or segment[0] != conv_id or len(segment[2]) >= SEGMENT_ROWS or filled >= SEGMENT_BYTES:
                    if segment is not None:
                        done.append(segment)
                        held += filled
                    if held >= SEGMENT_BYTES or len(done) >= 1000:
                        yield pack(done, conv)
                        done, held = [], 0
                    segment, filled = (conv_id, at, [], [], [], []), 0
                if present:
                    raw = text.encode()
                    filled += len(raw) + len(role)
                    mark = hashlib.blake2b(f"{len(role)}:{role}".encode() + raw, digest_size=16).digest()
                    for column, value in zip(segment[2:], (turn, role, text, mark)):
                        column.append(value)
        if segment is not None:
            yield pack([*done, segment], conv)
    return work


def segments(conversations: DataFrame, present: Column, copies: Column) -> DataFrame:
    """Bounded pieces of conversations in order; a conversation without present rows has an empty one."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = _rows(conversations, present, copies)
    turn = rows.schema["turn"].dataType
    schema = SEGMENT.format(rows.schema["conv_id"].dataType.simpleString(), turn.simpleString())
    return rows.mapInArrow(_cut(to_arrow_type(turn)), schema)


FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
WHOLE = f"conv_id {{}}, {FIGURES}, audit string, segment bigint, roles array<string>, texts array<string>"


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one segment; those of equal codes have equal repairs."""
    known: dict[str, tuple[int, str]] = {}
    for batch in batches:
        out = []
        for turns, roles, texts, marks in zip(*(batch.column(n).to_pylist() for n in ("turns", "roles", "texts", "marks"))):
            codes, blank, repeated, truncated = faults(roles, texts, marks, set())
            if codes not in known:
                if len(known) >= REPAIRS_KEPT:
                    known.clear()
                known[codes] = solve(codes)
            cost, audit = known[codes]
            out.append((gaps(*spread(turns)), blank, repeated, truncated, illegal(roles), cost, audit, *apply_audit(audit, NONE, roles, texts)))
        figures = list(zip(*out)) if out else [()] * 9
        kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        arrays = [pa.array(c, t) for c, t in zip(figures, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays[:7], batch.column("segment"), *arrays[7:]], names=[
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "segment", "roles", "texts"])


SOLVED = ("conv string, conv_id {0}, segment bigint, first {1}, last {1}, turns bigint, opens string, closes string, illegal bigint, blank bigint, "
          "duplicate bigint, truncated bigint, rows bigint, costs array<bigint>, ranks array<bigint>, audits array<string>")


def _solve_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = ("conv", "conv_id", "segment", "turns", "roles", "texts", "marks", "earlier")
        for conv, conv_id, segment, turns, roles, texts, marks, earlier in zip(*(batch.column(n).to_pylist() for n in names)):
            codes, blank, repeated, truncated = faults(roles, texts, marks, set(earlier or ()))
            found = solve_pairs(codes)
            audits = sorted({f[1] for f in found if f})
            row = {"conv": conv, "conv_id": conv_id, "segment": segment, **dict(zip(("first", "last", "turns"), spread(turns))),
                   "opens": roles[0][:1] if roles else "", "closes": roles[-1][:1] if roles else "", "illegal": illegal(roles), "blank": blank,
                   "duplicate": repeated, "truncated": truncated, "rows": len(roles), "costs": [f[0] if f else None for f in found],
                   "ranks": [audits.index(f[1]) if f else None for f in found], "audits": [f[1] if f else None for f in found]}
            kinds = {"conv": pa.string(), "conv_id": batch.column("conv_id").type, "first": batch.column("turns").type.value_type,
                     "last": batch.column("turns").type.value_type, "opens": pa.string(), "closes": pa.string(), "costs": pa.list_(pa.int64()),
                     "ranks": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row))


def chain(costs: list[list[int | None]], ranks: list[list[int | None]]) -> tuple[int, list[int], str]:
    """Cost, the pair that every segment takes (a place in ``PAIRS``), and the closing inserts."""
    after = [[CLOSING[q][0] for q in range(4)]]
    for cost in reversed(costs):
        row = [BIG] * 4
        for (q, e), c in zip(PAIRS, cost):
            if c is not None:
                row[q] = min(row[q], c + after[-1][e])
        after.append(row)
    after.reverse()
    state, path = NONE, []
    for i, (cost, rank) in enumerate(zip(costs, ranks)):
        ways = [(rank[k], k) for k, (q, e) in enumerate(PAIRS) if q == state and cost[k] is not None and cost[k] + after[i + 1][e] == after[i][q]]
        path.append(min(ways)[1])
        state = PAIRS[path[-1]][1]
    return after[0][NONE], path, CLOSING[state][1]


CHAINED = f"conv string, conv_id {{}}, {FIGURES}, path array<struct<segment:bigint,pair:int,closing:string>>"


def _chain_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    cost, path, closing = chain([r["costs"] for r in rows], [r["ranks"] for r in rows])
    distinct, wrong, first, last, before = 0, sum(r["illegal"] for r in rows), None, None, ""
    for r in rows:
        if r["first"] is not None:
            distinct += r["turns"] - (last == r["first"])
            first, last = r["first"] if first is None else first, r["last"]
        if r["rows"]:
            wrong += bool(before) and before[1:] + r["opens"] not in LEGAL
            before = "." + r["closes"]
    total = [sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated")]
    steps = [{"segment": r["segment"], "pair": k, "closing": ""} for r, k in zip(rows, path)]
    steps[-1]["closing"] = closing
    kind = pa.list_(pa.struct([("segment", pa.int64()), ("pair", pa.int32()), ("closing", pa.string())]))
    values = [gaps(first, last, distinct), *total, wrong, cost]
    return pa.Table.from_arrays([pa.array([rows[0]["conv"]], pa.string()), pa.array([rows[0]["conv_id"]], table.schema.field("conv_id").type),
                                 *[pa.array([v], pa.int64()) for v in values], pa.array([steps], kind)],
                                names=["conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "path"])


def _apply_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs, audits, roles, texts = (batch.column(n).to_pylist() for n in ("pair", "audit", "roles", "texts"))
        out = [apply_audit(a, PAIRS[p][0], r, t) for p, a, r, t in zip(pairs, audits, roles, texts)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("segment"), pa.array([o[0] for o in out], pa.list_(pa.string())),
                                          pa.array([o[1] for o in out], pa.list_(pa.string()))], names=["conv", "segment", "roles", "texts"])


FIGURE_NAMES = ["conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _repaired(conversations: DataFrame, present: Column | None, copies: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations of one segment with figures and rows; the figures of the others; their repaired segments."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    kind, turn = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    cut = stage(segments(conversations, F.lit(True) if present is None else present, F.lit(1) if copies is None else copies)
                .select(conv, "*"))
    several = stage(cut.groupBy("conv").count().where("count > 1").select("conv"))
    whole = cut.join(several, "conv", "left_anti").drop("conv").mapInArrow(_repair_whole, WHOLE.format(kind)).select(conv, "*")

    pieces = cut.join(several, "conv", "left_semi")
    marks = pieces.select("conv", "segment", F.explode("marks").alias("mark"))
    first = marks.groupBy("conv", "mark").agg(F.min("segment").alias("first"), F.max("segment").alias("last")).where("first < last")
    earlier = marks.join(first, ["conv", "mark"]).where("segment > first").groupBy("conv", "segment").agg(F.collect_set("mark").alias("earlier"))
    solved = stage(pieces.join(earlier, ["conv", "segment"], "left").mapInArrow(_solve_segments, SOLVED.format(kind, turn)))
    chained = stage(solved.drop("audits").groupBy("conv").applyInArrow(_chain_group, CHAINED.format(kind)))
    audits = stage(chained.select("conv", F.inline("path")).join(solved.select("conv", "segment", "audits"), ["conv", "segment"])
                   .select("conv", "segment", "pair", F.concat(F.get("audits", "pair"), "closing").alias("audit")))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda s: s["audit"])
    figures = chained.join(audits.groupBy("conv").agg(F.array_join(in_order, "").alias("audit")), "conv").select(*FIGURE_NAMES)
    put = pieces.join(audits, ["conv", "segment"]).mapInArrow(_apply_segments, REPAIRED)
    return whole, figures, put


REPAIRED = "conv string, segment bigint, roles array<string>, texts array<string>"


def repair(conversations: DataFrame, present: Column | None = None, copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired conversations.

    Report, a row per conversation: ``conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. Repaired: ``conv``
    (``conv_id`` as text, one blank if missing), ``segment`` (in order) and the arrays ``roles`` and ``texts``. Rows for which ``present`` is
    false count only as naming their conversation; ``copies`` is how often a row stands.
    """
    whole, figures, put = _repaired(conversations, present, copies)
    return whole.select(*FIGURE_NAMES).unionByName(figures), whole.select("conv", "segment", "roles", "texts").unionByName(put)


def summarise(conversations: DataFrame, present: Column | None = None, copies: Column | None = None) -> DataFrame:
    """The report with ``repaired_sha256``, the digest of a conversation's repaired lines ``role:text``."""
    whole, figures, put = _repaired(conversations, present, copies)
    text = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    return (whole.select(*FIGURE_NAMES, F.sha2(text, 256).alias("repaired_sha256"))
            .unionByName(figures.join(digests(put), "conv").select(*FIGURE_NAMES, "repaired_sha256"))).drop("conv")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, from its segments in order; one segment is held at a time."""
    pack = lambda conv, text: pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([text])], names=["conv", "repaired_sha256"])
    now, state, some = None, None, False
    for batch in batches:
        for i, conv in enumerate(batch.column("conv").to_pylist()):
            if conv != now:
                if now is not None:
                    yield pack(now, state.hexdigest())
                now, state, some = conv, hashlib.sha256(), False
            roles, texts = batch.column("roles")[i].as_py(), batch.column("texts")[i].as_py()
            if roles:
                state.update((b"\n" if some else b"") + lines(roles, texts))
                some = True
    if now is not None:
        yield pack(now, state.hexdigest())


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of repaired conversations: lines ``role:text``."""
    return repaired.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(_digest, "conv string, repaired_sha256 string")
