"""Counting value combinations ("cells") and finding the rare ones.

Every analysed column is a small set of codes, so a combination over a column set is one number in a
mixed-radix system and the whole counting is hash aggregation of longs. Column sets are listed on
the driver from the cardinalities alone; their cells are bounded by the combination limit of the
gate, because the sum of cardinality products over all sets of a size never exceeds the gate's
estimate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import MAX_DIMENSIONS, MAX_RARE_FRACTION, MIN_EXPECTED_ROWS, RarityConfig

CODE = "__code"
ITEM_BASE = 1 << 32  # an item is column position * base + code
WORD_BITS = 64
FAN_OUT_PER_TASK = 100_000
BROADCAST_BYTES = 64 << 20  # measured size of all dictionaries together that may be broadcast
DIGITS = range(MAX_DIMENSIONS)
BATCHES = 8  # jobs that share a dimension's column sets when there is a time budget


@dataclass(frozen=True)
class Dictionary:
    """Labels too many for the driver: a stored table ``label, code, cnt``, its rows and its bytes."""

    table: DataFrame
    size: int
    bytes: int


@dataclass(frozen=True)
class CodedColumn:
    """An analysed column after encoding: codes 0..size-1, their labels and row counts, or a dictionary of these."""

    name: str
    kind: str
    labels: tuple[str, ...]
    counts: tuple[int, ...]
    dictionary: Dictionary | None = None

    @property
    def size(self) -> int:
        return self.dictionary.size if self.dictionary else len(self.counts)


@dataclass(frozen=True)
class ColumnSet:
    """A set of column positions with its place values."""

    members: tuple[int, ...]
    places: tuple[int, ...]
    product: int

    @property
    def dim(self) -> int:
        return len(self.members)

    @classmethod
    def of(cls, members: Sequence[int], sizes: Sequence[int]) -> "ColumnSet":
        places, product = [], 1
        for m in reversed(members):
            places.append(product)
            product *= sizes[m]
        return cls(tuple(members), tuple(reversed(places)), product)

    def key_sql(self, code_sql=lambda m: f"`{CODE}{m}`") -> str:
        terms = [code_sql(m) if p == 1 else f"{code_sql(m)} * {p}L" for m, p in zip(self.members, self.places)]
        return f"cast({' + '.join(terms)} as bigint)"


@dataclass
class CellPlan:
    """Which column sets are examined, in explanation order, and how they are grouped for counting."""

    columns: list[CodedColumn]
    rows: int
    cfg: RarityConfig
    estimates: dict[int, float] = field(default_factory=dict)
    checked: dict[int, bool] = field(default_factory=dict)
    sets: list[ColumnSet] = field(default_factory=list)

    def __post_init__(self):
        sizes = self.sizes = [c.size for c in self.columns]
        n = len(sizes)
        mean = sum(sizes) / n
        running = True
        for d in range(1, 7):
            self.estimates[d] = math.comb(n, d) * mean ** d
            if d > 1:
                running = (running and d <= self.cfg.max_dimensions and d <= n
                           and self.estimates[d] <= self.cfg.max_num_combinations)
            self.checked[d] = running
            if running:
                self.sets += [s for s in (ColumnSet.of(m, sizes) for m in combinations(range(n), d))
                              if d < 3 or not self.rows * (1.0 / s.product) < MIN_EXPECTED_ROWS]

    def limit_to(self, dim: int) -> None:
        """Keep the dimensions up to ``dim`` only."""
        self.checked = {d: on and d <= dim for d, on in self.checked.items()}
        self.sets = [s for s in self.sets if s.dim <= dim]

    def keep_first(self, count: int) -> None:
        """Keep the first ``count`` column sets only; a dimension counts as examined if any set of it was."""
        self.sets = self.sets[:count]
        dims = {s.dim for s in self.sets}
        self.checked = {d: on and (d == 1 or d in dims or d <= max(dims, default=1)) for d, on in self.checked.items()}

    def batches(self, per_dimension: int = BATCHES) -> list[range]:
        """Positions of the column sets in runs of about equally many cells: the single columns, then a few runs per dimension."""
        out: list[range] = []
        for d in range(1, self.examined + 1):
            at = [pos for pos, s in enumerate(self.sets) if s.dim == d]
            share, begin, held = sum(self.sets[pos].product for pos in at) / (per_dimension if d > 1 else 1), None, 0
            for pos in at:
                begin = pos if begin is None else begin
                held += self.sets[pos].product
                if held >= share or pos == at[-1]:
                    out.append(range(begin, pos + 1))
                    begin, held = None, 0
        return out

    @property
    def examined(self) -> int:
        return max(d for d, on in self.checked.items() if on)

    def groups(self) -> list[ColumnSet]:
        """Column groups that cover every examined set, each with a bounded number of patterns.

        One group of all columns when that is small enough; otherwise sets are packed first-fit, so
        that a row updates a few counters instead of one per column set.
        """
        limit, everything = self.cfg.max_group_patterns, tuple(range(len(self.sizes)))
        if math.prod(self.sizes) <= limit:
            return [ColumnSet.of(everything, self.sizes)]
        packed: list[set[int]] = []
        for s in sorted(self.sets, key=lambda s: -s.dim):
            members = set(s.members)
            if any(members <= g for g in packed):
                continue
            for g in packed:
                if math.prod(self.sizes[m] for m in g | members) <= limit:
                    g |= members
                    break
            else:
                packed.append(members)
        return [ColumnSet.of(sorted(g), self.sizes) for g in packed]


def set_table(spark: SparkSession, plan: CellPlan) -> DataFrame:
    """The examined column sets as a (small, gate-bounded) table."""
    rows = [(pos, s.dim, 1.0 / s.product, s.product, list(s.members), list(s.places)) for pos, s in enumerate(plan.sets)]
    return F.broadcast(spark.createDataFrame(
        rows, "pos int, dim int, uniform double, product bigint, members array<int>, places array<bigint>"))


def count_groups(coded: DataFrame, groups: Sequence[ColumnSet], weight: str | None = None) -> DataFrame:
    """``(grp, key, cnt)``: rows per pattern of every column group, combined map-side."""
    cnt = F.sum(weight) if weight else F.count("*")
    if len(groups) == 1:
        key = F.expr(groups[0].key_sql()).alias("key")
        return (coded.select(*([weight] if weight else []), key).groupBy("key").agg(cnt.alias("cnt"))
                .select(F.lit(0).alias("grp"), "key", "cnt"))
    keys = F.expr("array(" + ", ".join(g.key_sql() for g in groups) + ")")
    picked = coded.select(*([weight] if weight else []), F.posexplode(keys).alias("grp", "key"))
    return picked.groupBy("grp", "key").agg(cnt.alias("cnt"))


def fan_out(patterns: DataFrame, groups: Sequence[ColumnSet], plan: CellPlan, only: range | None = None) -> DataFrame:
    """Patterns ``(grp, key, cnt)`` with their cells ``(pos, cell)``: one row per column set a group owns.

    The sets come as a broadcast table joined on the group. A cell's key moves the digits of the
    set's columns from their places in the pattern key to their places in the set.
    """
    rows, fans = [], 0
    members = [set(g.members) for g in groups]
    owners = [next(i for i, m in enumerate(members) if m.issuperset(s.members)) for s in plan.sets]
    for pos, (s, owner) in enumerate(zip(plan.sets, owners)):
        if only is None or pos in only:
            at = dict(zip(groups[owner].members, groups[owner].places))
            digits = [(at[m], plan.sizes[m], place) for m, place in zip(s.members, s.places)]
            digits += [(1, 1, 0)] * (len(DIGITS) - s.dim)
            rows.append((owner, pos, *[x for digit in digits for x in digit]))
            fans += min(plan.rows, groups[owner].product)
    names = ", ".join(f"from{i} bigint, size{i} bigint, to{i} bigint" for i in DIGITS)
    sets = patterns.sparkSession.createDataFrame(rows, f"grp int, pos int, {names}")
    # Few patterns fan out into many cells each, so they are spread before the fan-out.
    tasks = max(1, min(fans // FAN_OUT_PER_TASK, patterns.sparkSession.sparkContext.defaultParallelism))
    cell = " + ".join(f"((key div from{i}) % size{i}) * to{i}" for i in DIGITS[:max(s.dim for s in plan.sets)])
    return patterns.repartition(tasks).join(F.broadcast(sets), "grp").select(
        "grp", "key", "cnt", "pos", F.expr(cell).alias("cell"))


def count_cells(patterns: DataFrame, groups: Sequence[ColumnSet], plan: CellPlan,
                only: range | None = None) -> DataFrame:
    """``(pos, key, cnt)``: rows per cell of every examined column set (``pos`` is its position),
    or of those at the positions of ``only``."""
    return (fan_out(patterns, groups, plan, only).groupBy("pos", F.col("cell").alias("key"))
            .agg(F.sum("cnt").alias("cnt")))


def pattern_hits(patterns: DataFrame, groups: Sequence[ColumnSet], plan: CellPlan, flagged: DataFrame) -> DataFrame:
    """``(grp, key, hits)``: the flagged column sets of every pattern that has any, by position."""
    cells = flagged.select("pos", F.col("key").alias("cell"))
    return (fan_out(patterns, groups, plan).join(cells, ["pos", "cell"])
            .groupBy("grp", "key").agg(F.array_sort(F.collect_set("pos")).alias("hits")))


def clean_cells(cells: DataFrame, low: DataFrame, plan: CellPlan) -> DataFrame:
    """``pos, key`` of the observed cells that are not low and hold no smaller low cell."""
    placed = with_items(cells.join(set_table(cells.sparkSession, plan), "pos"), plan).select("pos", "key", "items")
    covered = placed.select("items", F.explode(_subsets(proper=False)).alias("sub")).join(
        low.select(F.col("items").alias("sub")), "sub", "left_semi").select("items").distinct()
    return placed.join(covered, "items", "left_anti").select("pos", "key")


def count_supported(clean: DataFrame, plan: CellPlan) -> DataFrame:
    """``pos, n``: how many cells of each set of two columns and more, seen or not, have clean cells only inside them.

    Such a cell is a clean cell of all columns but the last, plus a code of the last column that every smaller part may be continued with.
    The codes that continue a part are bits, so the parts' words are put together by AND and their bits counted; no cell is listed.
    """
    spark, at = clean.sparkSession, {s.members: pos for pos, s in enumerate(plan.sets)}
    steps, ends = [], []
    for pos, s in enumerate(plan.sets):
        ends.append((pos, plan.sizes[s.members[-1]]))
        if s.dim > 1:
            first, size = s.members[:-1], plan.sizes[s.members[-1]]
            begin = dict(zip(first, plan.sets[at[first]].places))
            for gone in first:  # every part of the beginning with one column less
                part = plan.sets[at[tuple(m for m in s.members if m != gone)]]
                digits = [(begin[m], plan.sizes[m], place // size) for m, place in zip(part.members[:-1], part.places)]
                digits += [(1, 1, 0)] * (len(DIGITS) - len(digits))
                steps.append((at[first], pos, s.dim - 1, at[part.members], *[x for digit in digits for x in digit]))
    names = ", ".join(f"from{i} bigint, size{i} bigint, to{i} bigint" for i in DIGITS)
    steps = spark.createDataFrame(steps, f"pos int, of int, parts int, part int, {names}")
    spot = " + ".join(f"((key div from{i}) % size{i}) * to{i}" for i in DIGITS)
    asked = clean.join(F.broadcast(steps), "pos").select("of", "key", "parts", "part", F.expr(spot).alias("begin"))
    ends = F.broadcast(spark.createDataFrame(ends, "pos int, last bigint"))
    words = (clean.join(ends, "pos").select(F.col("pos").alias("part"), F.expr("key div last").alias("begin"), F.expr("key % last").alias("code"))
             .groupBy("part", "begin", F.expr(f"code div {WORD_BITS}").alias("word"))
             .agg(F.expr(f"bit_or(shiftleft(1L, int(code % {WORD_BITS})))").alias("bits")))
    met = asked.join(words, ["part", "begin"]).groupBy("of", "key", "parts", "word").agg(F.count("*").alias("seen"), F.expr("bit_and(bits)").alias("bits"))
    return met.where("seen = parts").groupBy(F.col("of").alias("pos")).agg(F.sum(F.bit_count("bits")).alias("n"))


def with_items(cells: DataFrame, plan: CellPlan) -> DataFrame:
    """Cells with their ``items``, one number per column and code."""
    sizes = "array(" + ", ".join(f"{u}L" for u in plan.sizes) + ")"
    return cells.withColumn("items", F.expr(
        f"zip_with(members, places, (m, p) -> m * {ITEM_BASE}L + (key div p) % get({sizes}, m))"))


def _with_limits(cells: DataFrame, plan: CellPlan) -> tuple[DataFrame, list]:
    """Cells with ``items`` and ``frac``, and the shares of which a cell must stay below a multiple, the threshold, to be low."""
    out = cells.join(set_table(cells.sparkSession, plan), "pos").withColumn("frac", F.col("cnt") / F.lit(float(plan.rows)))
    out = with_items(out.where(F.col("frac") < F.lit(MAX_RARE_FRACTION)), plan)
    limits = [F.col("uniform")]
    if plan.cfg.check_marginal_probs:
        out = look_up(out, plan.columns, "cnt")
        shares = F.lit([[n / plan.rows for n in column.counts] or [0.0] for column in plan.columns])
        share = item_value(plan.columns, lambda it: F.get(F.get(shares, item_column(it)), item_code(it)),
                           lambda m: F.col(f"__cnt{m}") / F.lit(float(plan.rows)))
        out = out.withColumn("expected", F.when(F.col("dim") > 1, F.aggregate("items", F.lit(1.0), lambda acc, it: acc * share(it))))
        limits.append(F.coalesce("expected", "uniform"))
    return out, limits


def _below(limits: list, threshold) -> Column:
    out = F.lit(True)
    for limit in limits:
        out &= F.col("frac") < limit * threshold
    return out


def low_cells(cells: DataFrame, plan: CellPlan, threshold: float | None = None) -> DataFrame:
    """Cells below the rarity limits, as ``(pos, dim, key, items, cnt, frac)``."""
    out, limits = _with_limits(cells, plan)
    threshold = F.lit(float(plan.cfg.threshold if threshold is None else threshold))
    return out.where(_below(limits, threshold)).select("pos", "dim", "key", "items", "cnt", "frac")


def low_levels(cells: DataFrame, plan: CellPlan, thresholds: Sequence[float]) -> DataFrame:
    """``pos, key, level``: the place of the least threshold (sorted ones are given) at which a cell is low; cells that never are stay out.

    A cell that is low at a threshold is low at all larger ones.
    """
    out, limits = _with_limits(cells, plan)
    level = F.size(F.filter(F.lit([float(t) for t in thresholds]), lambda t: ~_below(limits, t)))
    return out.select("pos", "key", level.alias("level")).where(F.col("level") < len(thresholds))


def pattern_levels(patterns: DataFrame, groups: Sequence[ColumnSet], plan: CellPlan, levels: DataFrame) -> DataFrame:
    """``(grp, key, level)``: the least level among the cells of every pattern that has any."""
    return (fan_out(patterns, groups, plan).join(levels.withColumnRenamed("key", "cell"), ["pos", "cell"])
            .groupBy("grp", "key").agg(F.min("level").alias("level")))


def look_up(cells: DataFrame, columns: Sequence[CodedColumn], what: str) -> DataFrame:
    """Cells (with ``items``) and, per column with a dictionary, ``__{what}{position}`` of the cell's code in it."""
    left = BROADCAST_BYTES
    for m, column in enumerate(columns):
        if column.dictionary is not None:
            code = F.get(F.transform(F.filter("items", lambda it: item_column(it) == m), item_code), F.lit(0))
            one = column.dictionary.table.select(F.col("code").alias(f"__at{m}"), F.col(what).alias(f"__{what}{m}"))
            left -= column.dictionary.bytes
            cells = cells.withColumn(f"__at{m}", code).join(F.broadcast(one) if left >= 0 else one, f"__at{m}", "left").drop(f"__at{m}")
    return cells


def item_value(columns: Sequence[CodedColumn], literal, looked_up):
    """Function of an item: ``literal(item)``, or ``looked_up(position)`` for columns with a dictionary."""
    def value(it):
        out = literal(it)
        for m, column in enumerate(columns):
            if column.dictionary is not None:
                out = F.when(item_column(it) == m, looked_up(m)).otherwise(out)
        return out
    return value


def item_column(item):
    return F.shiftright(item, 32).cast("int")


def item_code(item):
    return (item % F.lit(ITEM_BASE)).cast("int")


def _subsets(proper: bool) -> Column:
    """The subsets of ``items`` that are not empty, without the whole if ``proper``."""
    return F.expr(f"transform(sequence(1, shiftleft(1, size(items)) - {2 if proper else 1}), b -> filter(items, (x, i) -> (shiftright(b, i) & 1) = 1))")


def minimal_cells(low: DataFrame) -> DataFrame:
    """Low cells that contain no smaller low cell: the flagged ones.

    A set is flagged exactly if it is low and none of its proper subsets is low, since a low subset
    is flagged itself or contains a flagged one. So one pass over all sizes replaces a pass per size.
    """
    contained = low.where("dim > 1").select("items", F.explode(_subsets(proper=True)).alias("sub"))
    smaller = low.select(F.col("items").alias("sub"))
    covered = contained.join(smaller, "sub", "left_semi").select("items").distinct()
    return low.join(covered, "items", "left_anti")


def bit_words(cells: DataFrame, *by: str) -> DataFrame:
    """Cells as bits: ``(…by, pos, word, bits)``, 64 keys of a column set per word."""
    return (cells.groupBy(*by, "pos", F.expr(f"key div {WORD_BITS}L").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, int(key % {WORD_BITS}L)))").alias("bits")))


def hit_sql(s: ColumnSet, words: dict[int, int]) -> str:
    """1 if the row's cell of this column set is marked, else 0: one look-up in a literal bitmap."""
    key = s.key_sql()
    count = -(-s.product // WORD_BITS)
    if count == 1:
        return f"cast(shiftright({_long(words[0])}, int({key})) & 1L as int)"
    listed = ", ".join(_long(words.get(w, 0)) for w in range(count))
    return (f"cast(shiftright(get(array({listed}), int({key} div {WORD_BITS}L)), "
            f"int({key} % {WORD_BITS}L)) & 1L as int)")


def _long(value: int) -> str:
    # The smallest long has no literal of its own in SQL.
    return f"{value}L" if value != -(1 << 63) else "shiftleft(1L, 63)"
