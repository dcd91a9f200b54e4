"""Exact quantiles of many columns without holding a column in one task.

A quantile is an order statistic. Each pass counts values per bucket of the interval still in
question (a bounded, map-side combined aggregate over all columns at once) and narrows the interval
to the bucket that holds the wanted rank. Intervals that hold few values, by count, are then sorted.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 1024
SORT_LIMIT = 1 << 18  # values that may be sorted in one task, all intervals together


@dataclass
class _Slice:
    """Values of one column within [low, high]; ``below`` values are smaller than ``low``."""

    column: str
    low: float
    high: float
    below: int
    count: int
    ranks: set[int]
    log: bool = False

    def settle(self, found: dict) -> None:
        """Answer the ranks that the interval's ends decide."""
        for rank in list(self.ranks):
            at = rank - self.below
            if self.low == self.high or at == 0 or at == self.count - 1:
                found[self.column, rank] = self.low if at == 0 else self.high
                self.ranks.discard(rank)


def _scale(value, log: bool):
    """Bucket axis: linear, or signed logarithm for ranges that span many magnitudes."""
    if not log:
        return value
    if isinstance(value, Column):
        return F.signum(value) * F.log1p(F.abs(value))
    return math.copysign(math.log1p(abs(value)), value)


def _bucket(value: Column, low: float, high: float, log: bool) -> Column:
    a, b = _scale(low, log), _scale(high, log)
    if not log:  # halved, so that the width of a very wide interval stays finite
        value, a, b = value / 2, a / 2, b / 2
    width = (b - a) or 1.0
    at = ((_scale(value, log) - F.lit(a)) / F.lit(width) * F.lit(BUCKETS)).cast("int")
    return F.when(at < 0, 0).when(at >= BUCKETS, BUCKETS - 1).otherwise(at)


def _inside(s: _Slice) -> Column:
    return F.col(s.column).between(s.low, s.high)


def _narrow(df: DataFrame, slices: list[_Slice]) -> list[_Slice]:
    """Replace intervals by the buckets that hold their ranks; only those buckets are read back."""
    by_column: dict[str, Column] = {}
    for i, s in enumerate(slices):  # intervals of one column do not overlap
        entry = F.struct(F.lit(i).alias("slice"), _bucket(F.col(s.column), s.low, s.high, s.log).alias("bucket"),
                         F.col(s.column).alias("value"))
        known = by_column.get(s.column)
        by_column[s.column] = F.when(_inside(s), entry) if known is None else known.when(_inside(s), entry)
    counted = (df.select(F.explode(F.array(*by_column.values())).alias("e")).where("e is not null")
               .groupBy("e.slice", "e.bucket")
               .agg(F.count("*").alias("n"), F.min("e.value").alias("lo"), F.max("e.value").alias("hi")))
    earlier = Window.partitionBy("slice").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.get(F.lit([s.below for s in slices]).cast("array<bigint>"), F.col("slice"))
    wanted = F.get(F.lit([sorted(s.ranks) for s in slices]).cast("array<array<bigint>>"), F.col("slice"))
    held = F.exists(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    out = []
    for row in (counted.withColumn("below", starts + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                .where(held).collect()):
        s, below, n = slices[row["slice"]], row["below"], row["n"]
        log = not s.log and n > s.count // 8  # a step that hardly narrowed is followed by one on the other axis
        out.append(_Slice(s.column, row["lo"], row["hi"], below, n, {r for r in s.ranks if below <= r < below + n}, log))
    return out


def _sort_small(df: DataFrame, slices: list[_Slice], found: dict) -> None:
    aggs = []
    for i, s in enumerate(slices):
        ranked = F.sort_array(F.collect_list(F.when(_inside(s), F.col(s.column))))
        aggs.append(F.array(*[F.get(ranked, F.lit(r - s.below)) for r in sorted(s.ranks)]).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    for i, s in enumerate(slices):
        found.update({(s.column, r): v for r, v in zip(sorted(s.ranks), row[f"s{i}"])})


def order_statistics(df: DataFrame, ranks: Mapping[str, set[int]], bounds: Mapping[str, tuple],
                     sort_limit: int = SORT_LIMIT) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ``ranks`` of double columns with known (min, max, count)."""
    found: dict[tuple[str, int], float] = {}
    open_ = [_Slice(c, *bounds[c][:2], 0, bounds[c][2], set(r)) for c, r in ranks.items() if r]
    while True:
        for s in open_:
            s.settle(found)
        open_ = [s for s in open_ if s.ranks]
        limit = max(sort_limit // max(len(open_), 1), 1)
        small, large = [s for s in open_ if s.count <= limit], [s for s in open_ if s.count > limit]
        if not large:
            break
        open_ = small + _narrow(df, large)
    if small:
        _sort_small(df, small, found)
    return found


def _finite(value: Column) -> Column:
    """Infinities as the largest doubles, so that bucket widths stay finite."""
    return (F.when(value == F.lit(math.inf), sys.float_info.max)
            .when(value == F.lit(-math.inf), -sys.float_info.max).otherwise(value))


def _between(low: float, high: float, share: float) -> float:
    if low == high or share == 0:
        return math.copysign(math.inf, low) if abs(low) == sys.float_info.max else low
    return low + (high - low) * share


def is_finite(bounds: Mapping[str, tuple]) -> bool:
    """Whether no column holds an infinity; ``bounds`` are those of ``finite_bounds``."""
    return all(abs(x) < sys.float_info.max for low, high, _ in bounds.values() for x in (low, high))


@dataclass(frozen=True)
class Carried:
    """Order statistics of a column after steps that keep its order, from those of the column as it was.

    ``found`` holds values of the column at some ranks; ``count`` of its values are present. ``filled`` and ``clipped`` say what
    became of it. So the quantiles after a fill and a clip need no further look at the rows.
    """

    found: Mapping[int, float]
    count: int
    extra: int = 0
    fill: float = 0.0
    low: float = -math.inf
    high: float = math.inf

    @staticmethod
    def needed(count: int, extra: int, before: Sequence[float], after: Sequence[float]) -> set[int]:
        """Ranks to look up for quantiles ``before`` and ``after`` the fill of ``extra`` missing values."""
        spots = lambda n, ps: {r for p in ps for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
        later = spots(count + extra, after)
        return {r for r in spots(count, before) | later | {r - extra for r in later} if 0 <= r < count}

    def filled(self, value: float, extra: int) -> "Carried":
        return replace(self, fill=value, extra=extra)

    def clipped(self, low: float, high: float) -> "Carried":
        return replace(self, low=low, high=high)

    def at(self, rank: int) -> float:
        # Of the values with copies of the fill among them, the rank is held by the middle of these three.
        below = self.found[rank - self.extra] if rank >= self.extra else -math.inf
        above = self.found[rank] if rank < self.count else math.inf
        return min(max(max(below, min(self.fill, above)) if self.extra else above, self.low), self.high)

    def quantile(self, p: float) -> float:
        spot = p * (self.count + self.extra - 1)
        return _between(self.at(math.floor(spot)), self.at(math.ceil(spot)), spot - math.floor(spot))


def finite_bounds(df: DataFrame, columns: Mapping[str, Column], *more: Column) -> tuple[DataFrame, dict[str, tuple], dict]:
    """The expressions as columns of finite doubles, (min, max, count) of those with values, and further aggregates of ``df``."""
    values = df.select("*", *[_finite(x.cast("double")).alias(key) for key, x in columns.items()])
    row = values.agg(*more, *[f(key).alias(f"{tag}{key}") for key in columns
                              for tag, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first().asDict()
    return values.select(*columns), {k: (row["lo" + k], row["hi" + k], row["n" + k]) for k in columns if row["n" + k]}, row


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float],
                    sort_limit: int = SORT_LIMIT) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per named expression; None for one without values."""
    names = {f"__q{i}": name for i, name in enumerate(columns)}
    values, bounds, _ = finite_bounds(df, {key: columns[name] for key, name in names.items()})
    spots = {k: [p * (bounds[k][2] - 1) for p in probabilities] for k in bounds}
    ranks = {k: {r for s in spots[k] for r in (math.floor(s), math.ceil(s))} for k in bounds}
    at = order_statistics(values, ranks, bounds, sort_limit)
    out: dict[str, list[float] | None] = {name: None for name in columns}
    for k, positions in spots.items():
        out[names[k]] = [_between(at[k, math.floor(s)], at[k, math.ceil(s)], s - math.floor(s))
                         for s in positions]
    return out
