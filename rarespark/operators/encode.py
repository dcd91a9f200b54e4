"""Encoding: every analysed column becomes a small set of labelled codes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import RarityConfig
from ..functions.columns import MISSING_TEXT, col, count_passed, present
from ..session import stage
from . import cells
from .cells import CODE, CodedColumn, Dictionary
from .codes import rank_values
from .profile import FeatureProfile, profile_features, settle_kinds

LITERAL_LABELS = 64  # longer lists of labels are joined instead of searched in place
DRIVER_LABELS = 4096  # labels of a column that may come to the driver; more stay a stored dictionary


def bin_edges(low: float, high: float, n_bins: int) -> list[float]:
    """Inner edges of equal-width bins; a value's bin is the number of edges it has reached."""
    step = (high - low) / n_bins
    return [i * step + low for i in range(1, n_bins)]


@dataclass
class Domains:
    """What the analysed columns hold, and how to code rows."""

    rows: int
    profiles: list[FeatureProfile]
    kinds: dict[str, str]
    exact: dict[str, tuple[int, int]]
    columns: list[CodedColumn]
    bins: dict[str, list[int]]  # observed bins per number column, by code
    filled: dict[str, int]  # bin that takes the missing values, per number column that has some
    patterns: DataFrame | None  # distinct raw patterns with counts, if counted in one group
    cfg: RarityConfig

    @property
    def used(self) -> list[FeatureProfile]:
        return [p for p in self.profiles if self.kinds[p.name] != "-"]

    def with_values(self, df: DataFrame) -> DataFrame:
        """Adds ``__x{i}`` (the number) and ``__v{i}`` (bin or category text) per used column."""
        kinds = {i: self.kinds[p.name] for i, p in enumerate(self.used)}
        df = df.withColumns({f"__x{i}": p.number() for i, p in enumerate(self.used) if kinds[i] == "N"})
        return df.withColumns({
            f"__v{i}": count_passed(F.col(f"__x{i}"), bin_edges(p.low, p.high, self.cfg.n_bins), strict=False)
            if kinds[i] == "N" else _category(p) for i, p in enumerate(self.used)})

    def code_rows(self, df: DataFrame) -> DataFrame:
        """Input rows with one code column per analysed column."""
        return self._codes(self.with_values(df))

    def code_patterns(self) -> DataFrame:
        """Raw patterns with code columns and the row count ``cnt``."""
        return self._codes(self.patterns)

    def _codes(self, df: DataFrame) -> DataFrame:
        joined, codes, left = df, {}, cells.BROADCAST_BYTES
        for i, (p, c) in enumerate(zip(self.used, self.columns)):
            value = F.col(f"__v{i}")
            if c.kind == "N":
                value = F.coalesce(value, F.lit(self.filled[p.name])) if p.name in self.filled else value
                bins = self.bins[p.name]
                code = value if bins == list(range(len(bins))) else _position(bins, value)
            elif _kept_as_number(p):  # the label of missing values sorts after every number
                texts = [t for t in c.labels if t != MISSING_TEXT]
                known = F.lit([float(t) for t in texts]).cast(f"array<{p.dtype.simpleString()}>")
                code = F.when(value.isNull(), len(texts)).otherwise((F.array_position(known, value) - 1).cast("int"))
            else:
                value = F.coalesce(value, F.lit(MISSING_TEXT))
                if c.dictionary is not None or c.size > LITERAL_LABELS:
                    if c.dictionary is not None:
                        names, size = c.dictionary.table.select(F.col("label").alias(f"__text{i}"), F.col("code").alias(f"__k{i}")), c.dictionary.bytes
                    else:
                        names = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(c.labels)], f"__text{i} string, __k{i} int")
                        size = sum(len(t.encode()) + 16 for t in c.labels)
                    left -= size
                    # Beyond the bound both sides are plain, so Spark can split a hot label.
                    joined = joined.withColumn(f"__text{i}", value).join(F.broadcast(names) if left >= 0 else names, f"__text{i}", "left")
                    code = F.col(f"__k{i}")
                else:
                    code = _position(list(c.labels), value)
            codes[f"{CODE}{i}"] = code
        out = joined.withColumns(codes)
        return out.drop(*[n for n in out.columns if n.startswith(("__v", "__k", "__x"))])

    def labels(self) -> Column:
        """Array of the row's labels, one per analysed column."""
        return F.array(*[F.col(f"__text{i}") if c.dictionary is not None else F.get(F.lit(list(c.labels)), F.col(f"{CODE}{i}"))
                         for i, c in enumerate(self.columns)])


def _kept_as_number(p: FeatureProfile) -> bool:
    """Short lists of numbers are matched as numbers, which spares a text conversion per row."""
    return isinstance(p.dtype, (T.FloatType, T.DoubleType, T.IntegerType, T.ShortType, T.ByteType)) and p.floor <= LITERAL_LABELS


def _category(p: FeatureProfile) -> Column:
    value = present(p.name, p.dtype)
    return value if _kept_as_number(p) else value.cast("string")


def _position(values: list, value: Column) -> Column:
    return (F.array_position(F.lit(values), value) - 1).cast("int")


def discover(df: DataFrame, features: Sequence[str], cfg: RarityConfig) -> Domains:
    """Profile the features and count their values.

    Two passes over the input: bounds and ends of every column, then its values. If the column sizes
    promise few patterns, the second pass counts whole patterns, which also serve all later counting.
    """
    rows, profiles = profile_features(df, features, 2 * cfg.n_bins)
    exact: dict[str, tuple[int, int]] = {}
    while True:
        kinds = settle_kinds(profiles, cfg, exact)
        found = Domains(rows, profiles, kinds, exact, [], {}, {}, None, cfg)
        used = found.used
        if not used:
            return found
        sizes = [(cfg.n_bins if kinds[p.name] == "N" else p.floor) + bool(p.missing) for p in used]
        number_gaps = [i for i, p in enumerate(used) if kinds[p.name] == "N" and p.missing]
        values = found.with_values(df.select(*[col(p.name) for p in used]))
        if math.prod(max(s, 1) for s in sizes) <= cfg.max_group_patterns:
            found.patterns = stage(values.groupBy(*[f"__v{i}" for i in range(len(used))]).agg(
                F.count("*").alias("cnt"),
                *[f(f"__x{i}").alias(f"{tag}{i}") for i in number_gaps for tag, f in (("__lo", F.min), ("__hi", F.max))]))
        listed, counted = _list_values(found, values, number_gaps)
        kinds_before = dict(kinds)
        for i, p in enumerate(used):
            if kinds[p.name] == "C":
                texts = listed[i]["texts"]
                if texts is None:
                    seen = listed[i]["distinct"]
                    exact[p.name] = (seen, seen if p.numeric and not p.from_text else listed[i]["numbers"])
                else:
                    numbers = len({float(t) for t in texts}) if p.numeric else 0
                    exact[p.name] = (len(texts) if p.from_text or not p.numeric else numbers, numbers)
        found.kinds = settle_kinds(profiles, cfg, exact)
        if all(found.kinds[p.name] == kinds_before[p.name] or found.kinds[p.name] == "-" for p in used):
            return _settle(found, used, listed, kinds_before, counted)


def _list_values(found: Domains, values: DataFrame, number_gaps: list[int]) -> tuple[list[dict], DataFrame]:
    """Values of every used column with their row counts, read to the driver, and the table they come from.

    What is read is bounded: a column of more values than the limit, or than ``DRIVER_LABELS``, reports how many values and how many numbers it
    has; its labels stay in the table.
    """
    used, cfg = found.used, found.cfg
    source, weight = (found.patterns, "cnt") if found.patterns is not None else (values, None)
    entries = []
    for i in range(len(used)):
        gap = i in number_gaps
        low, high = (f"__lo{i}", f"__hi{i}") if weight else (f"__x{i}", f"__x{i}")
        entries.append(F.struct(
            F.lit(i).alias("at"), F.col(f"__v{i}").cast("string").alias("value"),
            (F.col(low) if gap else F.lit(None).cast("double")).alias("lo"),
            (F.col(high) if gap else F.lit(None).cast("double")).alias("hi")))
    counted = (source.select(*([weight] if weight else []), F.explode(F.array(*entries)).alias("e"))
               .groupBy("e.at", "e.value")
               .agg((F.sum(weight) if weight else F.count("*")).alias("cnt"),
                    F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi")))
    cap = min(max(cfg.max_values_per_column, 2 * cfg.n_bins) + 1, DRIVER_LABELS)
    bound = cap * len(used)
    rows = counted.limit(bound + 1).collect()
    large: dict[int, tuple[int, int]] = {}
    if len(rows) > bound or max(Counter(r["at"] for r in rows).values(), default=0) > cap + 1:  # more values than the lower bound suggested
        counted = stage(counted)
        number = F.col("value").try_cast("double") + F.lit(0.0)
        for r in counted.groupBy("at").agg(F.count("value").alias("n"), F.count_distinct(number).alias("numbers")).collect():
            if r["n"] > cap:
                large[r["at"]] = (r["n"], r["numbers"] if used[r["at"]].numeric else 0)
        rows = counted.where(~F.col("at").isin(*large) | F.col("value").isNull()).collect()
    listed = [{"counts": {}, "ends": {}, "missing": 0, "distinct": large.get(i, (None,))[0], "numbers": large.get(i, (0, 0))[1]} for i in range(len(used))]
    for r in rows:
        slot = listed[r["at"]]
        if r["value"] is None:
            slot["missing"] += r["cnt"]
        else:
            slot["counts"][r["value"]] = r["cnt"]
            slot["ends"][r["value"]] = (r["lo"], r["hi"])
    for i, slot in enumerate(listed):
        slot["texts"] = None if i in large else list(slot["counts"])
    return listed, counted


def _dictionary(counted: DataFrame, at: int) -> Dictionary:
    """The labels of one column, numbered in order on the executors."""
    labels = stage(counted.where(F.col("at") == at).groupBy(F.coalesce("value", F.lit(MISSING_TEXT)).alias("value")).agg(F.sum("cnt").alias("cnt")))
    codes = rank_values(labels.select(F.lit(0).alias("at"), "value")).select("value", F.col("code").cast("int").alias("code"))
    table = stage(codes.join(labels, "value").select(F.col("value").alias("label"), "code", "cnt"))
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("label") + 24).alias("bytes")).first()
    return Dictionary(table, size["n"], size["bytes"])


def _settle(found: Domains, used: list[FeatureProfile], listed: list[dict], kinds: dict[str, str], counted: DataFrame) -> Domains:
    cfg, kept = found.cfg, []
    for i, (p, slot) in enumerate(zip(used, listed)):
        if found.kinds[p.name] == "-":
            continue
        kept.append(i)
        if slot["texts"] is None and kinds[p.name] == "C":
            found.columns.append(CodedColumn(p.name, "C", (), (), _dictionary(counted, i)))
            continue
        counts = dict(slot["counts"])
        if kinds[p.name] == "N":
            counts = {int(b): n for b, n in counts.items()}
            if slot["missing"]:
                fill = found.filled[p.name] = _median_bin(p, counts, slot["ends"], cfg)
                counts[fill] = counts.get(fill, 0) + slot["missing"]
            order = sorted(counts)
            found.bins[p.name] = order
            labels = [cfg.bin_names[b] if b < len(cfg.bin_names) else f"Bin {b}" for b in order]
        else:
            if slot["missing"]:
                counts[MISSING_TEXT] = counts.get(MISSING_TEXT, 0) + slot["missing"]
            order = labels = sorted(counts)
        found.columns.append(CodedColumn(p.name, kinds[p.name], tuple(labels), tuple(counts[v] for v in order)))
    if found.patterns is not None:  # number the kept columns without gaps
        found.patterns = found.patterns.select(
            *[F.col(f"__v{i}").alias(f"__v{k}") for k, i in enumerate(kept)], "cnt")
    return found


def _median_bin(p: FeatureProfile, counts: dict[int, int], ends: dict[str, tuple], cfg: RarityConfig) -> int:
    """Bin of the exact median, from bin counts: only the bin matters for the fill.

    The two middle values either share a bin, or are the end of one bin and the start of the next.
    """
    total, middles, before = sum(counts.values()), [], 0
    for rank in ((total - 1) // 2, total // 2):
        before = 0
        for b in sorted(counts):
            if rank < before + counts[b]:
                middles.append(b)
                break
            before += counts[b]
    first, second = middles
    if first == second:
        return first
    median = (ends[str(first)][1] + ends[str(second)][0]) / 2
    return sum(median >= e for e in bin_edges(p.low, p.high, cfg.n_bins))
