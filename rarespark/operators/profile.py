"""Profiling: what the columns hold, and which columns the detector can use."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import RarityConfig
from ..functions.columns import (NUMBER_PATTERN, as_number, category_text, col, is_datetime, is_nested,
                                 is_numeric, present, require_flat)

# Parts of a column name that suggest a date or time.
DATETIME_NAME_HINTS = ("date", "time", "dt", "timestamp")

BITMAP_POSITIONS = 32768  # positions of one Spark bitmap aggregate


def distinct_floor(value: Column) -> Column:
    """A proven lower bound of the distinct count: how many hash positions the values occupy.

    One fixed-size bitmap per task instead of a shuffle of the values. Exact counts are only needed
    where this bound is small, and there grouping is cheap.
    """
    position = F.pmod(F.xxhash64(value), F.lit(BITMAP_POSITIONS))
    return F.bitmap_count(F.bitmap_construct_agg(F.when(value.isNotNull(), position)))


@dataclass(frozen=True)
class FeatureProfile:
    """First look at one analysed column; distinct counts are lower bounds."""

    name: str
    dtype: T.DataType
    values: int
    missing: int
    floor: int
    numeric: bool
    numeric_floor: int
    low: float | None
    high: float | None
    endless: bool  # some numbers are infinite

    @property
    def from_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    def number(self) -> Column:
        """Value as a double with infinities pulled to the finite ends."""
        value = present(self.name, self.dtype) if self.missing else col(self.name)
        x = value.try_cast("double") if self.from_text else value.cast("double")
        if not self.endless:
            return x
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(self.low)), F.lit(self.high)))

    def text(self) -> Column:
        return category_text(present(self.name, self.dtype))


def profile_features(df: DataFrame, features: Sequence[str], few: int) -> tuple[int, list[FeatureProfile]]:
    """Row count and first-look profile of every feature, in one pass without a data shuffle.

    Text that may be numbers is looked at once more, but only where it could matter: more than
    ``few`` values, and both its least and its greatest text read as a number.
    """
    require_flat(df, features)
    types = {f.name: f.dataType for f in df.schema}
    text = [n for n in features if isinstance(types[n], T.StringType)]
    first = _profile_pass(df, {n: present(n, types[n]) for n in features}, types)
    maybe = [n for n in text if first[n]["floor"] > few and _reads_as_number(first[n]["lo"])
             and _reads_as_number(first[n]["hi"])]
    second = _profile_pass(
        df, {n: as_number(col(n), types[n]) for n in maybe}, {n: T.DoubleType() for n in maybe}) if maybe else {}
    out = []
    for n in features:
        look = first[n]
        numbers = second.get(n, {}) if n in text else look
        numeric = is_numeric(types[n]) or bool(numbers and numbers["n"] == look["n"])
        out.append(FeatureProfile(
            n, types[n], look["n"], look["rows"] - look["n"], look["floor"], numeric,
            numbers["floor"] if numeric else 0, numbers["lo"] if numeric else None,
            numbers["hi"] if numeric else None, bool(numeric and numbers["finite"] < numbers["n"])))
    return out[0].values + out[0].missing if out else 0, out


def _reads_as_number(text: str | None) -> bool:
    return text is not None and re.match(NUMBER_PATTERN, text) is not None


def _profile_pass(df: DataFrame, values: dict[str, Column], types: dict[str, T.DataType]) -> dict[str, dict]:
    """Counts, distinct floor and ends of the given expressions, in one aggregate."""
    keys = {n: f"c{i}" for i, n in enumerate(values)}
    flat = df.select(*[(v + F.lit(0.0) if isinstance(types[n], (T.FloatType, T.DoubleType)) else v).alias(keys[n])
                       for n, v in values.items()])
    aggs = [F.count("*").alias("rows")]
    for n, k in keys.items():
        x = F.col(k)
        aggs += [F.count(x).alias("n" + k), distinct_floor(x).alias("floor" + k)]
        if isinstance(types[n], (T.FloatType, T.DoubleType)):
            x = F.when(F.abs(x) < F.lit(float("inf")), x).cast("double")
            aggs.append(F.count(x).alias("finite" + k))
        elif is_numeric(types[n]):
            x = x.cast("double")
        if is_numeric(types[n]) or isinstance(types[n], T.StringType):
            aggs += [F.min(x).alias("lo" + k), F.max(x).alias("hi" + k)]
    row = flat.agg(*aggs).first().asDict()
    return {n: {"rows": row["rows"], "n": row["n" + k], "floor": row["floor" + k], "lo": row.get("lo" + k),
                "hi": row.get("hi" + k), "finite": row.get("finite" + k, row["n" + k])}
            for n, k in keys.items()}


def settle_kinds(profiles: Sequence[FeatureProfile], cfg: RarityConfig,
                 exact: dict[str, tuple[int, int]] | None = None) -> dict[str, str]:
    """Kind per column: ``N`` binned number, ``C`` category, ``-`` left out.

    ``exact`` gives (distinct values, distinct numbers) for columns whose exact counts are known;
    elsewhere the lower bounds decide, which is final whenever they exceed the limits. A bound that
    is still within the limits leaves the column in, as a category, until it is counted.
    """
    kinds = {}
    few = 2 * cfg.n_bins
    for p in profiles:
        known = (exact or {}).get(p.name)
        distinct, numbers = known or (p.floor, p.numeric_floor)
        fewest = cfg.min_values_per_column if known else 0
        if p.numeric and distinct > few:
            kinds[p.name] = "N" if numbers > few else "C"
        elif fewest <= distinct <= cfg.max_values_per_column:
            kinds[p.name] = "C"
        else:
            kinds[p.name] = "-"
    return kinds


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)])


def suggest_datetime_columns(df: DataFrame) -> list[str]:
    """Date/time columns, by type or by a hint anywhere in the name."""
    return [f.name for f in df.schema
            if is_datetime(f.dataType) or any(h in f.name.lower() for h in DATETIME_NAME_HINTS)]


def preview(df: DataFrame, order_by: Sequence[str] = (), n: int = 50) -> DataFrame:
    """First ``n`` rows, by the given order if there is one."""
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(n)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct counts as ``(position, uniques)``, of any number of columns in one job.

    Values travel as 128-bit hashes, once per task and value: a hot value costs one record per task,
    long text is not shuffled, and no task holds a whole column.
    """
    types = {f.name: f.dataType for f in df.schema}
    entries = []
    for i, c in enumerate(columns):
        v = present(c, types[c])
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            v = v + F.lit(0.0)
        entries.append(F.when(v.isNotNull(), F.struct(
            F.lit(i).alias("position"), F.xxhash64(v).alias("a"),
            F.xxhash64(F.lit(i), v, F.hash(v)).alias("b"))))
    return (df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null")
            .select("e.*").distinct().groupBy("position").agg(F.count("*").alias("uniques")))


def column_summary(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, counts, share missing, distinct values and a three-value sample.

    The sample holds the first three present values in the order of ``order_by`` (a unique key), or
    in file order without one.
    """
    types = {f.name: f.dataType for f in df.schema}
    flat = [c for c in df.columns if not is_nested(types[c])]
    totals = df.agg(F.count("*").alias("rows"),
                    *[F.count(present(c, types[c])).alias(f"n{i}") for i, c in enumerate(flat)]).first()
    uniques = {r["position"]: r["uniques"] for r in distinct_counts(df, flat).collect()}
    rows, held = totals["rows"], {c: totals[f"n{i}"] for i, c in enumerate(flat)}
    samples = _first_values(df, flat, held, order_by)
    table = [(c, types[c].simpleString(), held[c], rows - held[c],
              round((rows - held[c]) * 100 / rows, 2) if rows else None, uniques.get(i, 0),
              ", ".join(samples[c]))
             for i, c in enumerate(flat)]
    return df.sparkSession.createDataFrame(table, (
        "Column string, Type string, `Non-null` bigint, Missing bigint, `Missing %` double, "
        "Unique bigint, Sample string"))


def _first_values(df: DataFrame, columns: Sequence[str], held: dict[str, int], order_by: Sequence[str],
                  n: int = 3, head_rows: int = 16) -> dict[str, list[str]]:
    """First ``n`` present values per column: from the head of the table where it has enough, else
    by repeated minimum of (order, value), all such columns in one aggregate per round."""
    types = {f.name: f.dataType for f in df.schema}
    key = F.struct(*[col(c) for c in order_by]) if order_by else F.monotonically_increasing_id()
    keyed = df.select(key.alias("__key"), *[present(c, types[c]).cast("string").alias(f"v{i}")
                                            for i, c in enumerate(columns)])
    head = keyed.orderBy("__key").limit(head_rows).collect()
    out = {c: [r[f"v{i}"] for r in head if r[f"v{i}"] is not None][:n] for i, c in enumerate(columns)}
    short = [(i, c) for i, c in enumerate(columns) if len(out[c]) < min(n, held[c])]
    out.update({c: [] for _, c in short})
    last: dict[str, object] = {}
    for _ in range(n if short else 0):
        aggs = []
        for i, c in short:
            after = F.col(f"v{i}").isNotNull()
            if c in last:
                after &= F.col("__key") > last[c]
            aggs.append(F.min(F.when(after, F.struct("__key", f"v{i}"))).alias(f"m{i}"))
        row = keyed.agg(*aggs).first()
        for i, c in short:
            if row[f"m{i}"] is not None:
                found = row[f"m{i}"]["__key"]
                last[c] = F.struct(*[F.lit(x).alias(o) for x, o in zip(found, order_by)]) if order_by else F.lit(found)
                out[c].append(row[f"m{i}"][f"v{i}"])
    return out
