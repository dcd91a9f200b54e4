"""Derived columns: date parts, transforms, quantile bins, products and ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import FeatureEngineeringConfig
from ..functions.columns import MISSING_TEXT, clip, col, count_passed, is_datetime, is_numeric, nan_to_null, present
from .codes import ordinal_codes
from .quantiles import exact_quantiles

# Weekdays count from Monday = 0.
DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday,
              "hour": F.hour, "quarter": F.quarter}

# How dates are written other than by ISO, and times behind them.
DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "yyyy/M/d", "yyyyMMdd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
TIME_FORMATS = ("", " H:mm", " H:mm:ss", " h:mm a")

# The action log's lines.
LOG_DATES = "Expanded datetime '{c}' → {parts}"
LOG_LOG = "log1p('{c}')"
LOG_SQRT = "sqrt('{c}')"
LOG_QUANTILE = "qcut('{c}', q={q})"
LOG_PRODUCT = "interaction {a} * {b}"
LOG_RATIO = "ratio {a} / {b}"


def parse_datetime(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """The column as a timestamp; text that is no date or time gives NULL.

    Text is tried as ISO first, then by ``formats`` or, without any, by ``DATE_FORMATS`` in their order: a month before
    the day if both readings are possible.
    """
    dtype = df.schema[name].dataType
    if is_datetime(dtype):
        return col(name)
    if isinstance(dtype, T.StringType):
        forms = [f + t for f in DATE_FORMATS for t in TIME_FORMATS] if not formats else formats
        text = F.trim(col(name))
        return F.coalesce(*([] if formats else [F.try_to_timestamp(text)]), *[F.try_to_timestamp(text, F.lit(f)) for f in forms])
    raise TypeError(f"column {name!r} of type {dtype.simpleString()} holds no dates")


def expand_datetime(df: DataFrame, name: str, parts: list[str], drop_original: bool = True, formats: Sequence[str] = ()) -> DataFrame:
    moment = parse_datetime(df, name, formats)
    df = df.withColumns({f"{name}_{p}": DATE_PARTS[p](moment) for p in parts if p in DATE_PARTS})
    return df.drop(name) if drop_original else df


def log_of(value: Column) -> Column:
    return F.log1p(clip(value.cast("double"), low=0.0))


def sqrt_of(value: Column) -> Column:
    return F.sqrt(clip(value.cast("double"), low=0.0))


def quantile_bins(df: DataFrame, columns: list[str], q: int) -> DataFrame:
    """``{c}_bin``: which of ``q`` equally filled, right-closed bins a value is in.

    Equal edges collapse; a column with a single value has no bin at all.
    """
    out = {}
    for c, found in exact_quantiles(df, {c: col(c) for c in columns}, [i / q for i in range(q + 1)]).items():
        edges = sorted(set(found or []))
        out[f"{c}_bin"] = (count_passed(col(c).cast("double"), edges[1:-1], strict=True) if len(edges) > 1
                           else F.lit(None).cast("int"))
    return df.withColumns(out)


def product_of(a: Column, b: Column) -> Column:
    return a.cast("double") * b.cast("double")


def ratio_of(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def apply_feature_engineering(df: DataFrame, cfg: FeatureEngineeringConfig) -> tuple[DataFrame, list[str]]:
    """All configured features in order; later ones may use earlier ones. Unknown or non-numeric
    columns are skipped."""
    log: list[str] = []
    df = nan_to_null(df)

    def numeric(*names: str) -> bool:
        return all(n in df.columns and is_numeric(df.schema[n].dataType) for n in names)

    for c in cfg.parse_datetimes:
        if c in df.columns:
            df = expand_datetime(df, c, cfg.datetime_parts, cfg.drop_original_datetime, cfg.datetime_formats)
            log.append(LOG_DATES.format(c=c, parts=cfg.datetime_parts))
    for c in filter(numeric, cfg.log_transform):
        df = df.withColumn(f"{c}_log", log_of(col(c)))
        log.append(LOG_LOG.format(c=c))
    for c in filter(numeric, cfg.sqrt_transform):
        df = df.withColumn(f"{c}_sqrt", sqrt_of(col(c)))
        log.append(LOG_SQRT.format(c=c))
    binned = [c for c in cfg.bin_columns if numeric(c)]
    if binned:
        df = quantile_bins(df, binned, cfg.bin_count)
        log += [LOG_QUANTILE.format(c=c, q=cfg.bin_count) for c in binned]
    for a, b in cfg.interactions:
        if numeric(a, b):
            df = df.withColumn(f"{a}_x_{b}", product_of(col(a), col(b)))
            log.append(LOG_PRODUCT.format(a=a, b=b))
    for a, b in cfg.ratios:
        if numeric(a, b):
            df = df.withColumn(f"{a}_div_{b}", ratio_of(col(a), col(b)))
            log.append(LOG_RATIO.format(a=a, b=b))
    return df, log


def encode_for_model(df: DataFrame, id_cols: tuple[str, ...] = ()) -> DataFrame:
    """All columns as numbers: medians for missing numbers (0 if a column has none), ranks of the
    text for the rest, missing text being a value of its own."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema if f.name not in id_cols}
    numbers = {c: col(c).cast("double") for c, t in types.items() if is_numeric(t)}
    counts = df.agg(F.count("*").alias("rows"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(numbers.values())]).first()
    gaps = {c: v for i, (c, v) in enumerate(numbers.items()) if counts[f"n{i}"] < counts["rows"]}
    medians = exact_quantiles(df, gaps, [0.5]) if gaps else {}
    filled = {c: F.coalesce(v, F.lit(medians[c][0] if medians[c] else 0.0)) for c, v in gaps.items()}
    flags = {c: col(c).cast("int") for c, t in types.items() if isinstance(t, T.BooleanType)}
    out = df.withColumns({**numbers, **filled, **flags})
    texts = {c: F.coalesce(present(c, t).cast("string"), F.lit(MISSING_TEXT))
             for c, t in types.items() if c not in numbers and c not in flags}
    return ordinal_codes(out, texts) if texts else out
