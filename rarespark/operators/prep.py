"""Cleaning: one function per step, and the whole chain.

Steps that need statistics take them for all columns in one aggregate; what is applied to the rows
is always a projection or filter. Exact quantiles never hold a column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..config import PreprocessConfig
from ..functions.columns import clip, col, is_numeric, nan_to_null
from ..session import stage
from .codes import BROADCAST_BYTES, ordinal_codes, value_counts
from .quantiles import Carried, exact_quantiles, finite_bounds, is_finite, order_statistics


# The action log's lines.
LOG_DROPPED = "Dropped {n} user-selected columns: {names}"
LOG_DUPLICATES = "Dropped duplicate rows: {n}"
LOG_CONSTANT = "Dropped constant columns: {names}"
LOG_HIGH_MISSING = "Dropped {n} columns with >= {share:.0%} missing: {names}"
LOG_ROWS = "Dropped {n} rows with missing {kind} values"
LOG_NUMERIC = "Numeric imputation: {how}"
LOG_CATEGORICAL = "Categorical imputation: {how}"
LOG_IQR = "Outlier clipping (IQR x{k})"
LOG_ZSCORE = "Outlier clipping (z-score |z| > {z})"
LOG_SCALING = "Scaling: {how}"
LOG_ONE_HOT = "One-hot encoded {n} categorical column(s)"
LOG_ORDINAL = "Ordinal-encoded {n} categorical column(s)"


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    return df.select(*[col(c) for c in df.columns if c not in set(columns)])


def row_digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row; every column comes with whether it is missing, which Spark's hashes pass over."""
    marked = [x for c in columns for x in (col(c), col(c).isNull())]
    return [F.xxhash64(*marked).alias("__a"), F.xxhash64(F.lit(1), *reversed(marked), F.hash(*marked)).alias("__b")]


def drop_duplicates(df: DataFrame, id_cols: Sequence[str] = (), seen: Observation | None = None) -> DataFrame:
    """Distinct rows. Ids do not take part in the comparison; the least id of each group stays.

    Rows are first grouped by a 128-bit digest, so only digests travel. Rows whose digest stands alone pass as they
    are; only the others are compared as a whole, combined in each task first, so that a value held by many
    rows costs one record per task. The repeated digests are broadcast if their measured size allows, else joined by shuffle.
    ``seen`` observes the number of rows before.
    """
    values = [c for c in df.columns if c not in id_cols]
    digests = df.select(*row_digest(df, values))
    if seen is not None:
        digests = digests.observe(seen, F.count("*").alias("rows"))
    repeated = stage(digests.groupBy("__a", "__b").agg(F.count("*").alias("n")).where("n > 1").select("__a", "__b"))
    size = 16 * repeated.count()
    if not size:
        return df
    found = F.broadcast(repeated) if size <= BROADCAST_BYTES else repeated
    keyed = df.select("*", *row_digest(df, values))
    alone = keyed.join(found, ["__a", "__b"], "left_anti").select(*map(col, df.columns))
    copies = keyed.join(found, ["__a", "__b"], "left_semi")
    if not id_cols:
        return alone.unionByName(copies.select(*map(col, df.columns)).distinct())
    # The minimum of one number can be kept in place; that of a struct needs sorted rows.
    least = F.struct(F.min(col(id_cols[0])).alias(id_cols[0])) if len(id_cols) == 1 else F.min(F.struct(*map(col, id_cols)))
    first = copies.groupBy(*map(col, values)).agg(least.alias("__id"))
    return alone.unionByName(first.select(*[F.col("__id").getField(c).alias(c) if c in id_cols else col(c) for c in df.columns]))


def _column_facts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, tuple[int, bool]]]:
    """Row count, and per column (present values, all present values equal)."""
    types = {f.name: f.dataType for f in df.schema}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        same = F.lit(False) if isinstance(types[c], T.MapType) else F.min(col(c)).eqNullSafe(F.max(col(c)))
        aggs += [F.count(col(c)).alias(f"n{i}"), same.alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return row["rows"], {c: (row[f"n{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct value, a missing value counting as one."""
    rows, facts = _column_facts(df, columns or df.columns)
    return [c for c, (n, same) in facts.items() if n == 0 or (n == rows and same)]


def high_missing_columns(df: DataFrame, threshold: float = 0.9, columns: Sequence[str] | None = None) -> list[str]:
    rows, facts = _column_facts(df, columns or df.columns)
    return [c for c, (n, _) in facts.items() if rows and (rows - n) / rows >= threshold]


def drop_missing_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(_all_present(columns))


def _all_present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= col(c).isNotNull()
    return out


def _missing(df: DataFrame, columns: Sequence[str], *more: Column) -> tuple[list[str], dict]:
    """Columns with missing values, and the further aggregates."""
    row = df.agg(F.count("*").alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
                 *more).first().asDict()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] < row["rows"]], row


def impute_numeric(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Fill missing numbers by ``mean``, (exact) ``median`` or ``zero``."""
    more = [F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)] if how == "mean" else []
    gaps, row = _missing(df, columns, *more)
    if how == "zero":
        return df.withColumns({c: F.coalesce(col(c), F.lit(0).cast(df.schema[c].dataType)) for c in gaps})
    if how == "mean":
        fill = {c: row[f"m{i}"] for i, c in enumerate(columns) if c in gaps}
    else:
        found = exact_quantiles(df, {c: col(c) for c in gaps}, [0.5]) if gaps else {}
        fill = {c: q[0] if q else None for c, q in found.items()}
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in fill.items() if v is not None})


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text, the smallest on ties.

    Counting by value first keeps every group small, however many values a column has.
    """
    return _modes(value_counts(df, {c: col(c).cast("string") for c in columns}), columns)


def _modes(counted: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    best = counted.groupBy("at").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))
    found = {r["at"]: r["value"] for r in best.collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def impute_categorical(df: DataFrame, columns: Sequence[str], how: str, fill: str = "Missing") -> DataFrame:
    """Fill missing categories by ``mode`` or by a ``constant`` text."""
    if how == "constant":
        return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit(fill)) for c in columns})
    gaps, _ = _missing(df, columns)
    modes = column_modes(df, gaps) if gaps else {}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in modes.items() if v is not None})


def clip_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Bound numbers to ``[q1 - factor * iqr, q3 + factor * iqr]``."""
    out = {}
    for c, q in exact_quantiles(df, {c: col(c) for c in columns}, [0.25, 0.75]).items():
        if q:
            reach = factor * (q[1] - q[0])
            out[c] = clip(col(c), q[0] - reach, q[1] + reach)
    return df.withColumns(out)


def _moments(df: DataFrame, columns: Sequence[str], *names: str) -> dict[str, tuple]:
    functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[functions[n](col(c).cast("double")).alias(f"{n}{i}")
                   for i, c in enumerate(columns) for n in names]).first()
    return {c: tuple(row[f"{n}{i}"] for n in names) for i, c in enumerate(columns)}


def clip_zscore(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """Bound numbers to ``mean ± z * std`` (sample deviation); a column without spread is left."""
    stats = _moments(df, columns, "mean", "std")
    return df.withColumns({c: clip(col(c), mean - z * std, mean + z * std)
                           for c, (mean, std) in stats.items() if std})


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = _moments(df, columns, "mean", "std")
    return df.withColumns({c: (col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in stats.items() if std})


def scale_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = _moments(df, columns, "min", "max")
    return df.withColumns({c: (col(c) - F.lit(low)) / F.lit(high - low)
                           for c, (low, high) in stats.items() if low is not None and high - low})


def scale_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distance from the median in interquartile ranges."""
    stats = exact_quantiles(df, {c: col(c) for c in columns}, [0.25, 0.5, 0.75])
    return df.withColumns({c: (col(c) - F.lit(q[1])) / F.lit(q[2] - q[0])
                           for c, q in stats.items() if q and q[2] - q[0]})


def one_hot(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """A boolean column per value, after the other columns, values in sorted order; missing is all false.

    With ``limit``, columns of more values are refused (never cut).
    """
    entries = F.array(*[F.struct(F.lit(i).alias("at"), col(c).cast("string").alias("value"))
                        for i, c in enumerate(columns)])
    values = df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null").distinct()
    found = (values.limit(limit * len(columns) + 1) if limit else values).collect()  # each will be a column
    by_column = {i: sorted(r["value"] for r in found if r["at"] == i) for i in range(len(columns))}
    wide = [c for i, c in enumerate(columns) if limit and len(by_column[i]) > limit]
    if wide or (limit and len(found) > limit * len(columns)):
        raise ValueError(f"more than {limit} values to one-hot encode in {wide or list(columns)}")
    kept = [col(c) for c in df.columns if c not in columns]
    flags = [F.coalesce(col(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
             for i, c in enumerate(columns) for v in by_column[i]]
    return df.select(*kept, *flags)


def ordinal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by their rank among the sorted values; missing becomes -1."""
    return ordinal_codes(df, {c: col(c).cast("string") for c in columns}, missing=-1)


def apply_preprocessing(df: DataFrame, cfg: PreprocessConfig, id_cols: Sequence[str] = (),
                        count_rows: bool = True) -> tuple[DataFrame, list[str]]:
    """The whole chain; returns the cleaned table and a log of what was done.

    ``id_cols`` pass through untouched. Steps that remove rows report how many, at the price of a
    count; ``count_rows=False`` spares it.
    """
    log: list[str] = []
    df = nan_to_null(df)
    ids = list(id_cols)

    dropped = [c for c in cfg.drop_columns if c in df.columns]
    if dropped:
        df = drop_columns(df, dropped)
        log.append(LOG_DROPPED.format(n=len(dropped), names=dropped))

    before = None
    if cfg.drop_duplicates:
        before = Observation() if count_rows else None
        df = stage(drop_duplicates(df, ids, before))  # later statistics would repeat the shuffle
        log.append(LOG_DUPLICATES.format(n="not counted"))
        at = len(log) - 1

    facts = None
    if cfg.drop_constant_columns or cfg.drop_high_missing:
        rows, facts = _column_facts(df, [c for c in df.columns if c not in ids])
    if before is not None:
        log[at] = LOG_DUPLICATES.format(n=before.get["rows"] - (rows if facts is not None else df.count()))
    if facts is not None:
        constant = [c for c, (n, same) in facts.items() if n == 0 or (n == rows and same)]
        if cfg.drop_constant_columns and constant:
            df = drop_columns(df, constant)
            log.append(LOG_CONSTANT.format(names=constant))
        sparse = [c for c, (n, _) in facts.items()
                  if c in df.columns and rows and (rows - n) / rows >= cfg.high_missing_threshold]
        if cfg.drop_high_missing and sparse:
            df = drop_columns(df, sparse)
            log.append(LOG_HIGH_MISSING.format(n=len(sparse), share=cfg.high_missing_threshold, names=sparse))

    numeric = [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in ids]
    categorical = [c for c in df.columns if c not in numeric and c not in ids]

    def drop_rows(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
        gone = "not counted"
        if count_rows:
            gone = df.agg(F.count_if(~_all_present(columns))).first()[0]
        log.append(LOG_ROWS.format(n=gone, kind=kind))
        return drop_missing_rows(df, columns)

    if numeric and cfg.numeric_impute == "drop_rows":
        df = drop_rows(df, numeric, "numeric")
    used = cfg.numeric_impute in ("mean", "median", "zero") or cfg.outlier_treatment == "iqr_clip" or cfg.scaling == "robust"
    stats = _NumberStats(df, numeric, cfg) if numeric and used else None
    if numeric and cfg.numeric_impute in ("mean", "median", "zero"):
        df = stats.impute(df)
        log.append(LOG_NUMERIC.format(how=cfg.numeric_impute))

    counted = None
    if categorical and cfg.categorical_impute == "drop_rows":
        df, stats = drop_rows(df, categorical, "categorical"), None
    elif categorical and cfg.categorical_impute == "mode":
        counted = stage(value_counts(df, {c: col(c).cast("string") for c in categorical}))  # also what is to be encoded
        modes = _modes(counted, categorical)
        df = df.withColumns({c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in modes.items() if v is not None})
        log.append(LOG_CATEGORICAL.format(how="mode"))
    elif categorical and cfg.categorical_impute == "constant":
        df = impute_categorical(df, categorical, "constant", cfg.categorical_fill_value)
        log.append(LOG_CATEGORICAL.format(how=f"constant '{cfg.categorical_fill_value}'"))

    if numeric and cfg.outlier_treatment == "iqr_clip":
        df = stats.clip_iqr(df) if stats else clip_iqr(df, numeric, cfg.iqr_factor)
        log.append(LOG_IQR.format(k=cfg.iqr_factor))
    elif numeric and cfg.outlier_treatment == "zscore_clip":
        df = clip_zscore(df, numeric, cfg.zscore_threshold)
        stats = None
        log.append(LOG_ZSCORE.format(z=cfg.zscore_threshold))

    scalers = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust}
    if numeric and cfg.scaling != "none":
        if cfg.scaling == "robust" and stats:
            df = stats.scale_robust(df)
        elif cfg.scaling in scalers:
            df = scalers[cfg.scaling](df, numeric)
        log.append(LOG_SCALING.format(how=cfg.scaling))

    if categorical and cfg.categorical_encoding == "onehot":
        df = one_hot(df, categorical)
        log.append(LOG_ONE_HOT.format(n=len(categorical)))
    elif categorical and cfg.categorical_encoding == "ordinal":
        texts = {c: col(c).cast("string") for c in categorical}
        df = ordinal_codes(df, texts, missing=-1, distinct=counted.select("at", "value") if counted is not None else None)
        log.append(LOG_ORDINAL.format(n=len(categorical)))
    return df, log


class _NumberStats:
    """What the chain's number steps need to know, from one look at the values' ends and one narrowing.

    Filling, clipping and scaling keep the order of a column, so the quantiles after each step follow from order
    statistics of the column as it was. Columns with infinities, where sums of quantiles may have no value, are looked at again for each step.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], cfg: PreprocessConfig):
        self.cfg, self.columns = cfg, list(columns)
        keys = {c: f"__q{i}" for i, c in enumerate(columns)}
        means = [F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)] if cfg.numeric_impute == "mean" else []
        values, bounds, row = finite_bounds(df, {keys[c]: col(c) for c in columns}, F.count("*").alias("rows"), *means)
        fills = cfg.numeric_impute in ("mean", "median", "zero")
        self.gaps = {c: row["rows"] - row["n" + k] for c, k in keys.items() if fills and row["n" + k] < row["rows"]}
        self.plain = is_finite(bounds)
        self.held = {c for c, k in keys.items() if k in bounds}
        before = [0.5] if cfg.numeric_impute == "median" else []
        clip_at = [0.25, 0.75] if cfg.outlier_treatment == "iqr_clip" else []
        scale_at = [0.25, 0.5, 0.75] if cfg.scaling == "robust" and cfg.outlier_treatment != "zscore_clip" else []
        later = sorted({*clip_at, *scale_at}) if self.plain else []
        ranks = {k: Carried.needed(bounds[k][2], self.gaps.get(c, 0), before if c in self.gaps else [], later)
                 for c, k in keys.items() if k in bounds}
        found = order_statistics(values, ranks, bounds) if any(ranks.values()) else {}
        self.carried = {c: Carried({r: v for (key, r), v in found.items() if key == k}, bounds[k][2]) for c, k in keys.items() if k in bounds}
        self.means = {c: row.get(f"m{i}") for i, c in enumerate(columns)}

    def impute(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, extra in self.gaps.items():
            if self.cfg.numeric_impute == "zero":
                value, out[c] = 0.0, F.coalesce(col(c), F.lit(0).cast(df.schema[c].dataType))
            elif c in self.held:
                value = self.means[c] if self.cfg.numeric_impute == "mean" else self.carried[c].quantile(0.5)
                out[c] = F.coalesce(col(c).cast("double"), F.lit(value))
            if c in self.held:
                self.carried[c] = self.carried[c].filled(value, extra)
            elif c in out:  # nothing but filled values
                self.carried[c] = Carried({}, 0, extra, value)
        return df.withColumns(out)

    def clip_iqr(self, df: DataFrame) -> DataFrame:
        if not self.plain:
            return clip_iqr(df, self.columns, self.cfg.iqr_factor)
        out = {}
        for c, x in self.carried.items():
            low, high = x.quantile(0.25), x.quantile(0.75)
            reach = self.cfg.iqr_factor * (high - low)
            out[c] = clip(col(c), low - reach, high + reach)
            self.carried[c] = x.clipped(low - reach, high + reach)
        return df.withColumns(out)

    def scale_robust(self, df: DataFrame) -> DataFrame:
        if not self.plain:
            return scale_robust(df, self.columns)
        out = {}
        for c, x in self.carried.items():
            low, middle, high = (x.quantile(p) for p in (0.25, 0.5, 0.75))
            if high - low:
                out[c] = (col(c) - F.lit(middle)) / F.lit(high - low)
        return df.withColumns(out)
