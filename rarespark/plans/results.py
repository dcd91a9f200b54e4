"""Analysis of one run: cards, distributions, reasons, threshold sweep, pair tables, audit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from copy import copy

from pyspark.sql import DataFrame, functions as F

from ..config import SWEEP_DIMENSIONS, SWEEP_THRESHOLDS
from ..functions.columns import category_text, col, present
from ..functions.text import reason_lines, reason_text
from ..operators import cells as c
from ..session import stage
from .detector import BROADCAST_BYTES, DIMS, TOTAL, RarityResult

TOP_ROWS = 50
PAIR_VALUES = 25
PAIR_TABLES = 2


def score_distribution(result: RarityResult) -> DataFrame:
    """Rows per total score."""
    return (result.weighted_scores().groupBy(col(TOTAL).alias("score"))
            .agg(F.sum("cnt").alias("rows")).orderBy("score"))


def result_cards(result: RarityResult) -> DataFrame:
    """Rows, columns, rows flagged, share flagged and top score."""
    flagged = F.coalesce(F.sum(F.when(col(TOTAL) > 0, F.col("cnt"))), F.lit(0))
    return result.weighted_scores().agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"), F.lit(len(result.features)).cast("bigint").alias("columns"),
        flagged.alias("flagged"),
        (flagged * 100.0 / F.greatest(F.sum("cnt"), F.lit(1))).alias("flagged_pct"),
        F.coalesce(F.max(col(TOTAL)), F.lit(0)).alias("top_score"))


def explanation_text(result: RarityResult) -> DataFrame:
    """Flagged rows with their reasons as text, one column per dimension examined."""
    dims = range(1, max(result.dimensions_examined, 1) + 1)
    return result.scored_rows().where(col("Any Scored")).select(
        *map(col, result.ids), *[reason_text(col(f"{d}d Explanations")).alias(f"reasons_{d}d") for d in dims])


def _explode_reasons(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    per_dim = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(reason_lines(col(f"{d}d Explanations")), none).alias("lines"))
                        for d in DIMS])
    by_dim = rows.select(*map(col, keep), F.explode(per_dim).alias("r"))
    return by_dim.select(*map(col, keep), F.col("r.dim").alias("dim"), F.posexplode("r.lines").alias("at", "reason"))


def top_flagged_reasons(result: RarityResult, n: int = TOP_ROWS) -> DataFrame:
    """Reasons of the ``n`` highest-scored rows, one per line, tagged with their dimension."""
    rows = result.scored_rows().where(col(TOTAL) > 0).orderBy(col(TOTAL).desc(), *map(col, result.ids)).limit(n)
    lines = _explode_reasons(rows, [*result.ids, TOTAL])
    return lines.select(*map(col, result.ids), col(TOTAL), "dim", "at",
                        F.concat(F.col("dim").cast("string"), F.lit("d: "), "reason").alias("reason"))


def inspect_row(result: RarityResult, ids: Mapping[str, object]) -> DataFrame:
    """Reasons of one row, by dimension."""
    row = result.scored_rows()
    for name, value in ids.items():
        row = row.where(col(name) == F.lit(value))
    return _explode_reasons(row, [*result.ids, TOTAL])


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per combination of two columns' values (as text), for combinations that occur."""
    text = {n: category_text(present(n, df.schema[n].dataType)) for n in (a, b)}
    return df.groupBy(text[a].alias(a), text[b].alias(b)).agg(F.count("*").alias("rows"))


def pair_crosstab(df: DataFrame, a: str, b: str, limit: int = PAIR_VALUES) -> DataFrame:
    """Contingency table of two columns with few values; combinations that never occur show 0."""
    pairs = pair_counts(df, a, b)
    sizes = pairs.agg(F.count_distinct(col(a)).alias("a"), F.count_distinct(col(b)).alias("b")).first()
    if sizes["a"] > limit or sizes["b"] > limit:
        raise ValueError(f"more than {limit} values in {a!r} or {b!r}")
    return pairs.groupBy(col(a)).pivot(b).agg(F.first("rows")).na.fill(0)


def row_pair_tables(result: RarityResult, ids: Mapping[str, object], limit: int = PAIR_TABLES) -> dict[tuple, DataFrame]:
    """Contingency tables behind the two-column reasons of one row, at most ``limit``."""
    row = result.scored_rows()
    for name, value in ids.items():
        row = row.where(col(name) == F.lit(value))
    found = row.select(col("2d Explanations").alias("r")).first()
    tables: dict[tuple, DataFrame] = {}
    for reason in (found["r"] if found and found["r"] else []):
        if len(tables) == limit:
            break
        try:
            tables[tuple(reason["cols"])] = pair_crosstab(result.df, *reason["cols"])
        except ValueError:
            continue
    return tables


def threshold_sweep(result: RarityResult, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Share of rows flagged at each threshold, looking at up to two columns.

    Counts do not depend on the threshold, so they are taken from the run. A row is flagged exactly
    if one of its cells is low: the smallest such cell contains no other. A cell that is low at one threshold is so at
    all larger ones, so every pattern of rows has one threshold from which on it is flagged, and a sum over
    these answers any number of thresholds at the cost of one.
    """
    spark, plan, ordered = result.spark, result.plan, sorted(map(float, thresholds))
    if plan is None or not ordered:
        return spark.createDataFrame([(float(t), 0.0) for t in thresholds], "threshold double, flagged_pct double")
    small = copy(plan)
    small.limit_to(SWEEP_DIMENSIONS)
    levels = stage(c.pattern_levels(result.patterns, result.groups, small, c.low_levels(
        result.cells().where(F.col("pos") < len(small.sets)), small, ordered)))  # sets are listed by size
    if len(result.groups) == 1:
        rows = result.patterns.join(levels, ["grp", "key"], "left")
    else:
        rows, found = result.coded_counts(), []
        sizes, left = {r["grp"]: 24 * r["count"] for r in levels.groupBy("grp").count().collect()}, BROADCAST_BYTES
        for g, size in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
            left -= size
            one = levels.where(F.col("grp") == g).select(F.col("key").alias(f"__key{g}"), F.col("level").alias(f"__level{g}"))
            key = F.expr(result.groups[g].key_sql()).alias(f"__key{g}")
            rows = rows.select("*", key).join(F.broadcast(one) if left >= 0 else one, f"__key{g}", "left")
            found.append(F.col(f"__level{g}"))
        rows = rows.withColumn("level", F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("int"))
    packed = (rows.groupBy("level").agg(F.sum("cnt").alias("cnt"))  # a row per threshold at most
              .agg(F.collect_list(F.struct("level", "cnt")).alias("counted"), F.sum("cnt").alias("total")))
    reached = lambda place: F.aggregate(F.filter("counted", lambda x: x["level"] <= place), F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"])
    listed = F.transform(F.lit([float(t) for t in thresholds]), lambda t: F.struct(
        t.alias("threshold"), (reached(F.array_position(F.lit(ordered), t) - 1) * 100.0 / F.col("total")).alias("flagged_pct")))
    return packed.select(F.inline(listed))


def audit_tables(result: RarityResult, params: Mapping[str, object] | None = None, n: int = TOP_ROWS) -> dict[str, DataFrame]:
    """The tables of a run report."""
    spark = result.spark
    listed = params if params is not None else {k: v for k, v in vars(result.cfg).items()}
    return {
        "parameters": spark.createDataFrame([(str(k), str(v)) for k, v in listed.items()], "Parameter string, Value string"),
        "cards": result_cards(result),
        "score_distribution": score_distribution(result),
        "top_rows": result.most_flagged().limit(n),
        "reasons": top_flagged_reasons(result, n),
        "summary": result.flagged_summary(),
    }
