"""Comparing two sets of flags: two runs, or a run and another method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..session import stage

# Names a stored score may have, the mark of an absent parameter, rows listed.
SCORE_NAMES = ("TOTAL SCORE", "TOTAL_SCORE")
ABSENT = "—"
DIFF_ROWS = 200


def score_column(results: DataFrame) -> Column:
    """The stored score as a number; 0 where there is none."""
    for name in SCORE_NAMES:
        if name in results.columns:
            return F.coalesce(col(name).cast("string").try_cast("double"), F.lit(0.0))
    return F.lit(0.0)


def flag_rows(results: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Ids and whether the row was flagged."""
    return results.select(*map(col, id_cols), (score_column(results) > 0).alias("flagged"))


def joined_flags(a: DataFrame, b: DataFrame, id_cols: Sequence[str], same_rows: bool = True) -> DataFrame:
    """Rows flagged by ``a`` or ``b``, as ``(ids, in_a, in_b)``.

    If both cover the same rows, only flagged rows need to meet. Otherwise rows known to one side
    only do not count, so all rows are joined.
    """
    ids = list(id_cols)
    if same_rows:
        left = a.where("flagged").select(*map(col, ids), F.lit(True).alias("in_a"))
        right = b.where("flagged").select(*map(col, ids), F.lit(True).alias("in_b"))
        both = left.join(right, ids, "full_outer")
        no = F.lit(False)
        return both.select(*map(col, ids), F.coalesce("in_a", no).alias("in_a"), F.coalesce("in_b", no).alias("in_b"))
    left, right = a.withColumnRenamed("flagged", "in_a"), b.withColumnRenamed("flagged", "in_b")
    return left.join(right, ids, "inner").where("in_a or in_b")


def overlap(flags: DataFrame, both: str = "both", only_a: str = "only_a", only_b: str = "only_b") -> DataFrame:
    """Counts of rows flagged by both sides, and by one of them."""
    return flags.agg(F.count_if(F.expr("in_a and in_b")).alias(both),
                     F.count_if(F.expr("in_a and not in_b")).alias(only_a),
                     F.count_if(F.expr("in_b and not in_a")).alias(only_b))


def compare_runs(a: dict, b: dict, id_cols: Sequence[str]) -> DataFrame:
    """Overlap of two loaded runs."""
    return overlap(_run_flags(a, b, id_cols))


def _run_flags(a: dict, b: dict, id_cols: Sequence[str]) -> DataFrame:
    return joined_flags(flag_rows(a["results"], id_cols), flag_rows(b["results"], id_cols), id_cols,
                        same_rows=a["dataset_id"] == b["dataset_id"])


def compare_params(spark: SparkSession, a: dict, b: dict) -> DataFrame:
    """Parameters of two runs side by side."""
    def table(params: dict, value: str) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in params.items()], f"parameter string, {value} string")

    return (table(a, "run_a").join(table(b, "run_b"), "parameter", "full_outer")
            .na.fill(ABSENT, ["run_a", "run_b"]).orderBy("parameter"))


def compare_diff_rows(a: dict, b: dict, dataset: DataFrame, id_cols: Sequence[str], n: int = DIFF_ROWS) -> DataFrame:
    """First ``n`` rows flagged by exactly one run, with their data."""
    differing = stage(_run_flags(a, b, id_cols).where("in_a <> in_b").orderBy(*map(col, id_cols)).limit(n))
    # At most n keys go to the dataset, which is scanned once and not shuffled.
    data = dataset.join(F.broadcast(differing.select(*map(col, id_cols))), list(id_cols))
    return differing.join(data, list(id_cols), "left").orderBy(*map(col, id_cols))


def agreed_rows(data: DataFrame, flags: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Rows of ``data`` flagged by both sides."""
    return data.join(flags.where("in_a and in_b").select(*map(col, id_cols)), list(id_cols), "left_semi")
