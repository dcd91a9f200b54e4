"""Text expressions: spreadsheet safety, output names, readable explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import col

# First characters a spreadsheet would read as the start of a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")

# Characters kept in an output name, characters trimmed at its ends, its default.
NAME_REPLACED = r"[^A-Za-z0-9._-]+"
NAME_TRIMMED = "._-"
NAME_DEFAULT = "results"


def neutral_cell(value: Column) -> Column:
    """Quote text that a spreadsheet would run as a formula."""
    return F.when(F.substring(value, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), value)).otherwise(value)


def neutral_name(name: str) -> str:
    return "'" + name if name[:1] in FORMULA_STARTS else name


def sanitize_for_spreadsheet(df: DataFrame) -> DataFrame:
    """Neutralise text cells and column names; other types pass through."""
    return df.select(*[
        (neutral_cell(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name))
        .alias(neutral_name(f.name))
        for f in df.schema
    ])


def safe_label(value: Column, default: str = NAME_DEFAULT) -> Column:
    """A label reduced to characters that are safe in a file name."""
    joined = F.regexp_replace(F.coalesce(value, F.lit("")), NAME_REPLACED, "_")
    trimmed = F.btrim(joined, F.lit(NAME_TRIMMED))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(default))


def reason_lines(reasons: Column) -> Column:
    """``array<struct<cols, vals>>`` to one readable line per reason; malformed ones are left out."""
    sound = F.filter(reasons, lambda r: F.size(r["cols"]) == F.size(r["vals"]))
    return F.transform(sound, lambda r: F.array_join(
        F.zip_with(r["cols"], r["vals"], lambda c, v: F.concat(c, F.lit(" = "), v)), " AND "))


def reason_text(reasons: Column, separator: str = "; ") -> Column:
    return F.array_join(reason_lines(reasons), separator)
