"""Writing tables and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, is_nested
from ..functions.text import reason_text, sanitize_for_spreadsheet

# Formats that can be written, and what of a run can be written.
FORMATS = ("csv", "parquet", "json")
TARGETS = ("flagged", "all", "summary")


# Spark would cut blanks at the ends of a cell.
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def flatten_nested(df: DataFrame) -> DataFrame:
    """Reasons as readable text, other nested columns as JSON, for formats without nesting."""
    def flat(f: T.StructField):
        if not is_nested(f.dataType):
            return col(f.name)
        element = getattr(f.dataType, "elementType", None)
        if isinstance(element, T.StructType) and element.names == ["cols", "vals"]:
            return reason_text(col(f.name)).alias(f.name)
        return F.to_json(col(f.name)).alias(f.name)

    return df.select(*[flat(f) for f in df.schema])


def export(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> str:
    """Write ``df`` as ``csv`` (spreadsheet-safe), ``parquet`` or ``json`` (one record per line).

    The result is a folder of part files, written in parallel.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"Unknown export format: {fmt}")
    if fmt == "csv":
        safe = sanitize_for_spreadsheet(flatten_nested(df))
        safe.write.mode(mode).csv(path, header=True, escape='"', **KEEP_BLANKS)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).json(path, ignoreNullFields=False)
    return path


def export_result(result, path: str, fmt: str, target: str = "flagged", mode: str = "errorifexists") -> str:
    """Write the flagged rows, all rows with scores, or the summary of a run."""
    if target not in TARGETS:
        raise ValueError(f"Unknown export target: {target}")
    table = {"flagged": result.most_flagged, "all": result.breakdown_all, "summary": result.flagged_summary}[target]()
    return export(table, path, fmt, mode)
