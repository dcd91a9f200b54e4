"""Small column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the text that stands for a missing category.
MISSING_TEXT = "nan"

# A number as a reader would accept it in text: sign, digits, exponent, or an infinity.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into NULL and minus zero into zero: one notion of missing, one of zero."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None)) + F.lit(0.0).cast(dtype)
    return col(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name: present(f.name, f.dataType) for f in df.schema
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floats) if floats else df


def as_number(value: Column, dtype: T.DataType) -> Column:
    """The value as a double; text that is not a number, and NaN, give NULL."""
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(NUMBER_PATTERN), value.try_cast("double"))
    return value.cast("double")


def category_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING_TEXT))


def clip(value: Column, low=None, high=None) -> Column:
    """Bound a value from both sides and leave NULL as it is."""
    out = value
    if low is not None:
        out = F.when(value < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(value > high, F.lit(high)).otherwise(out)
    return out


def count_passed(value: Column, edges: Sequence[float], strict: bool) -> Column:
    """How many of the edges a value has passed (``>`` if strict, else ``>=``)."""
    steps = [(value > F.lit(e) if strict else value >= F.lit(e)).cast("int") for e in edges]
    return balanced_sum(steps) if steps else F.when(value.isNotNull(), F.lit(0))


def balanced_sum(terms: Sequence[Column]) -> Column:
    """Sum written as a balanced tree, so that long sums stay shallow."""
    terms = list(terms)
    while len(terms) > 1:
        paired = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def require_flat(df: DataFrame, columns: Sequence[str]) -> None:
    types = {f.name: f.dataType for f in df.schema}
    nested = [c for c in columns if is_nested(types[c])]
    if nested:
        raise TypeError(f"nested columns are not supported as input: {nested}")
