"""Column kinds and the one notion of "missing" used everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8,
    "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, kind: str, cols: Sequence[str] | None = None) -> list[str]:
    """Columns of one kind in schema order, optionally restricted to ``cols``."""
    return [
        f.name for f in df.schema
        if kind_of(f.dataType) == kind and (cols is None or f.name in cols)
    ]


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return columns_of(df, "numeric", cols)


def string_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return columns_of(df, "categorical", cols)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so NULL is the only missing value."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def clean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Project ``cols`` (default all) with NaN normalised to NULL."""
    names = df.columns if cols is None else list(cols)
    return df.select(*[present(df, c).alias(c) for c in names])


def round_to(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double, as array libraries do.

    Adding 0.0 folds a negative zero into zero.
    """
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a rounded percentage of ``max(whole, 1)``."""
    share = part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")
    return round_to(share * F.lit(100.0), digits)
