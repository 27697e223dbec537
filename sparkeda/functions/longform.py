"""Wide rows to long rows.

Statistics run on the long form ``(column, value)`` grouped by column: one small
aggregate that whole-stage codegen compiles well at any table width, where one wide
aggregate with a slot per column outgrows what the JIT will compile. Map-side
combining leaves one row per column and task for the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import numeric_columns, present, quoted, string_columns


def empty_like(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def every_column(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column)``: one row per name, to join statistics to so that columns without a value stay."""
    return df.sparkSession.createDataFrame([(c,) for c in names], "column string")


def _unpivot(df: DataFrame, cols: Sequence[str], value_type: str) -> DataFrame:
    if not cols:
        return empty_like(df, f"column string, value {value_type}")
    wide = df.select(*[present(df, c).cast(value_type).alias(c) for c in cols])
    return wide.unpivot([], [quoted(c) for c in cols], "column", "value")


def numeric_long(df: DataFrame, cols: Sequence[str] | None = None, keep_null: bool = False) -> DataFrame:
    """``(column, value double)`` over the numeric columns."""
    long = _unpivot(df, numeric_columns(df, cols), "double")
    return long if keep_null else long.where(F.col("value").isNotNull())


def string_long(df: DataFrame, cols: Sequence[str] | None = None, keep_null: bool = False) -> DataFrame:
    """``(column, value string)`` over the string columns."""
    long = _unpivot(df, string_columns(df, cols), "string")
    return long if keep_null else long.where(F.col("value").isNotNull())


def text_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value string)`` over any scalar columns, values as text, NULLs dropped."""
    return _unpivot(df, cols, "string").where(F.col("value").isNotNull())


def numeric_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(pair, x, y)``: one row per row and column pair, both sides present; ``pair`` counts from 0."""
    if not pairs:
        return empty_like(df, "pair int, x double, y double")
    names = sorted({c for p in pairs for c in p})
    wide = df.select(*[present(df, c).cast("double").alias(c) for c in names])
    cells: list[Column] = [F.lit(len(pairs))]
    for i, (a, b) in enumerate(pairs):
        cells += [F.lit(i), quoted(a), quoted(b)]
    return (
        wide.select(F.stack(*cells).alias("pair", "x", "y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def rows_from(one_row: DataFrame, rows: Sequence[Sequence[tuple[str, Column]]]) -> DataFrame:
    """Spread one row of fused aggregates into the given long rows."""
    structs = [F.struct(*[c.alias(n) for n, c in row]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


def column_order(df: DataFrame, cols: Sequence[str]) -> Column:
    """Schema position of the name held in ``column``."""
    mapping: list[Column] = []
    for i, c in enumerate(cols):
        mapping += [F.lit(c), F.lit(i)]
    return F.create_map(*mapping)[F.col("column")] if mapping else F.lit(0)


def held(small: DataFrame) -> DataFrame:
    """A result as long as the schema (rows per column or column pair), computed now and kept.

    Several operators can then start from it without scanning the table again.
    """
    return small.sparkSession.createDataFrame(small.collect(), small.schema)
