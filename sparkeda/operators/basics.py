"""Previews, bounded samples and row or column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import clean, is_missing, quoted, string_columns
from sparkeda.functions.lots import lot


def _keys(order_by: str | Sequence[str], desc: bool = False) -> list[Column]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return [quoted(n).desc_nulls_last() if desc and i == 0 else quoted(n).asc_nulls_last()
            for i, n in enumerate(names)]


def preview(df: DataFrame, order_by: str | Sequence[str], k: int = 20, desc: bool = False) -> DataFrame:
    """First ``k`` rows; ``desc`` turns the first key, later keys break ties."""
    return df.orderBy(*_keys(order_by, desc)).limit(k)


def context_sample(
    df: DataFrame, order_by: str | Sequence[str], rows: int = 25, cols: int = 15, chars: int = 50
) -> DataFrame:
    """First rows and columns with long strings cut, as shown to a reader."""
    names = df.columns[:cols]
    texts = set(string_columns(df))
    top = preview(df, order_by, rows)
    return top.select(*[F.substring(quoted(c), 1, chars).alias(c) if c in texts else quoted(c) for c in names])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def dropna_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value (NULL or NaN) in any of ``cols``."""
    keep = F.lit(True)
    for c in cols or df.columns:
        keep = keep & ~is_missing(df, c)
    return df.where(keep)


def sample_rows(df: DataFrame, key: str | Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """At most ``k`` rows without replacement, the same rows for any partitioning.

    Rows are ordered by a seeded hash of their key; only ``k`` rows per task move.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(lot(keys, seed), *[quoted(c) for c in keys]).limit(k)


def complete_sample(df: DataFrame, cols: Sequence[str], key: str | Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Sample of ``cols`` among rows where all of them are present."""
    picked = sample_rows(dropna_rows(df, cols), key, k, seed)
    return clean(picked, list(cols))
