"""Seeded lots: a repeatable random draw from the key of a row.

The same rows are drawn for any partitioning, after any retry and by any engine that has MD5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeda.functions.kinds import quoted


def lot(key: str | Sequence[str], seed: int) -> Column:
    """32 hex digits from the key columns and the seed; sorts and compares as text."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", *[quoted(k).cast("string") for k in keys], F.lit(str(seed))))


def drawn(key: str | Sequence[str], share: float, seed: int) -> Column:
    """True for about ``share`` of the keys; a larger share draws the same keys and more."""
    if share >= 1:
        return F.lit(True)
    return F.substring(lot(key, seed), 1, 8) < F.lit(f"{int(share * 16 ** 8):08x}")
