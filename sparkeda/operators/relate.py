"""How numeric columns move together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import numeric_columns, present, round_to
from sparkeda.functions.longform import empty_like, every_column, numeric_long, numeric_pairs

#: A variance below this share of the mean square is rounding: the column is constant where the other one is present.
FLAT = 1e-12


def pair_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(col1, col2, n, r)`` for each pair once, ``col1`` before ``col2`` in the schema.

    Pairwise-complete, at any width: one scan takes the columns less their means in batches and sums four matrix products
    of values and presence masks; a task hands on one row per pair. ``r`` is NULL where a side is constant or no row has
    both sides.
    """
    names = numeric_columns(df, cols)
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return empty_like(df, "col1 string, col2 string, n long, r double")
    wide = df.select(*[present(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    means = wide.agg(F.struct(*[F.avg(c).alias(c) for c in wide.columns])).scalar()
    centred = wide.select(*[(F.col(c) - means[c]).alias(c) for c in wide.columns])
    first, second = np.array(pairs).T

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((len(names), len(names))) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            sx += x.T @ m
            sxx += (x * x).T @ m
            sxy += x.T @ x
        cells = (n[first, second], sx[first, second], sx[second, first], sxx[first, second], sxx[second, first], sxy[first, second])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first))), *map(pa.array, cells)], ["pair", *_SUMS])

    sums = centred.mapInArrow(products, "pair long, " + ", ".join(f"{s} double" for s in _SUMS)).groupBy("pair").agg(
        *[F.sum(s).alias(s) for s in _SUMS])
    n = F.col("n")
    vx, vy = (F.col(f"s{a}{a}") / n - F.pow(F.col(f"s{a}") / n, F.lit(2.0)) for a in "xy")
    varies = (n > 0) & (vx > FLAT * F.col("sxx") / n) & (vy > FLAT * F.col("syy") / n)
    r = F.when(varies, (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n) / F.sqrt(vx * vy))
    listed = df.sparkSession.createDataFrame(
        [(i, names[a], names[b]) for i, (a, b) in enumerate(pairs)], "pair long, col1 string, col2 string")
    return listed.join(sums, "pair", "left").select(
        "col1", "col2", F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """``(col1, col2, corr)``: the full signed Pearson matrix with its diagonal, NULL where there is no correlation."""
    r = round_to(F.col("r"), digits)
    upper = pair_stats(df, cols).select("col1", "col2", r.alias("corr"))
    lower = F.array(F.struct("col1", "col2", "corr"),
                    F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "corr"))
    both = upper.select(F.inline(lower))
    ends = numeric_long(df, cols).groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spread = every_column(df, numeric_columns(df, cols)).join(ends, "column", "left")
    own = spread.select(F.col("column").alias("col1"), F.col("column").alias("col2"),
                        F.when(F.col("hi") > F.col("lo"), F.lit(1.0)).alias("corr"))
    return both.unionByName(own)


def high_corr_pairs(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.8) -> DataFrame:
    """``(col1, col2, corr, signed)`` of pairs with |r| above ``limit`` before rounding, strongest first."""
    return (
        pair_stats(df, cols).where(F.abs("r") > limit)
        .select("col1", "col2", round_to(F.abs("r"), 3).alias("corr"), round_to(F.col("r"), 3).alias("signed"))
        .orderBy(F.desc("corr"), "col1", "col2")
    )


def top_corr_pairs(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """The ``k`` strongest pairs by |r|, any strength."""
    return (
        pair_stats(df, cols).where(F.col("r").isNotNull())
        .orderBy(F.abs("r").desc(), "col1", "col2").limit(k)
        .select("col1", "col2", round_to(F.abs("r"), 3).alias("corr"))
    )


def pair_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation between two columns and the rows it rests on."""
    sums = numeric_pairs(df, [(x, y)]).agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))
    return sums.select(F.lit(x).alias("col1"), F.lit(y).alias("col2"), "n", round_to(r, 4).alias("corr"))
