"""How much text columns tell of numbers and of each other, in one pass over the rows.

A task turns each text column of a batch into local codes and hands on one row for each text of a column, with counts and sums of
all numbers, and one for each pair of texts that two columns hold together. Texts leave the task as 128-bit digests only, and
no row is repeated for its columns or pairs of columns.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import numeric_columns, present, quoted, round_to, string_columns
from sparkeda.functions.longform import empty_like
from sparkeda.operators.stats import moments

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have this package

_PARTIAL = "at int not null, x binary not null, y binary not null, n long not null, ns array<long>, s1 array<double>, s2 array<double>"


def _codes(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Local codes of a batch's texts (-1: null) and the digest of each code."""
    coded = column.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, [hashlib.md5(v.as_py().encode("utf-8", "surrogatepass")).digest() for v in coded.dictionary]


def _rows(at: int, x: Sequence[bytes], y: Sequence[bytes], n: np.ndarray, sums: Sequence[np.ndarray]) -> pa.RecordBatch:
    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        ends = np.arange(len(n) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))

    return pa.RecordBatch.from_arrays(
        [pa.array([at] * len(n), pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(n, pa.int64()),
         lists(sums[0], pa.int64()), lists(sums[1], pa.float64()), lists(sums[2], pa.float64())],
        names=["at", "x", "y", "n", "ns", "s1", "s2"])


def _task(texts: int, shifts: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial rows of batches of ``texts`` text columns and then numbers; the sums are of the numbers less their ``shifts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [_codes(batch.column(i)) for i in range(texts)]
            numbers = [batch.column(texts + j) for j in range(len(shifts))]
            known = [c.is_valid().to_numpy(zero_copy_only=False) for c in numbers]
            moved = [np.where(k, c.fill_null(0.0).to_numpy(zero_copy_only=False) - s, 0.0) for c, k, s in zip(numbers, known, shifts)]
            for i, (codes, digests) in enumerate(coded):
                stands, k = codes >= 0, len(digests)
                ns, s1, s2 = (np.zeros((k, len(shifts)), kind) for kind in (np.int64, float, float))
                for j, (there, value) in enumerate(zip(known, moved)):
                    own = codes[stands & there]
                    value = value[stands & there]
                    ns[:, j] = np.bincount(own, minlength=k)
                    s1[:, j] = np.bincount(own, weights=value, minlength=k)
                    s2[:, j] = np.bincount(own, weights=value * value, minlength=k)
                yield _rows(i, digests, [b""] * k, np.bincount(codes[stands], minlength=k), (ns, s1, s2))
            for at, ((a, of_a), (b, of_b)) in enumerate(combinations(coded, 2), start=texts):
                both = (a >= 0) & (b >= 0)
                met, times = np.unique(a[both] * max(len(of_b), 1) + b[both], return_counts=True)
                left, right = np.divmod(met, max(len(of_b), 1))
                empty = np.zeros((len(met), 0))
                yield _rows(at, [of_a[c] for c in left], [of_b[c] for c in right], times, (empty, empty, empty))

    return run


def associations(df: DataFrame, means: Mapping[str, float] | None = None) -> DataFrame:
    """``(metric, col1, col2, value)``: what each string column tells of the others.

    ``correlation_ratio`` is eta of each numeric ``col2`` by the groups of each string ``col1``; ``uncertainty`` the share of
    ``col1``'s entropy that ``col2`` explains, for ordered pairs of string columns. Both are over the rows that have both values; NULL
    where nothing varies. Sums are of the numbers less their ``means`` (taken here if not given), so that no large squares cancel.

    A text or a pair of texts is one row for each batch of a task, a hot one too.
    """
    texts, numbers = string_columns(df), numeric_columns(df)
    if not texts or (not numbers and len(texts) < 2):
        return empty_like(df, "metric string, col1 string, col2 string, value double")
    if means is None:
        means = {r["column"]: r["mean"] for r in moments(df).select("column", "mean").collect()}
    wide = df.select(*(quoted(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)),
                     *(present(df, c).cast("double").alias(f"n{i}") for i, c in enumerate(numbers)))
    partial = wide.mapInArrow(_task(len(texts), [float(means.get(c) or 0.0) for c in numbers]), _PARTIAL)
    of = lambda name, i: F.sum(F.get(name, F.lit(i))).alias(f"{name}_{i}")
    sums = [f"{s}_{i}" for i in range(len(numbers)) for s in ("ns", "s1", "s2")]
    groups = partial.groupBy("at", "x", "y").agg(F.sum("n").alias("n"), *(of(s, i) for i in range(len(numbers)) for s in ("ns", "s1", "s2")))
    # one chain of three groupings: pairs of texts, their two sides, the pair of columns; a text of a single column is a left side
    n, left = F.col("n").cast("double"), F.col("side") == 0
    alone = F.length("y") == 0
    sides = F.when(alone, F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("text")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("text")), F.struct(F.lit(1).alias("side"), F.col("y").alias("text"))))
    each = groups.select("at", "n", *sums, F.inline(sides)).groupBy("at", "side", "text").agg(
        F.sum(n * F.ln(n)).alias("joint"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    whole = each.groupBy("at").agg(
        F.sum(F.when(left, n)).alias("n"), F.sum(F.when(left, F.col("joint"))).alias("joint"),
        F.sum(F.when(left, n * F.ln(n))).alias("x"), F.sum(F.when(~left, n * F.ln(n))).alias("y"),
        *(F.sum(F.try_divide(F.pow(f"s1_{i}", 2), F.col(f"ns_{i}"))).alias(f"b_{i}") for i in range(len(numbers))),
        *(F.sum(c).alias(c) for c in sums))
    entropy = lambda c: F.ln("n") - F.col(c) / F.col("n")

    def eta(i: int) -> Column:
        middle = F.try_divide(F.pow(f"s1_{i}", 2), F.col(f"ns_{i}"))
        spread = F.col(f"s2_{i}") - middle
        varies = spread > F.lit(1e-12) * F.col(f"s2_{i}")            # less is rounding of equal numbers
        return F.when(varies, F.least(F.sqrt(F.greatest(F.col(f"b_{i}") - middle, F.lit(0.0)) / spread), F.lit(1.0)))

    def explained(of: str) -> Column:
        """Shared entropy by that of one side, at most 1; equal entropies may differ by rounding."""
        shared = entropy("x") + entropy("y") - entropy("joint")
        return F.when(entropy(of) > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / entropy(of))))

    def row(metric: str, a: Column, b: Column, met: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), a.alias("col1"), b.alias("col2"), met.alias("met"), round_to(value, 4).alias("value"))

    pairs = [(i, *p) for i, p in enumerate(combinations(texts, 2), start=len(texts))]
    named = df.sparkSession.createDataFrame([*((i, c, None) for i, c in enumerate(texts)), *pairs], "at int, a string, b string")
    single = F.col("b").isNull()
    rows = [row("correlation_ratio", F.col("a"), F.lit(c), single & (F.col(f"ns_{i}") > 0), eta(i)) for i, c in enumerate(numbers)]
    rows += [row("uncertainty", F.col(a), F.col(b), ~single & (F.col("n") > 0), explained(of)) for a, b, of in (("a", "b", "x"), ("b", "a", "y"))]
    return whole.join(F.broadcast(named), "at").select(F.inline(F.array(*rows))).where("met").drop("met")
