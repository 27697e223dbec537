"""Exact order statistics and running totals without a one-task sort.

Quantiles take an interval for each wanted rank from a sketch and open that alone. Running totals need every value's rank: the
value axis of a column is cut into ranges first, at every size and by one plan:

1. cut points are the values whose hash falls on one in ``EVERY``. That samples *distinct* values evenly, so a range
   holds about ``EVERY`` distinct values whatever the number of rows and however skewed they are, and the number of
   ranges grows with the distinct values. Nothing is counted while the plan is built, and a lost task that runs again
   picks the same cuts. Cuts steer the work only; any cuts give the same answer.
2. rows are counted per (column, range), combined map-side: at most one row per range and task leaves the scan.
3. only ranges that matter are opened, as (value, count) pairs, so one hot value is one row.

The cuts go to every task. They are one in ``EVERY`` of the distinct values, 8 bytes each for numbers and at most
``PREFIX`` characters for texts: 32 MB for 10 ** 12 distinct numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.kinds import numeric_columns
from sparkeda.functions.longform import empty_like, numeric_long
from sparkeda.functions.sketch import opened, wanted

EVERY = 1 << 18
PREFIX = 64
#: Even parts of the interval of a quantile; any parts give the same answer.
CUTS = 1 << 10


def with_slot(df: DataFrame) -> DataFrame:
    """Add ``slot``: how many of the sorted ``cuts`` are <= ``value``.

    A binary search as one fold over the bits of the answer, as many as the number of cuts needs: none where there are no
    cuts. (A chain of projections would be compiled, but the optimizer may fold it into one expression that doubles with
    every step.)
    """
    bits = F.ceil(F.log2(F.size("cuts") + F.lit(1))).cast("int")
    found = F.aggregate(
        F.transform(F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k)), F.lit(0),
        lambda at, step: at + F.when(F.get("cuts", at + step - 1) <= F.col("value"), step).otherwise(0))
    return df.withColumn("slot", F.when(F.size("cuts") > 0, found).otherwise(0)).drop("cuts")


def value_cuts(long: DataFrame, every: int | None = None) -> DataFrame:
    """``(column, cuts)``: sorted cut values per column, at most one row per column.

    ``long`` is ``(column, value)``. Of a text only a prefix cuts; values with that prefix follow the cut.
    """
    text = long.schema["value"].dataType.simpleString() == "string"
    cut = F.left("value", F.lit(PREFIX)) if text else F.col("value")
    picked = (
        long.select("column", cut.alias("value"))
        .where(F.pmod(F.xxhash64("value", F.lit(17)), F.lit(every or EVERY)) == 0).distinct()
    )
    return picked.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("cuts"))


def place(long: DataFrame, every: int | None = None) -> DataFrame:
    """Add ``slot``, the range each value falls into. The cuts hold one row per column."""
    return with_slot(long.join(F.broadcast(value_cuts(long, every)), "column", "left"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str] | None, probs: Sequence[float], most: int | None = None
) -> DataFrame:
    """``(column, nn, q)`` with ``q`` the linearly interpolated quantiles in ``probs`` order.

    Exact, in two scans, by one plan at every size. The first, run when this is called, leaves a sketch for each column (of ``most``
    values, see :mod:`sparkeda.functions.sketch`) and so an interval for each wanted rank. The second counts the values between
    the intervals and hands on only those inside, with their counts; an interval is cut into ``CUTS`` even parts, and only the
    part that holds a wanted rank is sorted. Columns without a value are absent.
    """
    names = numeric_columns(df, cols)
    ranks = wanted(df, names, probs, most) if names and probs else []
    if not ranks:
        return empty_like(df, "column string, nn long, q array<double>")
    asked = [(w.column, i, rank) for w in ranks for i, at in enumerate(w.at) for rank in sorted({math.floor(at) + 1, math.ceil(at) + 1})]
    held = opened(df, names, ranks, CUTS)
    parts = held.groupBy("column", "slot", "cut").agg(F.sum("times").alias("held")).withColumn(
        "upto", F.sum("held").over(W.partitionBy("column").orderBy("slot", "cut")))         # CUTS rows and a few for each interval
    ask = F.broadcast(df.sparkSession.createDataFrame(asked, "column int, i int, rank long"))
    chosen = parts.join(ask, "column").where("rank > upto - held AND rank <= upto").select(
        "column", "slot", "cut", "i", (F.col("rank") - F.col("upto") + F.col("held")).alias("rank"))
    inside = W.partitionBy("column", "slot", "cut", "i", "rank").orderBy("value")
    found = held.join(F.broadcast(chosen), ["column", "slot", "cut"]).withColumn("last", F.sum("times").over(inside)).where(
        "rank > last - times AND rank <= last")
    edge = lambda f, i: f(F.when(F.col("i") == i, F.col("value"))).alias(f"{f.__name__}{i}")
    ends = found.groupBy("column").agg(*(edge(f, i) for i in range(len(probs)) for f in (F.min, F.max)))
    names_of = df.sparkSession.createDataFrame(
        [(w.column, names[w.column], w.nn, [at - math.floor(at) for at in w.at]) for w in ranks], "at int, column string, nn long, part array<double>")
    ends_of = [(F.col(f"min{i}"), F.col(f"max{i}")) for i in range(len(probs))]
    between = [F.when(a < b, a + (b - a) * F.col("part")[i]).otherwise(a) for i, (a, b) in enumerate(ends_of)]    # also of infinities
    return ends.withColumnRenamed("column", "at").join(F.broadcast(names_of), "at").select("column", "nn", F.array(*between).alias("q"))


def running_totals(
    counted: DataFrame, measures: Sequence[str], descending: bool = False, every: int | None = None
) -> DataFrame:
    """Add ``<m>_before`` for each measure: its total over all values of the column that come first.

    ``counted`` is ``(column, value, <measures>)`` with one row per value, so a heavily
    repeated value weighs one row.
    """
    value_order = F.col("value").desc() if descending else F.col("value").asc()
    placed = place(counted, every)
    slot_order = F.col("slot").desc() if descending else F.col("slot").asc()
    over_slots = W.partitionBy("column").orderBy(slot_order).rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy("column", "slot").agg(*[F.sum(m).alias(m) for m in measures]).select(
        "column", "slot", *[F.coalesce(F.sum(m).over(over_slots), F.lit(0)).alias(f"{m}_base") for m in measures],
    )                                                   # one row per column and range
    inside = W.partitionBy("column", "slot").orderBy(value_order).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumns({f"{m}_inside": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
        .join(bases, ["column", "slot"])
        .withColumns({f"{m}_before": F.col(f"{m}_base") + F.col(f"{m}_inside") for m in measures})
        .drop("slot", *[f"{m}_{x}" for m in measures for x in ("base", "inside")])
    )
