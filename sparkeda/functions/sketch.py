"""A mergeable rank sketch whose error is known exactly.

A sketch of some values is a sorted sample with weights: the weights of the sample up to ``v`` add up to a number ``e(v)``, and
between ``e(v)`` and ``e(v) + slack`` of the values are <= ``v``. ``slack`` is counted while the sketch is made, not estimated, so
the value of any rank lies in a known interval, whatever the values are and however the sketches were merged. Up to ``MOST``
different values are kept as they are, with a slack of 0.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import present

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have this package

#: Values that a sketch keeps. A million values leave an interval of about a thousandth of them.
MOST = 1 << 12
#: Cells of a task that are sorted at once, over all columns, and rows at most. An executor holds them several times for each core.
CELLS, ROWS = 1 << 20, 1 << 17
#: Sketches of a column that a task merges at once; tasks whose sketches meet first.
PENDING, TASKS = 16, 256

Sketch = tuple[np.ndarray, np.ndarray, int]
SCHEMA = "column int, part int, slack long, sample array<double>, weights array<long>"


def thinned(values: np.ndarray, weights: np.ndarray, slack: int, most: int) -> Sketch:
    """At most ``most`` of sorted different values; one that stays takes over the weight of those left out before it."""
    if len(values) <= most:
        return values, weights, slack
    upto = np.cumsum(weights)
    lots = (upto - 1) // -(-int(upto[-1]) // most)
    last = np.nonzero(np.append(lots[1:] != lots[:-1], True))[0]
    held = np.diff(upto[last], prepend=0)
    return values[last], held, slack + int((held - weights[last]).max())


def sketched(values: np.ndarray, most: int) -> Sketch:
    different, times = np.unique(values, return_counts=True)
    return thinned(different, times.astype(np.int64), 0, most)


def merged(sketches: Sequence[Sketch], most: int) -> Sketch:
    """The sketch of all values of several; slacks add up."""
    values = np.concatenate([s[0] for s in sketches])
    different, at = np.unique(values, return_inverse=True)
    weights = np.zeros(len(different), np.int64)
    np.add.at(weights, at, np.concatenate([s[1] for s in sketches]))
    return thinned(different, weights, sum(s[2] for s in sketches), most)


def bracket(sketch: Sketch, low: int, high: int) -> tuple[float | None, float]:
    """(a, b): the values of the 1-based ranks from ``low`` to ``high`` are above a (None: no bound) and at most b."""
    values, weights, slack = sketch
    upto = np.cumsum(weights)
    before = int(np.searchsorted(upto, low - slack)) - 1
    return (None if before < 0 else float(values[before])), float(values[np.searchsorted(upto, high)])


def _task(width: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rows = max(most, min(ROWS, CELLS // width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting: list[list[np.ndarray]] = [[] for _ in range(width)]
        made: list[list[Sketch]] = [[] for _ in range(width)]
        held = 0

        def flush() -> None:
            for i, parts in enumerate(waiting):
                values = np.concatenate(parts) if parts else np.empty(0)
                if len(values):
                    made[i].append(sketched(values, most))
                if len(made[i]) >= PENDING:
                    made[i] = [merged(made[i], most)]
                waiting[i] = []

        for batch in batches:
            for i in range(width):
                waiting[i].append(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= rows:
                flush()
                held = 0
        flush()
        part = TaskContext.get().partitionId() // TASKS
        for i, sketches in enumerate(made):
            if sketches:
                values, weights, slack = merged(sketches, most) if len(sketches) > 1 else sketches[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([slack], pa.int64()), pa.array([values], pa.list_(pa.float64())),
                     pa.array([weights], pa.list_(pa.int64()))], names=["column", "part", "slack", "sample", "weights"])

    return run


def _of(rows: pd.DataFrame, most: int) -> Sketch:
    return merged([(np.asarray(v, float), np.asarray(w, np.int64), int(s)) for v, w, s in zip(rows["sample"], rows["weights"], rows["slack"])], most)


class Wanted(NamedTuple):
    """Ranks wanted of a column, by its place among the columns: ``nn`` values are present, ``at`` are the fractional 0-based positions.

    ``points`` are the ends of disjoint ascending intervals that hold the values of all ranks next to these positions, each above
    its first end and at most its second; the first one is minus infinity where nothing bounds it.
    """

    column: int
    nn: int
    at: list[float]
    points: list[float]
    open: bool


def _wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[present(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])


def wanted(df: DataFrame, names: Sequence[str], probs: Sequence[float], most: int | None = None) -> list[Wanted]:
    """What the numeric columns ``names`` have at ``probs``; columns without a value are absent. One scan, run now.

    A task hands on a sketch for each column; those of ``TASKS`` tasks meet first, then all of a column. A row for each column,
    as long as ``probs``, comes to the driver.
    """
    kept = most or MOST

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values, weights, slack = _of(rows, kept)
        return pd.DataFrame({"column": [key[0]], "part": [0], "slack": [slack], "sample": [values], "weights": [weights]})

    def final(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sketch = _of(rows, 4 * kept)
        n = int(sketch[1].sum())
        at = [float(p) * (n - 1) for p in probs]
        found = [bracket(sketch, int(np.floor(x)) + 1, int(np.ceil(x)) + 1) for x in at]
        unbounded = any(a is None for a, _ in found)
        apart: list[list[float]] = []
        for a, b in sorted((-np.inf if a is None else a, b) for a, b in found):
            if apart and a < apart[-1][1]:
                apart[-1][1] = max(apart[-1][1], b)
            else:
                apart.append([a, b])
        return pd.DataFrame({"column": [key[0]], "nn": [n], "at": [at], "points": [[x for ab in apart for x in ab]], "open": [unbounded]})

    first = _wide(df, names).mapInArrow(_task(len(names), kept), SCHEMA).groupBy("column", "part").applyInPandas(meet, SCHEMA)
    rows = first.groupBy("column").applyInPandas(final, "column int, nn long, at array<double>, points array<double>, open boolean").collect()
    return sorted(Wanted(r["column"], r["nn"], list(r["at"]), list(r["points"]), r["open"]) for r in rows)


def opened(df: DataFrame, names: Sequence[str], ranks: Sequence[Wanted], cuts: int) -> DataFrame:
    """``(column, slot, cut, value, times)``: the values inside the intervals with their counts, and one count for each space between.

    ``slot`` ascends with the values: even between the intervals (null value) and odd inside one, which is cut into ``cuts`` even
    parts. Any parts give the same order; equal values are one row for each task.
    """
    def counted(i: int, points: np.ndarray, unbounded: bool, parts: list[np.ndarray], between: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0), np.empty(0, np.int64))
        slot = _slot(points, unbounded, values)
        start, end = points[np.maximum(slot - 1, 0)], points[np.minimum(slot, len(points) - 1)]
        with np.errstate(all="ignore"):
            even = np.floor((values - start) / (end - start) * cuts)
        cut = np.where(np.isfinite(end - start) & np.isfinite(even), np.minimum(even, cuts - 1), 0)
        spaces = np.nonzero(between)[0]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(spaces) + len(values), i), pa.int32()), pa.array(np.concatenate([spaces, slot]), pa.int32()),
            pa.array(np.concatenate([np.zeros(len(spaces)), cut]).astype(np.int32)), pa.array([*[None] * len(spaces), *values.tolist()], pa.float64()),
            pa.array(np.concatenate([between[spaces], times]).astype(np.int64)),
        ], names=["column", "slot", "cut", "value", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(np.array(w.points), w.open) for w in ranks]
        inside: list[list[np.ndarray]] = [[] for _ in ranks]
        between = [np.zeros(len(p) + 1, np.int64) for p, _ in ends]
        held = 0
        for batch in batches:
            for i, (w, (points, unbounded)) in enumerate(zip(ranks, ends)):
                values = batch.column(w.column).drop_null().to_numpy(zero_copy_only=False)
                slot = _slot(points, unbounded, values)
                within = slot % 2 == 1
                inside[i].append(values[within])
                held += len(inside[i][-1])
                between[i] += np.bincount(slot[~within], minlength=len(points) + 1)
            if held >= CELLS:
                for i, (w, (points, unbounded)) in enumerate(zip(ranks, ends)):
                    yield from counted(w.column, points, unbounded, inside[i], between[i])
                    inside[i], between[i] = [], np.zeros(len(points) + 1, np.int64)
                held = 0
        for i, (w, (points, unbounded)) in enumerate(zip(ranks, ends)):
            yield from counted(w.column, points, unbounded, inside[i], between[i])

    # not null, or filters for nulls would keep the two uses of the result from sharing one exchange
    found = _wide(df, names).mapInArrow(run, "column int not null, slot int not null, cut int not null, value double, times long not null")
    return found.groupBy("column", "slot", "cut", "value").agg(F.sum("times").alias("times"))


def _slot(points: np.ndarray, unbounded: bool, values: np.ndarray) -> np.ndarray:
    """How many points are below each value; an unbounded first one is below all."""
    slot = np.searchsorted(points, values, side="left")
    return np.maximum(slot, 1) if unbounded else slot
