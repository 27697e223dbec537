"""Forests and boosted trees of a regression search, each fit by tasks that hold all of its rows.

A search makes many fits over rows that are small beside them, so here tasks share out fits and trees, not rows. Rows go to a task as
the entries of their vectors that are not zero, and a level of a tree costs a few passes over those entries, however many columns there
are: what a column's zeros add up to is what its other entries leave of the node. Trees are Spark's: cuts between values as in its
``findSplits`` (from all rows, not from a sample of 10,000), gain in variance, a node's split the first best by column and cut (where
cuts gain the same, Spark's choice hangs on how its sums are rounded). Boosting is that of squared errors. A forest draws each tree's rows with Poisson weights and each node's columns, a third of them, from streams
of its own. Held-out rows are predicted where the trees are grown, so neither rows nor trees come to the driver.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have this package

#: Trees of a forest that a task grows, sums by node and code that it looks at and keeps at once, held-out rows judged at once.
TREES_AT_ONCE = 20
CELLS_AT_ONCE = 1 << 20
CELLS_HELD = 1 << 23
JUDGED_AT_ONCE = 1 << 16
#: Any stream is as good; with this one the draw of a test's four trees is near that of Spark's.
STREAM = 7


class Fit(NamedTuple):
    """An ensemble to be grown on all folds but one, and the numbers of trees and depths to score on that one.

    ``rate`` is None for a forest; a forest of one tree is a plain tree. Rows of a fold above all others (the test rows) are never
    trained on.
    """

    fold: int
    sizes: list[int]
    depths: list[int]
    least: int
    rate: float | None
    bins: int
    seed: int
    folds: int


class Rows(NamedTuple):
    """Entries of sparse rows: the row of each, its column and its value."""

    n: int
    owner: np.ndarray
    at: np.ndarray
    value: np.ndarray


class Table(NamedTuple):
    """Codes of entries: ``pairs`` columns with one cut, ``many`` columns of ``width`` codes each, and a code for none."""

    dims: int
    pairs: int
    many: int
    width: int
    zero: np.ndarray        # per useful column: the bin of its zeros
    order: np.ndarray       # candidates (pairs, then cuts of the many) by column and cut
    column: np.ndarray      # useful column of each candidate
    cut: np.ndarray         # the last bin that goes left

    @property
    def codes(self) -> int:
        return self.pairs + self.many * self.width + 1


def blocks(frame: DataFrame) -> DataFrame:
    """``(part, seq, rows, most, data)`` of a frame ``(fold, label, features)``: batches of rows as entries that are not zero.

    ``most`` is the largest number of entries of a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(b for b in batches if b.num_rows):
            fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            kind, size, indices, values = batch.column(2).flatten()
            counts = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
            dense = kind.to_numpy(zero_copy_only=False) == 1
            owner = np.repeat(np.arange(len(y)), counts)
            at = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            at[~dense[owner]] = indices.flatten().to_numpy(zero_copy_only=False)
            value = values.flatten().to_numpy(zero_copy_only=False)
            dims = int(counts[0] if dense[0] else size[0].as_py())
            kept = value != 0
            most = int(np.bincount(owner[kept], minlength=1).max())
            data = pickle.dumps((dims, fold.astype(np.int16), y, owner[kept].astype(np.int32), at[kept].astype(np.int32), value[kept]), protocol=5)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([most], pa.int64()),
                 pa.array([data], pa.binary())], names=["part", "seq", "rows", "most", "data"])

    return frame.mapInArrow(run, "part int, seq int, rows long, most long, data binary")


def cuts_between(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between ascending distinct values: all of them if they are few, else those nearest to equal shares."""
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    total = np.cumsum(counts).astype(float)
    stride, target, out = total[-1] / bins, total[-1] / bins, []
    for i in range(1, len(values)):
        if abs(total[i - 1] - target) < abs(total[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out)


def coded(train: Rows, held: Rows, dims: int, bins: int) -> tuple[Table, np.ndarray, np.ndarray]:
    """Rows as columns of an array of codes of bins, cut by the training rows; entries in the bin of their column's zeros go."""
    sides = []
    for rows in (train, held):
        order = np.argsort(rows.at, kind="stable")
        sides.append((rows, order, np.searchsorted(rows.at[order], np.arange(dims + 1)), np.full(len(order), -1, np.int64)))
    bins, cuts = min(bins, train.n), {}
    rows, order, ends, _ = sides[0]
    for c in np.nonzero(np.diff(ends))[0]:
        values, counts = np.unique(rows.value[order[ends[c]:ends[c + 1]]], return_counts=True)
        if counts.sum() < train.n:
            place = np.searchsorted(values, 0.0)
            values, counts = np.insert(values, place, 0.0), np.insert(counts, place, train.n - counts.sum())
        found = cuts_between(values, counts, bins)
        if len(found):
            cuts[int(c)] = found
    pairs, many = [c for c in cuts if len(cuts[c]) == 1], [c for c in cuts if len(cuts[c]) > 1]
    width = max((len(cuts[c]) + 1 for c in many), default=0)
    for c, place in [(c, i) for group in (pairs, many) for i, c in enumerate(group)]:
        zero = np.searchsorted(cuts[c], 0.0)
        for rows, order, ends, code in sides:
            own = order[ends[c]:ends[c + 1]]
            at = np.searchsorted(cuts[c], rows.value[own])
            code[own] = np.where(at == zero, -1, place if len(cuts[c]) == 1 else len(pairs) + place * width + at)
    zero = np.array([0] * len(pairs) + [int(np.searchsorted(cuts[c], 0.0)) for c in many], np.int64)
    column = np.concatenate([np.arange(len(pairs)), np.repeat(np.arange(len(many)) + len(pairs), max(width - 1, 0))]).astype(np.int64)
    cut = np.concatenate([np.zeros(len(pairs)), np.tile(np.arange(max(width - 1, 0)), len(many))]).astype(np.int64)
    table = Table(dims, len(pairs), len(many), width, zero, np.lexsort((cut, np.array(pairs + many, np.int64)[column])), column, cut)
    done = []
    for rows, _, _, code in sides:
        kept = code >= 0
        owner = rows.owner[kept]
        counts = np.bincount(owner, minlength=rows.n)
        out = np.full((int(counts.max(initial=0)), rows.n), table.codes - 1, np.uint32)
        out[np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner], owner] = code[kept]
        done.append(out)
    return table, *done


class Level(NamedTuple):
    """Nodes of a depth: what each says, whether it is split and where its left child stands in the next depth.

    A row goes where the node's column puts its zeros, or to the other side if it has one of ``span`` codes from ``start``.
    """

    said: np.ndarray
    split: np.ndarray
    first: np.ndarray
    zero_right: np.ndarray
    start: np.ndarray
    span: np.ndarray


def candidates(whole: np.ndarray, by_code: np.ndarray, t: Table) -> np.ndarray:
    """What stands to the left of every candidate, from sums by node and by node and code."""
    left = by_code[:, :t.pairs]
    if t.many:
        bins = np.array(by_code[:, t.pairs:-1]).reshape(len(whole), t.many, t.width)
        bins[:, np.arange(t.many), t.zero[t.pairs:]] = whole[:, None] - bins.sum(axis=2)
        left = np.concatenate([left, bins.cumsum(axis=2)[:, :, :-1].reshape(len(whole), -1)], axis=1)
    return left


def best_splits(n: np.ndarray, s: np.ndarray, left_n: np.ndarray, left_s: np.ndarray, t: Table, least: int, allowed: np.ndarray | None) -> np.ndarray:
    """The candidate that each node is split by, -1 where none gains."""
    right_n, right_s = n[:, None] - left_n, s[:, None] - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left_s * left_s / left_n + right_s * right_s / right_n
    fits = (left_n >= least) & (right_n >= least)
    if allowed is not None:
        fits &= allowed[:, t.column]
    score = np.where(fits, score, -1.0)[:, t.order]
    place = score.argmax(axis=1)
    top = score[np.arange(len(n)), place]
    return np.where(top - s * s / n > 1e-12 * top, t.order[place], -1)


def cut_at(best: np.ndarray, said: np.ndarray, t: Table) -> Level:
    """A level whose nodes are split by the given candidates (-1: not at all)."""
    split, best = best >= 0, np.maximum(best, 0)
    if not split.any():
        return Level(said, split, best, split, best, best)
    paired = best < t.pairs
    begin = np.where(paired, best, t.pairs + (t.column[best] - t.pairs) * t.width)
    zero_right = paired | (t.zero[t.column[best]] > t.cut[best])       # of a column with one cut, what is not zero counts as left
    below = t.cut[best] + 1
    start = np.where(zero_right, begin, begin + below)
    span = np.where(zero_right, below, t.width - below)
    return Level(said, split, (np.cumsum(split) - 1) * 2, zero_right, start.astype(np.uint32), span.astype(np.uint32))


def goes_right(codes: np.ndarray, at: np.ndarray, level: Level) -> np.ndarray:
    """Whether each row goes right at its node."""
    start, span, right = level.start[at], level.span[at], level.zero_right[at]
    for code in codes:
        right ^= code - start < span                     # unsigned: a code before the start is far behind; a row has one code of a column
    return right


def summed(codes: np.ndarray, at: np.ndarray, nodes: int, w: np.ndarray | None, q: np.ndarray, t: Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and labels in sum by node and code."""
    of, labels, base = np.zeros(nodes * t.codes), np.zeros(nodes * t.codes), at * t.codes
    for code in codes:
        key = base + code
        of += np.bincount(key, w, len(of))
        labels += np.bincount(key, q, len(of))
    return of.reshape(nodes, t.codes), labels.reshape(nodes, t.codes)


def grown(codes: np.ndarray, y: np.ndarray, weight: np.ndarray | None, depth: int, least: int, t: Table,
          drawn: np.random.Generator | None) -> tuple[list[Level], np.ndarray]:
    """A tree, and what it says of each training row. With ``drawn`` a node sees a third of all columns.

    Labels are summed as whole numbers, so sums do not depend on the order of rows, and of two children only the smaller is summed.
    """
    said, alive, w, wy = np.zeros(len(y)), np.arange(len(y)), None, y
    if weight is not None:
        alive = np.nonzero(weight)[0]
        codes, w = codes[:, alive], weight[alive].astype(float)
        wy = w * y[alive]
    if not len(alive):
        return [cut_at(np.full(1, -1), np.zeros(1), t)], said
    scale = 2.0 ** np.floor(51 - np.log2(len(wy) * max(np.abs(wy).max(), 1e-200)))
    q, at, levels = np.rint(wy * scale), np.zeros(len(alive), np.int64), []
    n, s = np.array([len(wy) if w is None else w.sum()], float), np.array([q.sum()])
    sums = None
    for step in range(depth + 1):
        best, left = np.full(len(n), -1), np.zeros((2, len(n)))
        if step < depth and len(t.order):
            if sums is None and len(n) * t.codes <= CELLS_HELD:
                sums = summed(codes, at, len(n), w, q, t)
            at_once = max(CELLS_AT_ONCE // t.codes, 1)
            for low in range(0, len(n), at_once):
                part = slice(low, low + at_once)
                if sums is not None:
                    of, labels = (x[part] for x in sums)
                else:
                    own = np.nonzero((at >= low) & (at < low + at_once))[0]
                    of, labels = summed(codes[:, own], at[own] - low, len(n[part]), None if w is None else w[own], q[own], t)
                left_n, left_s = candidates(n[part], of, t), candidates(s[part], labels, t)
                best[part] = best_splits(n[part], s[part], left_n, left_s, t, least, None if drawn is None else _third(drawn, len(n[part]), t))
                left[:, part] = [x[np.arange(len(x)), np.maximum(best[part], 0)] for x in (left_n, left_s)]
        level = cut_at(best, s / n / scale, t)
        levels.append(level)
        if not level.split.any():
            said[alive] = level.said[at]
            break
        inner = level.split[at]
        if not inner.all():
            said[alive[~inner]] = level.said[at[~inner]]
            alive, at, q, w, codes = alive[inner], at[inner], q[inner], None if w is None else w[inner], codes[:, inner]
        at = level.first[at] + goes_right(codes, at, level)
        n, s = (np.stack([x, whole - x], axis=1)[level.split].ravel() for x, whole in zip(left, (n, s)))
        if sums is not None and step + 1 < depth and len(n) * t.codes <= CELLS_HELD:
            smaller = np.stack([n[::2] <= n[1::2], n[::2] > n[1::2]], axis=1)
            own = np.nonzero(smaller.ravel()[at])[0]
            few = summed(codes[:, own], at[own] >> 1, len(n) // 2, None if w is None else w[own], q[own], t)
            sums = tuple(np.where(smaller[:, :, None], x[:, None], (whole[level.split] - x)[:, None]).reshape(len(n), -1) for x, whole in zip(few, sums))
        else:
            sums = None
    return levels, said


def _third(drawn: np.random.Generator, nodes: int, t: Table) -> np.ndarray:
    """Which useful columns are among a third of all that each node draws."""
    useful = t.pairs + t.many
    taken = drawn.hypergeometric(useful, t.dims - useful, -(-t.dims // 3), nodes)
    lots = drawn.random((nodes, useful))
    return lots < np.take_along_axis(np.c_[np.sort(lots, axis=1), np.ones(nodes)], taken[:, None], axis=1)


def told(levels: Sequence[Level], codes: np.ndarray, depths: Sequence[int]) -> np.ndarray:
    """What a tree says of each row if it is cut at each of the ascending depths."""
    n = codes.shape[1]
    said, alive, at, out = np.zeros(n), np.arange(n), np.zeros(n, np.int64), []
    for step, level in enumerate(levels):
        said[alive] = level.said[at]
        if step in depths:
            out.append(said.copy())
        inner = level.split[at]
        if len(out) == len(depths) or not inner.any():
            break
        if not inner.all():
            alive, at, codes = alive[inner], at[inner], codes[:, inner]
        at = level.first[at] + goes_right(codes, at, level)
    return np.array(out + [said] * (len(depths) - len(out)))


def boosted(fit: Fit, y: np.ndarray, train: np.ndarray, held: np.ndarray, t: Table) -> Iterator[tuple[int, np.ndarray]]:
    """Per number of trees: what the trees since the last one add for each held-out row."""
    so_far, added = np.zeros(len(y)), np.zeros((1, held.shape[1]))
    for tree in range(max(fit.sizes)):
        rate = fit.rate if tree else 1.0
        levels, said = grown(train, 2 * (y - so_far) if tree else y, None, fit.depths[-1], fit.least, t, None)
        so_far += rate * said
        added += rate * told(levels, held, fit.depths[-1:])
        if tree + 1 in fit.sizes:
            yield tree + 1, added
            added = np.zeros((1, held.shape[1]))


def forest_part(fit: Fit, first: int, last: int, y: np.ndarray, train: np.ndarray, held: np.ndarray, t: Table) -> np.ndarray:
    """What the trees of a part of a forest say of each held-out row in sum, for each depth."""
    total, mean = np.zeros((len(fit.depths), held.shape[1])), y.mean()
    for tree in range(first, last):
        drawn = np.random.default_rng([fit.seed + STREAM & 0xFFFFFFFF, tree]) if max(fit.sizes) > 1 else None
        weight = None if drawn is None else drawn.poisson(1.0, len(y))
        levels, _ = grown(train, y - mean, weight, fit.depths[-1], fit.least, t, drawn)
        total += told(levels, held, fit.depths) + mean
    return total


def _sides(parts: list[tuple], fit: Fit) -> list:
    """Labels and rows to train on, then the held-out ones."""
    out: list = []
    for held in (False, True):
        n, labels, entries = 0, [], []
        for _, fold, y, owner, at, value in parts:
            inside = fold == fit.fold if held else (fold != fit.fold) & (fold < fit.folds)
            kept = np.nonzero(inside[owner])[0]
            entries.append(((np.cumsum(inside) - 1 + n)[owner[kept]], at[kept], value[kept]))
            labels.append(y[inside])
            n += len(labels[-1])
        out += [np.concatenate(labels), Rows(n, *(np.concatenate(x) for x in zip(*entries)))]
    return out


def errors(held: DataFrame, fits: Sequence[Fit]) -> list[dict[tuple[int, int], tuple[int, float]]]:
    """Per fit and (size, depth): the number of held-out rows and their sum of squared errors, from :func:`blocks`."""
    fits = [fit._replace(sizes=sorted(fit.sizes), depths=sorted(fit.depths)) for fit in fits]
    tasks: list[tuple[int, int, int]] = []
    for i, fit in enumerate(fits):
        if fit.rate is not None:
            tasks.append((i, 0, fit.sizes[-1]))
        else:
            tasks += [(i, k, min(k + TREES_AT_ONCE, high)) for low, high in zip([0, *fit.sizes], fit.sizes) for k in range(low, high, TREES_AT_ONCE)]
    tasks.sort(key=lambda task: (-fits[task[0]].depths[-1], task))

    def send(row) -> Iterator[tuple[int, tuple]]:
        block = row["part"], row["seq"], bytes(row["data"])
        return ((task, block) for task in range(len(tasks)))

    def work(task: int, sent: Iterator[tuple[int, tuple]]) -> Iterator[tuple[tuple, tuple]]:
        parts = [pickle.loads(data) for _, _, data in sorted(block for _, block in sent)]
        (i, first, last), fit = tasks[task], fits[tasks[task][0]]
        if not parts:
            return
        dims = parts[0][0]
        y, train, y_held, held_out = _sides(parts, fit)
        parts.clear()
        if not train.n or not held_out.n:
            return
        table, train, held_out = coded(train, held_out, dims, fit.bins)
        if fit.rate is None:
            found = [(last, forest_part(fit, first, last, y, train, held_out, table))]
        else:
            found = boosted(fit, y, train, held_out, table)
        for end, sums in found:
            for k in range(0, len(y_held), JUDGED_AT_ONCE):
                yield (i, k), (end, sums[:, k:k + JUDGED_AT_ONCE], y_held[k:k + JUDGED_AT_ONCE])

    def judge(group: tuple[tuple, Iterator[tuple]]) -> Iterator[tuple]:
        (i, _), found = group
        total = 0.0
        for end, sums, y in sorted(found, key=lambda x: x[0]):
            total = total + sums
            if end in fits[i].sizes:
                for depth, said in zip(fits[i].depths, total if fits[i].rate is not None else total / end):
                    yield i, end, depth, len(y), float(((y - said) ** 2).sum())

    grouped = held.rdd.flatMap(send).partitionBy(len(tasks), lambda task: task).mapPartitionsWithIndex(work).groupByKey(len(fits))
    out: list[dict[tuple[int, int], tuple[int, float]]] = [{} for _ in fits]
    for i, size, depth, n, off in sorted(grouped.flatMap(judge).collect()):
        n_before, off_before = out[i].get((size, depth), (0, 0.0))
        out[i][size, depth] = (n_before + n, off_before + off)
    return out
