"""Many settings from one fitted ensemble of trees.

A boosted model of 50 trees is the first half of one of 100, a tree grown to depth 10 is the upper part of one grown to 30, and the
first 50 trees of a forest are a forest of 50. So a grid over the number of trees and the depth needs one fit for all of them; the
smaller models are read off its nodes. For boosting and single trees the scores are those of separate fits. Forests draw their
rows and columns from one stream, so a part of a larger one is a forest of that size, but not the one that its own fit would draw.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.sources.files import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have this package


class Tree(NamedTuple):
    """Nodes of a tree by their number; ``left`` is -1 at a leaf. A row of ``sets`` holds the codes that go left at a node, -1: none."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    at_set: np.ndarray
    sets: np.ndarray
    prediction: np.ndarray
    counts: np.ndarray


class Ensemble(NamedTuple):
    """A fitted model: its trees, their weights (boosting only) and the number of classes (0: a regression)."""

    trees: list[Tree]
    weights: list[float] | None
    classes: int


def _trees(nodes: pa.Table) -> list[Tree]:
    of = lambda name: nodes[name].combine_chunks()
    number = lambda name: of(name).to_numpy(zero_copy_only=False)
    order = np.lexsort((number("id"), number("tree")))
    codes, left = number("codes"), number("left")
    cuts, length = of("cuts").flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(of("cuts")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(order)), length)
    coded = (codes >= 0) & (left >= 0)
    sets = np.zeros((max(int(coded.sum()), 1), max(int(codes[coded].max(initial=1)), 1)), bool)
    at_set = np.where(coded, np.cumsum(coded) - 1, -1)
    sets[at_set[owner[coded[owner]]], cuts[coded[owner]].astype(int)] = True
    threshold = np.zeros(len(order))
    first = np.cumsum(length) - length
    plain = (codes < 0) & (length > 0)
    threshold[plain] = cuts[first[plain]]
    columns = (left, number("right"), np.maximum(number("feature"), 0), threshold, at_set)
    more = (number("prediction"), of("counts").flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1))
    ends = np.nonzero(np.diff(number("tree")[order]))[0] + 1
    return [Tree(*(x[own] for x in columns), sets, *(x[own] for x in more)) for own in np.split(order, ends)]


def ensembles(model: Transformer, classes: int) -> list[Ensemble]:
    """The trees of a fitted model, read from the form in which Spark stores it; one ensemble for each class of one against the rest."""
    if isinstance(model, OneVsRestModel):
        return [e for m in model.models for e in ensembles(m, classes)]
    spark = SparkSession.active()
    path = new_path(spark, "trees")
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "treeID" not in stored.columns:                       # a single tree
        stored = stored.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    nodes = stored.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("counts"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("cuts"),
        F.col("nodeData.split.numCategories").alias("codes"))
    boosted = isinstance(model, (GBTClassificationModel, GBTRegressionModel))
    return [Ensemble(_trees(nodes.toArrow()), list(model.treeWeights) if boosted else None, classes)]


def reached(tree: Tree, rows: np.ndarray, depths: Sequence[int]) -> list[np.ndarray]:
    """The node where each row ends if the tree is cut at each of the ascending depths."""
    at, out, all_rows = np.zeros(len(rows), int), [], np.arange(len(rows))
    for step in range(max(depths) + 1):
        if step in depths:
            out.append(at)
        inner = tree.left[at] >= 0
        if not inner.any():
            break
        value = rows[all_rows, tree.feature[at]]
        which = tree.at_set[at]
        code = np.clip(value, 0, tree.sets.shape[1] - 1).astype(int)
        goes_left = np.where(which >= 0, tree.sets[which, code], value <= tree.threshold[at])
        at = np.where(inner, np.where(goes_left, tree.left[at], tree.right[at]), at)
    return out + [at] * (len(depths) - len(out))


def outputs(model: Ensemble, rows: np.ndarray, sizes: Sequence[int], depths: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """Per (size, depth): what the first ``size`` trees, cut at ``depth``, say of each row.

    A mean or weighted sum for numbers and for boosting, votes of the classes for a forest or tree that classifies.
    """
    votes = model.classes > 0 and model.weights is None
    total = [np.zeros((len(rows), model.classes) if votes else len(rows)) for _ in depths]
    out = {}
    for t, tree in enumerate(model.trees[:max(sizes)]):
        shares = tree.counts / np.maximum(tree.counts.sum(axis=1, keepdims=True), 1e-300) if votes else None
        for d, at in enumerate(reached(tree, rows, depths)):
            total[d] += shares[at] if votes else tree.prediction[at] * (model.weights[t] if model.weights else 1.0)
        for d, depth in enumerate(depths):
            if t + 1 in sizes:
                out[t + 1, depth] = total[d] / (t + 1) if not votes and model.weights is None else total[d].copy()
    return out


def predicted(models: Sequence[Ensemble], rows: np.ndarray, sizes: Sequence[int], depths: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """Predictions per (size, depth). Several boosted models stand one for each class against the rest."""
    said = [outputs(m, rows, sizes, depths) for m in models]
    if len(models) > 1:
        return {k: np.argmax([s[k] for s in said], axis=0).astype(float) for k in said[0]}
    if models[0].classes and models[0].weights:
        return {k: (v > 0).astype(float) for k, v in said[0].items()}
    return {k: v.argmax(axis=1).astype(float) for k, v in said[0].items()} if models[0].classes else said[0]


def nested_scores(
    held_out: DataFrame, models: Sequence[Ensemble], sizes: Sequence[int], depths: Sequence[int], label: str, features: str
) -> dict[tuple[int, int], float]:
    """Accuracy, or R2 for numbers, of each (size, depth) on the held-out rows: one pass, a row of sums for each task and setting."""
    keys = [(s, d) for s in sizes for d in depths]
    numbers = models[0].classes == 0
    bound = held_out.sparkSession.sparkContext.broadcast(list(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, off = 0, np.zeros(len(keys))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                found = predicted(bound.value, flat.reshape(len(y), -1), sizes, sorted(depths))
                n += len(y)
                off += [((y - found[k]) ** 2).sum() if numbers else (y != found[k]).sum() for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(keys)), pa.int32()), pa.array([n] * len(keys), pa.int64()), pa.array(off, pa.float64())], names=["at", "n", "off"])

    rows = held_out.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    sums = {r["at"]: r for r in rows.mapInArrow(run, "at int, n long, off double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("off").alias("off")).collect()}
    spread = held_out.agg(F.var_pop(label)).first()[0] if numbers else 1.0
    return {k: 1.0 - sums[i]["off"] / (sums[i]["n"] * spread) for i, k in enumerate(keys)}
