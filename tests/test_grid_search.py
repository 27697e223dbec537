"""The pooled grid search over nested ensembles against Spark's cross validation."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator

from sparkeda.operators import ensembles, regrowth, training


def rows(spark, classes, n=260):
    rng = random.Random(classes)
    out = []
    for i in range(n):
        x, y, kind = rng.gauss(0, 1), rng.random(), rng.choice("abcd")
        score = 2 * x + (3 if kind in "ab" else 0) + 4 * (y > 0.6) * (x > 0) + rng.gauss(0, 0.4)
        label = float(score) if not classes else float(np.searchsorted([1.5, 4.0][:classes - 1], score))
        out.append((i, x, y, kind, label if not classes else str(int(label)), None if i % 9 else 1.0))
    kind = "string" if classes else "double"
    return spark.createDataFrame(out, f"id long, x double, y double, kind string, target {kind}, gaps double").coalesce(1)


@pytest.fixture()
def small_grids(monkeypatch):
    for name, values in {"FOREST_TREES": [2, 4], "TREE_DEPTHS": [5, 1], "LEAST_SPLIT": [2], "BOOST_TREES": [1, 4], "BOOST_RATES": [0.5],
                         "BOOST_DEPTHS": [2], "LOGISTIC_C": [0.01, 10.0]}.items():
        monkeypatch.setattr(training, name, values)


@pytest.mark.parametrize("classes", [0, 3])
def test_equals_cross_validation(spark, small_grids, classes):
    prep = training.prepare(rows(spark, classes), "target", "id")
    assert prep.task == ("classification" if classes else "regression") and prep.classes == classes
    names = ["gradient_boosting", "decision_tree"] if classes else None
    got = {r["model"]: r for r in training.grid_search(prep, names, parallelism=8).collect()}
    score = MulticlassClassificationEvaluator(labelCol=training.LABEL, metricName="accuracy") if classes else RegressionEvaluator(
        labelCol=training.LABEL, metricName="r2")
    prep.train.persist()
    spaces = training.search_space(prep.task, prep.classes, prep.train.count())
    assert list(got) == [n for n in spaces if n in (names or spaces)] and all(r["error"] is None for r in got.values())
    for name in got:
        estimator, grid = spaces[name]
        # one search for each entry: a grid over the classifier of one against the rest is lost in Spark's copy of it
        metrics = [CrossValidator(estimator=training._with(estimator, training._settings(p)), estimatorParamMaps=[{}], evaluator=score,
                                  numFolds=training.FOLDS, parallelism=3, seed=42).fit(prep.train).avgMetrics[0] for p in grid]
        best = max(range(len(grid)), key=lambda i: metrics[i])
        assert got[name]["combinations"] == len(grid)
        if name == "random_forest":                      # a forest of the same size, drawn otherwise
            assert got[name]["cv_score"] == pytest.approx(metrics[best], abs=0.1)
        else:
            assert got[name]["cv_score"] == pytest.approx(metrics[best], abs=1e-9)
            chosen = next(i for i, p in enumerate(grid) if training._describe(training._settings(p)) == got[name]["best_params"])
            assert metrics[chosen] == pytest.approx(metrics[best], abs=1e-9)
            assert chosen == best
    prep.train.unpersist()


def predictions(model, df, size, depth, classes):
    x = np.array([r[0] for r in df.select(vector_to_array(training.FEATURES)).collect()])
    return ensembles.predicted(ensembles.ensembles(model, classes), x, [size], [depth])[size, depth]


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_a_whole_ensemble_predicts_as_the_model(spark, classes):
    prep = training.prepare(rows(spark, classes), "target", "id")
    for name in training.NESTED:
        size = 1 if name == "decision_tree" else 3
        trees = {"random_forest": "numTrees", "gradient_boosting": "maxIter"}.get(name)
        model = training._with(training.candidates(prep.task, prep.classes)[name], {"maxDepth": 3, **({trees: size} if trees else {})}).fit(prep.train)
        want = [r["prediction"] for r in model.transform(prep.test).collect()]
        np.testing.assert_allclose(predictions(model, prep.test, size, training.DEEPEST, classes), want, rtol=1e-9)


def test_part_of_a_forest_is_a_forest_of_its_own(spark):
    """The first trees of a larger forest, cut, are not the smaller forest's own, but fit as well: what the sharing rests on."""
    prep = training.prepare(rows(spark, 0, 900), "target", "id")
    forest = RandomForestRegressor(labelCol=training.LABEL, featuresCol=training.FEATURES, seed=1, maxDepth=6)
    large, small = (forest.copy({forest.numTrees: t, forest.maxDepth: d}).fit(prep.train) for t, d in ((24, 6), (12, 4)))
    y = np.array([r[0] for r in prep.test.select(training.LABEL).collect()])
    part, own = predictions(large, prep.test, 12, 4, 0), predictions(small, prep.test, 12, 4, 0)
    assert not np.allclose(part, own)
    error = lambda p: ((p - y) ** 2).mean() / y.var()
    assert error(part) == pytest.approx(error(own), abs=0.1)


def test_training_rows_are_dealt_over_tasks(spark, monkeypatch):
    """A compact file is one part with all rows; fits get it in parts of a bounded number of rows, the same ones in every run."""
    prep = training.prepare(rows(spark, 0, 900), "target", "id")
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 100)
    def parts(frame):
        return frame.rdd.glom().map(lambda part: [r["id"] for r in part]).collect()

    whole, once, again = (parts(p.train) for p in (prep, training.dealt(prep), training.dealt(prep)))
    assert len(whole) == 1 and max(map(len, once)) < 200
    assert once == again and sorted(i for part in once for i in part) == sorted(whole[0])
    seen = training._held(prep, lambda held: held.train.rdd.getNumPartitions())
    assert seen == len(once) == -(-len(whole[0]) // 100)
    assert training.dealt(training.dealt(prep)).train.rdd.getNumPartitions() == seen
    monkeypatch.undo()
    assert training.dealt(prep) is prep


def mixed_rows(spark, n=1500):
    """Sparse and dense vectors with negative, repeated, constant, empty and many-valued columns, in several parts."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 2), float(rng.random() < 0.1), rng.choice([-1.0, 0.0, 3.0]), 7.0, 0.0, -float(rng.random() < 0.5), float(rng.randrange(60)), rng.random() * (i % 3)]
        y = 3 * (x[0] > 0.5) + 2 * x[2] + 5 * x[1] * x[5] + x[6] / 9 + rng.gauss(0, 0.3)
        vector = Vectors.dense(x) if i % 4 else Vectors.sparse(len(x), [(j, v) for j, v in enumerate(x) if v])
        out.append((i % 3 if i % 7 else 3, y, vector))
    return spark.createDataFrame(out, ["fold", "y", "x"]).repartition(3, "y").cache()


def fit(fold=1, sizes=(1,), depths=(2, 6), least=1, rate=None, bins=32):
    return regrowth.Fit(fold, list(sizes), list(depths), least, rate, bins, 7, 3)


@pytest.mark.parametrize("rate, least, bins", [(None, 4, 32), (None, 4, 8), (0.3, 1, 32)])
def test_regrown_trees_are_spark_s(spark, rate, least, bins):
    df, io = mixed_rows(spark), {"labelCol": "y", "featuresCol": "x", "minInstancesPerNode": least, "maxBins": bins}
    for fold in (1, 3):                                  # a fold of the training rows, then the test rows
        train, held = df.where((df.fold != fold) & (df.fold < 3)), df.where(df.fold == fold)
        sizes, depths = ([1], [2, 6]) if rate is None else ([2, 5], [4])
        (got,) = regrowth.errors(regrowth.blocks(df), [fit(fold, sizes, depths, least, rate, bins)])
        assert set(got) == {(s, d) for s in sizes for d in depths}
        for (size, depth), (n, off) in got.items():
            spark_s = DecisionTreeRegressor(maxDepth=depth, **io) if rate is None else GBTRegressor(maxDepth=depth, maxIter=size, stepSize=rate, **io)
            said = spark_s.fit(train).transform(held).select("y", "prediction").toPandas()
            assert n == len(said) and off == pytest.approx(((said.y - said.prediction) ** 2).sum(), rel=1e-9)


def test_sums_kept_or_not_give_the_same_trees(spark, monkeypatch):
    """Wide levels are summed in parts, and what a level's sums do not fit is summed anew; forests are cut into tasks and slices."""
    rows = regrowth.blocks(mixed_rows(spark)).cache()
    fits = [fit(sizes=(1,), depths=(3, 30)), fit(sizes=(2, 4), depths=(5,), rate=0.1), fit(sizes=(3, 5), depths=(1, 9))]
    whole = regrowth.errors(rows, fits)
    # by value: tasks take this module's constants with its functions
    for name, value in {"CELLS_AT_ONCE": 200, "CELLS_HELD": 500, "TREES_AT_ONCE": 1, "JUDGED_AT_ONCE": 100}.items():
        monkeypatch.setattr(regrowth, name, value)
    parts = regrowth.errors(rows, fits)
    for one, other in zip(whole[:2], parts):
        assert other == {at: (n, pytest.approx(off, rel=1e-9)) for at, (n, off) in one.items()}
    assert {at: n for at, (n, _) in whole[2].items()} == {at: n for at, (n, _) in parts[2].items()}      # columns are drawn part by part


def test_search_for_numbers_needs_no_fit_for_each_round(spark, small_grids, monkeypatch):
    """Before, each level of each round of boosting was a job of its own; now a fit is a task's work."""
    prep = training.prepare(rows(spark, 0), "target", "id")
    names = ["random_forest", "gradient_boosting"]
    monkeypatch.setattr(training, "ENTRIES_AT_ONCE", 0)
    one_by_one = {r["model"]: r for r in training.grid_search(prep, names, parallelism=8).collect()}
    monkeypatch.undo()
    for name, values in {"FOREST_TREES": [2, 4], "TREE_DEPTHS": [5, 1], "LEAST_SPLIT": [2], "BOOST_TREES": [1, 4], "BOOST_RATES": [0.5], "BOOST_DEPTHS": [2]}.items():
        monkeypatch.setattr(training, name, values)

    def no_fit(*_):
        raise AssertionError("fitted over all tasks")

    for kind in (RandomForestRegressor, GBTRegressor):
        monkeypatch.setattr(kind, "fit", no_fit)
    got = {r["model"]: r for r in training.grid_search(prep, names, parallelism=8).collect()}
    assert list(got) == list(one_by_one) == names
    for name, row in got.items():
        assert row["error"] is None and row["combinations"] == one_by_one[name]["combinations"]
        if name != "random_forest":                      # forests are drawn otherwise
            assert row["best_params"] == one_by_one[name]["best_params"]
            assert (row["cv_score"], row["test_score"]) == pytest.approx((one_by_one[name]["cv_score"], one_by_one[name]["test_score"]), rel=1e-9)
