"""Model selection with Spark ML: the procedure of the usual AutoML run."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product
from typing import NamedTuple, TypeVar

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import numeric_columns, present, quoted, round_to, string_columns
from sparkeda.functions.longform import empty_like
from sparkeda.functions.lots import drawn
from sparkeda.operators.ensembles import ensembles, nested_scores
from sparkeda.operators.metrics import classification_report, regression_metrics
from sparkeda.operators.regrowth import Fit, blocks, errors

# The search grids.
FOREST_TREES = [50, 100]
TREE_DEPTHS = [30, 10, 20]            # 30 is Spark's largest depth and stands for "no limit"
LEAST_SPLIT = [1, 3]                  # rows per leaf, the nearest match to splitting 2 or 5 rows
BOOST_TREES = [50, 100]
BOOST_RATES = [0.05, 0.1]
BOOST_DEPTHS = [3, 5]
LOGISTIC_C = [0.1, 1.0, 10.0]
FOLDS = 3

#: Training rows of a task. Fits hold a row as some hundred bytes, and a compact file has far more rows than that in one part.
ROWS_AT_ONCE = 100_000

#: Rows and numbers in them (zeros not counted) up to which a task holds all rows of a fit of a search.
ENTRIES_AT_ONCE = 12_000_000
SHARED_OUT = ("gradient_boosting", "random_forest")

LABEL, FEATURES = "__label", "__features"
T = TypeVar("T")


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """One row ``(target, target_type, task, classes)``.

    Integers and texts with more than two values are multiclass, so an integer price becomes a
    class; only doubles with a fractional value are continuous.
    """
    x = present(df, target)
    fractional = F.lit(False)
    if df.schema[target].dataType.typeName() in ("double", "float", "decimal"):
        fractional = F.max(x != F.floor(x))
    one = df.agg(F.countDistinct(x).alias("classes"), F.coalesce(fractional, F.lit(False)).alias("fractional"))
    kind = F.when(F.col("fractional"), "continuous").when(F.col("classes") > 2, "multiclass").otherwise("binary")
    return one.select(
        F.lit(target).alias("target"), kind.alias("target_type"),
        F.when(F.col("fractional"), "regression").otherwise("classification").alias("task"), "classes")


def train_test_split(df: DataFrame, key: str | Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``, 'train' or 'test', by a seeded hash of the row key: no shuffle, repeatable anywhere."""
    return df.withColumn("split", F.when(drawn(key, test, seed), "test").otherwise("train"))


def split_counts(df: DataFrame, key: str | Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    return train_test_split(df, key, test, seed).groupBy("split").agg(F.count("*").alias("rows"))


def feature_stages(
    df: DataFrame, target: str, task: str, exclude: Sequence[str] = (), most: int = 100, hashed: int = 1 << 12
) -> Pipeline:
    """Impute, encode, assemble. Strings with more than ``most`` values are hashed, so no label list grows
    with the data; the others become one-hot vectors."""
    skip = {target, *exclude}
    numeric = [c for c in numeric_columns(df) if c not in skip]
    texts = [c for c in string_columns(df) if c not in skip]
    wide: list[str] = []
    if texts:
        sizes = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(texts)]).first()
        wide = [c for i, c in enumerate(texts) if sizes[i] > most]
        texts = [c for c in texts if c not in wide]
    stages: list = []
    inputs: list[str] = []
    if numeric:
        filled = [f"__num_{i}" for i in range(len(numeric))]
        stages.append(Imputer(inputCols=numeric, outputCols=filled, strategy="mean"))
        inputs += filled
    if texts:
        codes = [f"__idx_{i}" for i in range(len(texts))]
        dummies = [f"__hot_{i}" for i in range(len(texts))]
        stages.append(StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=codes, outputCols=dummies, dropLast=False, handleInvalid="keep"))
        inputs += dummies
    if wide:
        stages.append(FeatureHasher(inputCols=wide, outputCol="__hashed", numFeatures=hashed))
        inputs.append("__hashed")
    if not inputs:
        raise ValueError("no numeric or string feature column is left")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return Pipeline(stages=stages)


@dataclass
class Prepared:
    """Train and test rows with a feature vector and a numeric label."""

    train: DataFrame
    test: DataFrame
    task: str
    classes: int
    features: list[str]
    pipeline: PipelineModel
    labels: list[str] = field(default_factory=list)


def _with_target(df: DataFrame, target: str, task: str, keys: Sequence[str]) -> DataFrame:
    known = df.where(present(df, target).isNotNull())
    numbers = [c for c in numeric_columns(df) if c not in (target, *keys)]
    known = known.withColumns({c: present(df, c).cast("double") for c in numbers})
    if task == "classification":
        return known.withColumn("__target", quoted(target).cast("string"))
    return known.withColumn(LABEL, quoted(target).cast("double"))


def prepare(
    df: DataFrame, target: str, key: str | Sequence[str], task: str | None = None,
    exclude: Sequence[str] = (), test: float = 0.2, seed: int = 123,
) -> Prepared:
    """Split, fit the feature pipeline on the training rows only, transform both parts.

    The codes of class labels are fitted apart, over all rows, since labels of either part must be known.
    """
    if task is None:
        task = detect_task(df, target).first()["task"]
    keys = [key] if isinstance(key, str) else list(key)
    known = _with_target(df, target, task, keys)
    rest = known.where(~drawn(keys, test, seed))
    fitted = feature_stages(df, target, task, [*exclude, *keys]).fit(rest)
    held_out = known.where(drawn(keys, test, seed))
    if task == "classification":
        codes = StringIndexer(inputCol="__target", outputCol=LABEL, stringOrderType="alphabetAsc").fit(known.select("__target"))
        fitted = PipelineModel([*fitted.stages, codes])
    parts = [fitted.transform(p).select(*keys, LABEL, FEATURES) for p in (rest, held_out)]
    labels = list(fitted.stages[-1].labels) if task == "classification" else []
    names = vector_names(parts[0], feature_sources(df, target, [*exclude, *keys]))
    return Prepared(parts[0], parts[1], task, len(labels), names, fitted, labels)


def feature_sources(df: DataFrame, target: str, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    skip = {target, *exclude}
    return ([c for c in numeric_columns(df) if c not in skip], [c for c in string_columns(df) if c not in skip])


def vector_names(df: DataFrame, sources: tuple[list[str], list[str]]) -> list[str]:
    """Names of the vector slots, from the attribute metadata of the assembled column."""
    numeric, texts = sources
    attrs = df.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a.get("name", str(a["idx"]))) for group in attrs.values() for a in group)
    renamed = {f"__num_{i}": c for i, c in enumerate(numeric)}
    out = []
    for _, name in slots:
        for i, c in enumerate(texts):
            if name.startswith(f"__hot_{i}_"):
                name = f"{c}_{name[len(f'__hot_{i}_'):]}"
                break
        out.append(renamed.get(name, name))
    return out


def prepare_features(df: DataFrame, target: str, key: str | Sequence[str], task: str | None = None) -> DataFrame:
    """Key columns, ``split``, numeric ``label`` and the dense ``features`` array of every row."""
    p = prepare(df, target, key, task)
    keys = [key] if isinstance(key, str) else list(key)
    parts = [
        frame.select(*keys, F.lit(name).alias("split"), F.col(LABEL).alias("label"),
                     vector_to_array(FEATURES).alias("features"))
        for name, frame in (("train", p.train), ("test", p.test))
    ]
    return parts[0].unionByName(parts[1])


def candidates(task: str, classes: int = 2, seed: int = 123) -> dict[str, Estimator]:
    """Estimators to compare. Boosted trees are binary only in Spark, so more classes go one against the rest."""
    io = {"labelCol": LABEL, "featuresCol": FEATURES}
    if task == "regression":
        return {
            "random_forest": RandomForestRegressor(seed=seed, **io),
            "gradient_boosting": GBTRegressor(seed=seed, maxIter=20, **io),
            "decision_tree": DecisionTreeRegressor(seed=seed, **io),
            "linear_regression": LinearRegression(**io),
        }
    boost: Estimator = GBTClassifier(seed=seed, maxIter=20, **io)
    if classes > 2:
        boost = OneVsRest(classifier=boost, **io)
    return {
        "random_forest": RandomForestClassifier(seed=seed, **io),
        "gradient_boosting": boost,
        "decision_tree": DecisionTreeClassifier(seed=seed, **io),
        "logistic_regression": LogisticRegression(maxIter=100, **io),
    }


def _evaluator(task: str):
    if task == "regression":
        return RegressionEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="r2")
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="f1")


def dealt(prep: Prepared) -> Prepared:
    """With training rows dealt by their key where the parts hold more than ``ROWS_AT_ONCE`` on average.

    The rows of a part stand in order of their key, so that a forest draws the same ones in every run.
    """
    keys = [c for c in prep.train.columns if c not in (LABEL, FEATURES)]
    parts = -(-prep.train.count() // ROWS_AT_ONCE)
    if not keys or parts <= prep.train.rdd.getNumPartitions():
        return prep
    return replace(prep, train=prep.train.repartition(parts, *keys).sortWithinPartitions(*keys, LABEL))


def _held(prep: Prepared, work: Callable[[Prepared], T]) -> T:
    """Run ``work`` with the training vectors dealt and cached; iterative fits read them many times."""
    prep = dealt(prep)
    prep.train.persist()
    try:
        return work(prep)
    finally:
        prep.train.unpersist()


def train_model(prep: Prepared, name: str = "random_forest") -> Transformer:
    return _held(prep, lambda held: candidates(held.task, held.classes)[name].fit(held.train))


def predictions(prep: Prepared, model: Transformer, keys: Sequence[str] = ()) -> DataFrame:
    """Key columns, ``label`` and ``prediction`` of the test rows; with two classes and probabilities also ``score``."""
    out = model.transform(prep.test)
    score = [vector_to_array("probability")[1].alias("score")] if prep.classes == 2 and "probability" in out.columns else []
    return out.select(*keys, F.col(LABEL).alias("label"), F.col("prediction"), *score)


def _scores(prep: Prepared, model: Transformer) -> tuple[str, DataFrame]:
    held_out = predictions(prep, model)
    if prep.task == "regression":
        return "r2", regression_metrics(held_out, "label", "prediction")
    report = classification_report(held_out, "label", "prediction").where("class = 'weighted avg'")
    accuracy = held_out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).scalar()
    return "f1", report.select(
        round_to(accuracy, 4).alias("accuracy"), "precision", "recall", "f1")


def leaderboard(prep: Prepared, names: Sequence[str] | None = None) -> DataFrame:
    """``(rank, model, <scores>)`` on the test rows, best F1 or R2 first. One failing model does not stop the rest."""
    def work(prep: Prepared) -> DataFrame:
        spark = prep.train.sparkSession
        rows, order = [], "f1" if prep.task == "classification" else "r2"
        for name in names or candidates(prep.task, prep.classes):
            try:
                _, frame = _scores(prep, candidates(prep.task, prep.classes)[name].fit(prep.train))
                rows.append({"model": name, **frame.first().asDict(), "error": None})
            except Exception as exc:  # noqa: BLE001 - reported in the row
                rows.append({"model": name, "error": str(exc)[:200]})
        rows.sort(key=lambda r: -(r.get(order) if r.get(order) is not None else float("-inf")))
        scores = ["accuracy", "precision", "recall", "f1"] if prep.task == "classification" else ["r2", "mae", "mse", "rmse"]
        ddl = "rank long, model string, " + ", ".join(f"{s} double" for s in scores) + ", error string"
        return spark.createDataFrame(
            [(i + 1, r["model"], *[r.get(s) for s in scores], r["error"]) for i, r in enumerate(rows)], ddl)

    return _held(prep, work)


def fallback_model(prep: Prepared) -> DataFrame:
    """Scores of the plain linear model used when comparing fails."""
    name = "linear_regression" if prep.task == "regression" else "logistic_regression"
    return _scores(prep, train_model(prep, name))[1].select(F.lit(name).alias("model"), "*")


def search_space(task: str, classes: int, rows: int, seed: int = 42) -> dict[str, tuple[Estimator, list]]:
    """Estimator and full parameter grid per model. C maps to regParam = 1 / (C * rows)."""
    models = candidates(task, classes, seed)
    forest, tree, boost = models["random_forest"], models["decision_tree"], models["gradient_boosting"]
    inner = boost.getClassifier() if isinstance(boost, OneVsRest) else boost
    grids = {
        "random_forest": ParamGridBuilder().addGrid(forest.numTrees, FOREST_TREES)
        .addGrid(forest.maxDepth, TREE_DEPTHS).addGrid(forest.minInstancesPerNode, LEAST_SPLIT).build(),
        "gradient_boosting": ParamGridBuilder().addGrid(inner.maxIter, BOOST_TREES)
        .addGrid(inner.stepSize, BOOST_RATES).addGrid(inner.maxDepth, BOOST_DEPTHS).build(),
        "decision_tree": ParamGridBuilder().addGrid(tree.maxDepth, TREE_DEPTHS)
        .addGrid(tree.minInstancesPerNode, LEAST_SPLIT).build(),
    }
    if isinstance(boost, OneVsRest):
        grids["gradient_boosting"] = [
            {boost.classifier: inner.copy(p)} for p in grids["gradient_boosting"]]
    if task == "regression":
        grids["linear_regression"] = [{}]
    else:
        logistic = models["logistic_regression"]
        logistic.setMaxIter(1000).setStandardization(False)      # the penalty is on the raw scale
        grids["logistic_regression"] = ParamGridBuilder().addGrid(
            logistic.regParam, [1.0 / (c * max(rows, 1)) for c in LOGISTIC_C]).build()
    return {name: (models[name], grids[name]) for name in grids}


def _settings(params: Mapping) -> dict[str, object]:
    """Names and values of a grid's entry; of a classifier against the rest its own."""
    out: dict[str, object] = {}
    for p, v in params.items():
        out.update({q.name: v.getOrDefault(q) for q in (v.maxIter, v.stepSize, v.maxDepth)} if isinstance(v, GBTClassifier) else {p.name: v})
    return out


def _describe(settings: Mapping[str, object]) -> str:
    return ", ".join(sorted(f"{name}={value}" for name, value in settings.items()))


def _with(estimator: Estimator, settings: Mapping[str, object]) -> Estimator:
    """A copy with the settings; those of one against the rest go to its classifier."""
    out = estimator.copy()
    inner = out.getClassifier().copy() if isinstance(out, OneVsRest) else out
    for name, value in settings.items():
        inner.set(inner.getParam(name), value)
    if hasattr(inner, "cacheNodeIds") and not isinstance(inner, (GBTClassifier, GBTRegressor)):
        inner.set(inner.cacheNodeIds, True)              # deep trees are not sent out again at every level
    return out.setClassifier(inner) if isinstance(out, OneVsRest) else out


#: What one fit answers for at once: the number of trees and, where trees do not build on each other, their depth.
NESTED = {"random_forest": ("numTrees", "maxDepth"), "gradient_boosting": ("maxIter",), "decision_tree": ("maxDepth",)}
DEEPEST = 30


class Family(NamedTuple):
    """Settings of a model that one fit answers for: what is fitted, and each entry of the grid with its (trees, depth) in it."""

    fitted: dict[str, object]
    entries: list[tuple[int, tuple[int, int]]]


def families(name: str, grid: Sequence[Mapping]) -> list[Family]:
    """The entries of a grid by the fits that they need: the largest ensemble of each setting that cannot be read off a larger one."""
    nested = NESTED.get(name, ())
    groups: dict[tuple, list[tuple[int, dict]]] = {}
    for i, entry in enumerate(grid):
        own = _settings(entry)
        groups.setdefault(tuple(sorted((k, v) for k, v in own.items() if k not in nested)), []).append((i, own))
    out = []
    for members in groups.values():
        largest = {k: max(own[k] for _, own in members) for k in members[0][1] if k in nested}
        place = [(i, (own.get("numTrees", own.get("maxIter", 1)), own["maxDepth"] if "maxDepth" in nested else DEEPEST)) for i, own in members]
        out.append(Family({**members[0][1], **largest}, place if nested else [(i, (1, 1)) for i, _ in members]))
    return out


def grid_search(prep: Prepared, names: Sequence[str] | None = None, folds: int = FOLDS, parallelism: int = 4, seed: int = 42) -> DataFrame:
    """``(model, combinations, best_params, cv_score, test_score, error)``: every combination, 3-fold.

    cv_score is accuracy or R2; test_score is the same for classes, and MSE for numbers.

    Folds are drawn as Spark's cross validation does. Numbers of trees and depths of one model are scored from one fit (see
    :mod:`sparkeda.operators.ensembles`), and all fits of all models and folds run in one pool, the longest first. The best setting of
    each model is fitted again on all training rows.

    Forests and boosting of numbers are grown by :mod:`sparkeda.operators.regrowth`, a fit in a task or a few, unless the rows have
    more than ``ENTRIES_AT_ONCE`` numbers; then each fit is Spark's, over all tasks.
    """
    def work(prep: Prepared) -> DataFrame:
        draw = prep.train.withColumn("__draw", F.rand(seed)).persist()
        spaces = search_space(prep.task, prep.classes, draw.count())
        chosen = [n for n in spaces if names is None or n in names]
        accuracy = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="accuracy")
        score = _evaluator(prep.task) if prep.task == "regression" else accuracy
        tested = RegressionEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="mse") if prep.task == "regression" else accuracy

        def fold(name: str, family: Family, k: int) -> list[tuple[int, float]]:
            inside = (F.col("__draw") >= k / folds) & (F.col("__draw") < (k + 1) / folds)
            model = _with(spaces[name][0], family.fitted).fit(draw.filter(~inside))
            held_out = draw.filter(inside)
            if name not in NESTED:
                return [(i, float(score.evaluate(model.transform(held_out)))) for i, _ in family.entries]
            sizes, depths = (sorted({at[j] for _, at in family.entries}) for j in (0, 1))
            found = nested_scores(held_out, ensembles(model, prep.classes), sizes, depths, LABEL, FEATURES)
            return [(i, found[at]) for i, at in family.entries]

        def shared_fit(name: str, family: Family, k: int) -> Fit:
            own, model = family.fitted, spaces[name][0]
            sizes = sorted({size for _, (size, _) in family.entries})
            boosts = name == "gradient_boosting"
            depths = [own["maxDepth"]] if boosts else sorted({depth for _, (_, depth) in family.entries})
            least = model.getMinInstancesPerNode() if boosts else own["minInstancesPerNode"]
            return Fit(k, sizes, depths, least, own["stepSize"] if boosts else None, model.getMaxBins(), model.getSeed(), folds)

        def shared_folds(name: str) -> list[list[float]]:
            jobs = [(family, k) for family in families(name, spaces[name][1]) for k in range(folds)]
            out: list[list[float]] = [[] for _ in spaces[name][1]]
            for (family, k), found in zip(jobs, errors(shared, [shared_fit(name, *job) for job in jobs])):
                for i, (size, depth) in family.entries:
                    n, off = found[size, family.fitted["maxDepth"] if name == "gradient_boosting" else depth]
                    out[i].append(1.0 - off / (n * spread[k]))
            return out

        def final(name: str, best: int) -> float:
            if name in together:
                (family,) = families(name, [spaces[name][1][best]])
                ((n, off),) = errors(shared, [shared_fit(name, family, folds)])[0].values()
                return off / n
            return float(tested.evaluate(_with(spaces[name][0], _settings(spaces[name][1][best])).fit(prep.train).transform(prep.test)))

        cost = list(NESTED)[::-1]                        # boosting takes the most rounds, then forests
        numbered = sum(((F.col("__draw") >= k / folds).cast("int") for k in range(1, folds)), F.lit(0)).alias("fold")
        shared, together, spread = None, (), {}
        if prep.task == "regression" and set(chosen) & set(SHARED_OUT):
            rows_of = [frame.select(fold, F.col(LABEL).cast("double").alias("y"), FEATURES)
                       for frame, fold in ((draw, numbered), (prep.test, F.lit(folds).alias("fold")))]
            shared = blocks(rows_of[0].unionByName(rows_of[1])).persist()
            rows_in, most = shared.agg(F.sum("rows"), F.max("most")).first()
            if (rows_in or 0) * ((most or 0) + 1) <= ENTRIES_AT_ONCE:
                together = tuple(n for n in SHARED_OUT if n in chosen)
                spread = dict(draw.groupBy(numbered).agg(F.var_pop(LABEL)).collect())
        jobs = sorted(((n, f, k) for n in chosen if n not in together for f in families(n, spaces[n][1]) for k in range(folds)),
                      key=lambda job: (job[0] != "gradient_boosting", cost.index(job[0]) if job[0] in cost else len(cost)))
        rows, scores, failed = [], {n: [[] for _ in spaces[n][1]] for n in chosen}, {}
        try:
            with ThreadPoolExecutor(parallelism) as pool:
                grown = {n: pool.submit(shared_folds, n) for n in together}
                for (name, _, _), run in [(job, pool.submit(fold, *job)) for job in jobs]:
                    try:
                        for i, value in run.result():
                            scores[name][i].append(value)
                    except Exception as exc:  # noqa: BLE001 - one failing model must not stop the rest
                        failed[name] = str(exc)[:200]
                for name, run in grown.items():
                    try:
                        scores[name] = run.result()
                    except Exception as exc:  # noqa: BLE001
                        failed[name] = str(exc)[:200]
                mean = {n: [sum(s) / folds for s in scores[n]] for n in chosen if n not in failed}
                best = {n: max(range(len(m)), key=lambda i: m[i]) for n, m in mean.items()}
                last = {n: pool.submit(final, n, i) for n, i in best.items()}
                for name in chosen:
                    grid = spaces[name][1]
                    try:
                        if name in failed:
                            raise RuntimeError(failed[name])
                        rows.append((name, len(grid), _describe(_settings(grid[best[name]])), mean[name][best[name]], last[name].result(), None))
                    except Exception as exc:  # noqa: BLE001
                        rows.append((name, len(grid), None, None, None, str(exc)[:200]))
        finally:
            draw.unpersist()
            if shared is not None:
                shared.unpersist()
        return prep.train.sparkSession.createDataFrame(
            rows, "model string, combinations long, best_params string, cv_score double, test_score double, error string")

    return _held(prep, work)


def auto_tune(prep: Prepared, tries: int = 5, seed: int = 42) -> DataFrame:
    """Random search over forest settings against the untuned forest; the better of the two is reported."""
    def work(prep: Prepared) -> DataFrame:
        forest = candidates(prep.task, prep.classes)["random_forest"]
        space = list(product([20, 50, 100], [5, 10, 15], [1, 2, 4]))
        picked = random.Random(seed).sample(space, tries)
        grid = [{forest.numTrees: t, forest.maxDepth: d, forest.minInstancesPerNode: m} for t, d, m in picked]
        score = _evaluator(prep.task)
        base = float(score.evaluate(forest.fit(prep.train).transform(prep.test)))
        rows = [("untuned", "", base)]
        try:
            tuned = TrainValidationSplit(estimator=forest, estimatorParamMaps=grid, evaluator=score,
                                         trainRatio=0.8, parallelism=4, seed=seed).fit(prep.train)
            best = max(range(tries), key=lambda i: tuned.validationMetrics[i])
            rows.append(("tuned", _describe(_settings(grid[best])), float(score.evaluate(tuned.bestModel.transform(prep.test)))))
        except Exception as exc:  # noqa: BLE001 - the untuned model stays
            rows.append(("tuned", f"failed: {str(exc)[:150]}", None))
        chosen = max((r for r in rows if r[2] is not None), key=lambda r: r[2])[0]
        return prep.train.sparkSession.createDataFrame(
            [(*r, r[0] == chosen) for r in rows], "model string, params string, test_score double, chosen boolean")

    return _held(prep, work)


def learning_curve(
    prep: Prepared, key: str, name: str = "decision_tree", shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 42
) -> DataFrame:
    """``(share, rows, train_score, test_score)`` for nested parts of the training rows, picked by key hash.

    Rows of either side are predicted by all models in one pass. For classes only the counts of equal labels and predictions
    are kept, which weigh the scores.
    """
    prep = dealt(prep)
    score = _evaluator(prep.task).setWeightCol("__n")
    within = sum((drawn(key, share, seed).cast("int") for share in shares), F.lit(0))       # a key drawn for a share is drawn for all larger ones
    train = prep.train.select(LABEL, FEATURES, within.alias("__within")).persist()
    inside = [F.col("__within") >= sum(other >= share for other in shares) for share in shares]

    def counted(frame: DataFrame, models: Sequence[Transformer]) -> DataFrame:
        for i, model in enumerate(models):
            frame = model.transform(frame).select(*frame.columns, F.col("prediction").alias(f"__said_{i}"))
        kept = frame.drop(FEATURES)
        if prep.task == "classification":
            return kept.groupBy(*kept.columns).agg(F.count("*").cast("double").alias("__n"))
        return kept.withColumn("__n", F.lit(1.0))

    try:
        models = [candidates(prep.task, prep.classes)[name].fit(train.where(part)) for part in inside]
        seen, held_out = counted(train, models).persist(), counted(prep.test.select(LABEL, FEATURES), models).persist()
        rows = []
        for i, (share, part) in enumerate(zip(shares, inside)):
            own, said = seen.where(part), score.copy().setPredictionCol(f"__said_{i}")
            rows.append((float(share), int(own.agg(F.sum("__n")).first()[0] or 0), float(said.evaluate(own)), float(said.evaluate(held_out))))
        seen.unpersist()
        held_out.unpersist()
    finally:
        train.unpersist()
    return prep.train.sparkSession.createDataFrame(rows, "share double, rows long, train_score double, test_score double")


def feature_importance(prep: Prepared, model: Transformer) -> DataFrame:
    """``(feature, importance)``, highest first: tree importances, else the mean over classes of |coefficient|."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        weights = abs(model.coefficients.toArray())
    else:
        return empty_like(prep.train, "feature string, importance double")
    rows = [(n, float(w)) for n, w in zip(prep.features, weights)]
    return prep.train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def save_model(prep: Prepared, model: Transformer, path: str) -> str:
    """Write the feature pipeline and the model as one loadable pipeline."""
    PipelineModel(stages=[*prep.pipeline.stages, model]).write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
