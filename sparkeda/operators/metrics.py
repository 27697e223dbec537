"""Model metrics as aggregates over a prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import quoted, round_to
from sparkeda.functions.ordering import running_totals


def _cells(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, count)``: at most classes x classes rows."""
    return pred.groupBy(
        quoted(label).cast("string").alias("label"), quoted(prediction).cast("string").alias("prediction"),
    ).agg(F.count("*").alias("count")).where("label IS NOT NULL AND prediction IS NOT NULL")


def confusion_matrix(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, count)`` of the cells that occur."""
    return _cells(pred, label, prediction)


def _per_class(cells: DataFrame) -> DataFrame:
    """``(class, tp, predicted, support, precision, recall, f1)``; undefined ratios are 0."""
    none = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(none)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), none.alias("predicted"),
                 hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), none.alias("support"), F.col("count").alias("predicted"),
                 none.alias("tp")),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        cells.select(F.inline(sides))
        .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
        .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def classification_report(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class, then macro and weighted means."""
    per = _per_class(_cells(pred, label, prediction))
    scores = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per.agg(*[F.try_divide(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in scores],
                       F.sum("support").alias("support"))
    out = per.select("class", *scores, "support")
    for name, frame in (("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(frame.withColumn("class", F.lit(name)))
    return out.select("class", *[round_to(F.col(s), 4).alias(s) for s in scores], "support")


def _by_score(pred: DataFrame, label: str, score: str, positive: Column) -> DataFrame:
    """``(column, value, pos, neg)``: positives and negatives per distinct score."""
    return (
        pred.select(F.lit("score").alias("column"), quoted(score).cast("double").alias("value"),
                    (quoted(label).cast("string") == positive).alias("hit"))
        .where("value IS NOT NULL AND hit IS NOT NULL").groupBy("column", "value")
        .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )


def roc_auc(pred: DataFrame, label: str, score: str, positive: str) -> DataFrame:
    """One row ``auc``: chance that a positive outscores a negative, ties counting half."""
    groups = running_totals(_by_score(pred, label, score, F.lit(positive)), ["neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return groups.agg(F.try_divide(won, pairs).alias("auc"))


def roc_curve(pred: DataFrame, label: str, score: str, positive: str, digits: int = 6) -> DataFrame:
    """``(threshold, tpr, fpr)``: rates when scores at or above the threshold count as positive."""
    groups = running_totals(
        _by_score(pred, label, score, F.lit(positive)), ["pos", "neg"], descending=True)
    whole = _by_score(pred, label, score, F.lit(positive)).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.struct("*")).scalar()
    return groups.select(
        F.col("value").alias("threshold"),
        round_to(F.try_divide(F.col("pos_before") + F.col("pos"), whole["p"]), digits).alias("tpr"),
        round_to(F.try_divide(F.col("neg_before") + F.col("neg"), whole["n"]), digits).alias("fpr"))


def classification_metrics(
    pred: DataFrame, label: str, prediction: str, score: str | None = None, positive: str = "1"
) -> DataFrame:
    """One row: accuracy, then precision, recall, f1 and ROC-AUC of the positive class."""
    cells = _cells(pred, label, prediction)
    is_pos, said_pos = F.col("label") == positive, F.col("prediction") == positive
    part = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).cast("double")
    sums = cells.agg(
        part(F.col("label") == F.col("prediction")).alias("ok"), F.sum("count").alias("n"),
        part(is_pos & said_pos).alias("tp"), part(is_pos).alias("p"), part(said_pos).alias("q"))
    ratio = lambda a, b: round_to(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    auc = roc_auc(pred, label, score, positive).scalar() if score else F.lit(None).cast("double")
    return sums.select(
        "n", ratio(F.col("ok"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("q")).alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"), ratio(2 * F.col("tp"), F.col("p") + F.col("q")).alias("f1"),
        round_to(auc, 6).alias("roc_auc"))


def residuals(pred: DataFrame, y: str, prediction: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus ``prediction`` and ``residual`` = y - prediction for each row."""
    return pred.select(
        *[quoted(c) for c in keep], quoted(prediction).cast("double").alias("prediction"),
        (quoted(y).cast("double") - quoted(prediction).cast("double")).alias("residual"))


def regression_metrics(pred: DataFrame, y: str, prediction: str) -> DataFrame:
    """One row ``(n, r2, mae, mse, rmse)``."""
    a, b = quoted(y).cast("double"), quoted(prediction).cast("double")
    sums = pred.where(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n"), F.avg((a - b) * (a - b)).alias("mse"), F.avg(F.abs(a - b)).alias("mae"),
        F.var_pop(a).alias("spread"))
    return sums.select(
        "n", round_to(1 - F.try_divide(F.col("mse"), F.col("spread")), 6).alias("r2"),
        round_to(F.col("mae"), 3).alias("mae"), round_to(F.col("mse"), 1).alias("mse"),
        round_to(F.sqrt("mse"), 3).alias("rmse"))


def prediction_error(pred: DataFrame, y: str, prediction: str) -> DataFrame:
    """One row ``(n, slope, intercept, r2)``: the line of prediction on actual."""
    a, b = quoted(y).cast("double"), quoted(prediction).cast("double")
    fit = pred.where(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    slope = F.try_divide(F.col("c"), F.col("va"))
    return fit.select(
        "n", round_to(slope, 6).alias("slope"), round_to(F.col("mb") - slope * F.col("ma"), 3).alias("intercept"),
        round_to(F.try_divide(F.col("c") * F.col("c"), F.col("va") * F.col("vb")), 6).alias("r2"))
