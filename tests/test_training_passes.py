"""Training reads its rows no more often than it must, and by as many tasks as their number asks for."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkeda.operators import training


def _prepared(spark, rows: int = 400):
    """Ready rows of a label that the first of two numbers tells, in one partition, and how often a test row is made."""
    made = spark.sparkContext.accumulator(0)

    def count(x: float) -> float:
        made.add(1)
        return x

    base = spark.range(rows, numPartitions=1).select(
        F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias(training.LABEL), (F.col("id") % 7).cast("double").alias("b"))
    a = F.col(training.LABEL) * 3 + F.col("key") % 3
    train = base.select("key", training.LABEL, array_to_vector(F.array(a, "b")).alias(training.FEATURES))
    test = base.select("key", training.LABEL, array_to_vector(F.array(F.udf(count, "double")(a), "b")).alias(training.FEATURES))
    return training.Prepared(train, test, "classification", 2, ["a", "b"], None), made


def test_learning_curve_predicts_test_rows_in_one_pass(spark):
    prep, made = _prepared(spark)
    shares = (0.25, 0.5, 1.0)
    got = {r["share"]: r for r in training.learning_curve(prep, "key", shares=shares).collect()}
    assert made.value == 400                             # one call a test row, not one for each share
    score = training._evaluator("classification")
    for share in shares:
        part = prep.train.where(training.drawn("key", share, 42))
        model = training.candidates("classification", 2)["decision_tree"].fit(part)
        want = (part.count(), score.evaluate(model.transform(part)), score.evaluate(model.transform(prep.test)))
        assert tuple(got[share])[1:] == want
