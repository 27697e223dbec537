"""Model metric queries (checked in SQL) and training queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.operators import metrics, training
from workload.common import Registry, big, load, on, rnd, source

R = Registry()

R.add("detect_task", on("orders", lambda df: training.detect_task(df, "o_totalprice").unionByName(
          training.detect_task(df, "o_orderstatus"))), """
    SELECT 'o_totalprice' AS target, CASE WHEN max(o_totalprice <> floor(o_totalprice)) THEN 'continuous' END AS target_type,
      'regression' AS task, count(DISTINCT o_totalprice) AS classes FROM orders
    UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) > 2 THEN 'multiclass' ELSE 'binary' END,
      'classification', count(DISTINCT o_orderstatus) FROM orders""")

PRED = source("lineitem_pred")
R.add("confusion_matrix", on("lineitem_pred", lambda df: metrics.confusion_matrix(df, "flag", "flag_pred")),
      f"SELECT flag AS label, flag_pred AS prediction, count(*) AS count FROM {PRED} GROUP BY 1, 2")
_per = f"""SELECT c AS class, count(*) FILTER (WHERE flag = c AND flag_pred = c) AS tp,
    count(*) FILTER (WHERE flag = c) AS support, count(*) FILTER (WHERE flag_pred = c) AS q
    FROM {PRED}, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY 1"""
_scored = f"""SELECT class, coalesce(tp / nullif(q, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
    coalesce(2 * tp / nullif(q + support, 0), 0) AS f, support FROM ({_per})"""
R.add("classification_report", on("lineitem_pred", lambda df: metrics.classification_report(df, "flag", "flag_pred")), f"""
    WITH s AS ({_scored}) SELECT class, {rnd('p', 4)} AS precision, {rnd('r', 4)} AS recall, {rnd('f', 4)} AS f1, support FROM s
    UNION ALL SELECT 'macro avg', {rnd('avg(p)', 4)}, {rnd('avg(r)', 4)}, {rnd('avg(f)', 4)}, {big('sum(support)')} FROM s
    UNION ALL SELECT 'weighted avg', {rnd('sum(p * support) / sum(support)', 4)}, {rnd('sum(r * support) / sum(support)', 4)},
      {rnd('sum(f * support) / sum(support)', 4)}, {big('sum(support)')} FROM s""")
_auc = f"""SELECT (sum(rk) FILTER (WHERE label = '1') - np * (np + 1) / 2) / (np * (n - np)) AS auc FROM (
    SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk,
      CAST(count(*) FILTER (WHERE label = '1') OVER () AS DOUBLE) AS np, CAST(count(*) OVER () AS DOUBLE) AS n FROM {PRED})
    GROUP BY np, n"""
R.add("classification_metrics", on("lineitem_pred", lambda df: metrics.classification_metrics(
          df, "label", "prediction", "score")), f"""
    SELECT count(*) AS n, {rnd('count(*) FILTER (WHERE label = prediction) / count(*)', 4)} AS accuracy,
      {rnd("count(*) FILTER (WHERE label = '1' AND prediction = '1') / count(*) FILTER (WHERE prediction = '1')", 4)} AS precision,
      {rnd("count(*) FILTER (WHERE label = '1' AND prediction = '1') / count(*) FILTER (WHERE label = '1')", 4)} AS recall,
      {rnd("2 * count(*) FILTER (WHERE label = '1' AND prediction = '1') / "
           "(count(*) FILTER (WHERE label = '1') + count(*) FILTER (WHERE prediction = '1'))", 4)} AS f1,
      {rnd(f'({_auc})', 6)} AS roc_auc FROM {PRED}""")
R.add("roc_curve", on("lineitem_pred", lambda df: metrics.roc_curve(df, "label", "score", "1")), f"""
    SELECT score AS threshold, {rnd("CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER ()", 6)} AS tpr,
      {rnd("CAST(sum(q) OVER w AS DOUBLE) / sum(q) OVER ()", 6)} AS fpr FROM (
      SELECT score, count(*) FILTER (WHERE label = '1') AS p, count(*) FILTER (WHERE label <> '1') AS q FROM {PRED} GROUP BY 1)
    WINDOW w AS (ORDER BY score DESC)""")
REG = source("orders_pred")
R.add("regression_metrics", on("orders_pred", lambda df: metrics.regression_metrics(df, "y", "prediction")), f"""
    SELECT count(*) AS n, {rnd('1 - avg(pow(y - prediction, 2)) / var_pop(y)', 6)} AS r2, {rnd('avg(abs(y - prediction))', 3)} AS mae,
      {rnd('avg(pow(y - prediction, 2))', 1)} AS mse, {rnd('sqrt(avg(pow(y - prediction, 2)))', 3)} AS rmse FROM {REG}""")
R.add("residuals", on("orders_pred", lambda df: metrics.residuals(df, "y", "prediction", ("o_orderkey",))),
      f"SELECT o_orderkey, prediction, y - prediction AS residual FROM {REG}")
R.add("prediction_error", on("orders_pred", lambda df: metrics.prediction_error(df, "y", "prediction")), f"""
    SELECT count(*) AS n, {rnd('regr_slope(prediction, y)', 6)} AS slope, {rnd('regr_intercept(prediction, y)', 3)} AS intercept,
      {rnd('regr_r2(prediction, y)', 6)} AS r2 FROM {REG}""")


# ---- training: predict a label of the given tables; the fitted numbers have no SQL twin ----

def status_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line status and the columns that may tell it."""
    return load(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_key"), "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", F.unix_date(F.col("l_shipdate").cast("date")).alias("ship_day"), "l_linestatus")


def price_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


def quality_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents; the join is an equi-join on the document key."""
    docs = load(spark, d, "documents").select(
        "doc_id", "lang", "n_chars", F.size(F.split("text", r"\s+")).alias("words"),
        F.size(F.split("text", "\n")).alias("lines"))
    return load(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")


def trained(rows, target: str, key: str, work, task: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return work(training.prepare(rows(spark, d), target, key, task))
    return run


quality = partial(trained, quality_rows, "quality", "doc_id")
price = partial(trained, price_rows, "p_retailprice", "p_partkey")
status = partial(trained, status_rows, "l_linestatus", "row_key")

_split = f"CASE WHEN substring(md5(concat_ws('|', o_orderkey, '123')), 1, 8) < '{int(0.2 * 16 ** 8):08x}' THEN 'test' ELSE 'train' END"
R.add("train_test_split", on("orders", lambda df: training.train_test_split(df, "o_orderkey", seed=123)),
      f"SELECT *, {_split} AS split FROM orders")
R.add("split_counts", on("orders", lambda df: training.split_counts(df, "o_orderkey", seed=123)),
      f"SELECT {_split} AS split, count(*) AS rows FROM orders GROUP BY 1")
SLOTS = 9       # three numbers, four languages, one slot for an unknown language and one for an invalid code


def _features(spark: SparkSession, d: str) -> DataFrame:
    ready = training.prepare_features(quality_rows(spark, d), "quality", "doc_id")
    return ready.select("doc_id", "split", "label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(SLOTS)])


R.add("prepare_features", _features, f"""
    WITH t AS (SELECT doc_id, quality, lang, n_chars, len(regexp_split_to_array(text, '\\s+')) AS words,
        len(string_split(text, chr(10))) AS lines FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT *, CASE WHEN substring(md5(concat_ws('|', doc_id, '123')), 1, 8) < '{int(0.2 * 16 ** 8):08x}'
        THEN 'test' ELSE 'train' END AS split FROM t),
    k AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS code FROM s WHERE split = 'train' GROUP BY lang)
    SELECT doc_id, split, CAST(quality AS DOUBLE) AS label,
      CAST(n_chars AS DOUBLE) AS f0, CAST(words AS DOUBLE) AS f1, CAST(lines AS DOUBLE) AS f2,
      {', '.join(f'CASE WHEN code = {i - 3} THEN 1.0::DOUBLE ELSE 0 END AS f{i}' for i in range(3, SLOTS))}
    FROM s JOIN k ON s.lang = k.lang""")
R.add("train_model", status(lambda p: training.predictions(p, training.train_model(p), ["row_key"])))
R.add("leaderboard", quality(training.leaderboard))
R.add("leaderboard_regression", price(training.leaderboard))
R.add("fallback_model", status(training.fallback_model))
R.add("grid_search", quality(lambda p: training.grid_search(p, parallelism=8)))
R.add("grid_search_regression", price(lambda p: training.grid_search(p, parallelism=8)))
R.add("auto_tune", quality(training.auto_tune))
R.add("learning_curve", status(lambda p: training.learning_curve(p, "row_key")))
R.add("feature_importance", quality(lambda p: training.feature_importance(p, training.train_model(p))))


def _saved(p: training.Prepared) -> DataFrame:
    from sparkeda.sources.files import new_path

    model = training.train_model(p, "decision_tree")
    path = training.save_model(p, model, new_path(p.train.sparkSession, "model"))
    again = training.load_model(path).stages[-1]
    return training.predictions(p, again, ["doc_id"])


R.add("save_model", quality(_saved))
