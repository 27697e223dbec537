"""Operators on small frames with gaps, ties and constants, against pandas and by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkeda.functions import ordering
from sparkeda.operators import adhoc, basics, catalog, categorical, chatlog, features, metrics, plotdata, quality
from sparkeda.operators import relate, series, stats, training
from sparkeda.plans import reports
from sparkeda.sources import files


def table(frame, key="column"):
    return {r[key]: r.asDict() for r in frame.collect()}


# ---- quality ----

def test_missing_counts_nan_and_null(messy):
    got = table(quality.missing_by_column(messy))
    assert {c: r["missing"] for c, r in got.items()} == {
        "gone": 8, "x": 2, "flag": 1, "cat": 1, "num_text": 1, "tok": 1}
    assert got["x"]["missing_pct"] == 25.0


def test_complete_rows_of_an_empty_table(messy):
    row = quality.complete_rows(messy.limit(0)).first()
    assert (row["rows"], row["complete_rows"], row["complete_pct"]) == (0, 0, 0.0)


def test_placeholders_count_both_spellings(messy):
    got = {(r["column"], r["token"]): r["count"] for r in quality.placeholders(messy).collect()}
    assert got == {("tok", "NA"): 1, ("tok", "na"): 1, ("tok", "?"): 1, ("tok", "unknown"): 1, ("tok", "N/A"): 1,
                   ("tok", ""): 1, ("tok", "none"): 1}


def test_nunique_skips_missing(messy):
    got = {c: r["nunique"] for c, r in table(quality.nunique(messy)).items()}
    assert got["x"] == 4 and got["gone"] == 0 and got["flat"] == 1 and got["flag"] == 2 and got["cat"] == 3
    approx = {c: r["nunique"] for c, r in table(quality.nunique(messy, approx=True)).items()}
    assert approx["cat"] == 3


def test_duplicates_match_pandas(spark):
    pdf = pd.DataFrame({"a": [1, 1, 2, 2, 2], "b": ["x", "x", None, None, "y"]})
    df = spark.createDataFrame([(int(a), None if b is None else b) for a, b in pdf.values.tolist()], "a int, b string")
    assert quality.duplicate_count(df).first()[0] == int(pdf.duplicated().sum())
    assert quality.table_overview(df).first()["duplicates"] == 2
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    found = quality.duplicates_by_key(keyed, "k").count()
    assert found == 2


def test_overview_with_nested_columns(spark):
    df = spark.createDataFrame([([1.0], {"a": 1}), ([1.0], {"a": 1})], "v array<double>, m map<string,int>")
    row = quality.table_overview(df).first()
    assert (row["rows"], row["duplicates"], row["other_cols"]) == (2, 1, 2)


def test_impute(messy):
    rows = quality.impute(messy, ["x", "gone"], "median").orderBy("id").collect()
    assert [r["x"] for r in rows] == [1, 2, 2, 4, 100, 2, 2, 2]
    assert all(r["gone"] is None for r in rows)


# ---- statistics ----

def test_describe_matches_pandas(lineitem):
    pdf = lineitem.toPandas()
    got = table(stats.describe_numeric(lineitem))
    want = pdf.select_dtypes(include=[np.number]).describe()
    for c in want.columns:
        for name, key in (("mean", "mean"), ("std", "std"), ("25%", "q25"), ("50%", "q50"), ("75%", "q75"), ("max", "max")):
            assert got[c][key] == pytest.approx(want.loc[name, c], abs=1e-3)


def test_skew_and_kurtosis_match_pandas(events):
    pdf = events.toPandas()
    skew, kurt = table(stats.skewness(events)), table(stats.kurtosis(events))
    for c in ("user_id", "value"):
        assert skew[c]["skewness"] == pytest.approx(pdf[c].skew(), abs=6e-4)
        assert kurt[c]["kurtosis"] == pytest.approx(pdf[c].kurtosis(), abs=6e-4)


@pytest.mark.parametrize("values, skew, kurt", [
    ([], None, None), ([1.0], None, None), ([1.0, 2.0], None, None), ([1.0, 2.0, 4.0], "value", None),
    ([3.0, 3.0, 3.0, 3.0], None, None)])
def test_moments_of_few_values(spark, values, skew, kurt):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = stats.moments(df).collect()
    assert [(r["column"], r["nn"]) for r in rows] == [("v", len(values))]
    assert (rows[0]["skew"] is None) == (skew is None)
    assert (rows[0]["kurt"] is None) == (kurt is None)
    if skew:
        assert rows[0]["skew"] == pytest.approx(pd.Series(values).skew())


def test_outliers_by_hand(messy):
    row = stats.iqr_outliers(messy, ["x", "flat"]).collect()
    assert [(r["column"], r["count"], r["pct"]) for r in row] == [("x", 1, 12.5)]
    assert stats.outlier_rows(messy, "x").first()["id"] == 5
    assert stats.zscore_outliers(messy, ["flat"]).count() == 0
    assert adhoc.outlier_count(messy, "flat").first()["outliers"] == 0


def test_worked_quartile_example(spark):
    # Q1 35, Q3 68, IQR 33 and no outlier
    df = spark.createDataFrame([(float(v),) for v in (20, 35, 50, 68, 80)], "age double")
    b = stats.iqr_bounds(df).first()
    assert (b["q25"], b["q75"]) == (35.0, 68.0)
    assert stats.iqr_outliers(df).count() == 0


def test_correlation_pairwise_and_constant(messy):
    got = {(r["col1"], r["col2"]): r["corr"] for r in relate.correlation_matrix(messy, ["id", "x", "flat"]).collect()}
    pdf = messy.select("id", "x", "flat").toPandas()
    assert got[("id", "x")] == got[("x", "id")] == pytest.approx(pdf["id"].corr(pdf["x"]), abs=6e-4)
    assert got[("id", "flat")] is None and got[("flat", "flat")] is None and got[("x", "x")] == 1.0


def test_correlation_of_any_width_is_one_scan_of_products(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 60)) + rng.normal(size=(400, 1))
    data[:, 7], data[:, 8], data[::2, 9], data[1::2, 10] = 5.1, 1e6 + data[:, 8] / 50, np.nan, np.nan
    data[rng.random(data.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(60)])
    df = spark.createDataFrame(pdf)
    stats_ = relate.pair_stats(df)
    got = {(r["col1"], r["col2"]): (r["n"], r["r"]) for r in stats_.collect()}
    want = pdf.corr()
    assert len(got) == 60 * 59 // 2
    for (a, b), (n, r) in got.items():
        assert n == (pdf[a].notna() & pdf[b].notna()).sum()
        assert (r is None) == (n == 0 or "c7" in (a, b))
        assert r is None or r == pytest.approx(want.loc[a, b], abs=1e-7)
    assert got["c9", "c10"] == (0, None)
    assert relate.pair_stats(df.limit(0)).where("n = 0 AND r IS NULL").count() == 60 * 59 // 2


def test_shapiro_takes_columns_of_fitting_size(spark, lineitem):
    names = set(stats.numeric_columns(lineitem))
    large = {r["column"]: r for r in stats.normality_shapiro(lineitem).collect()}        # 6000 rows each
    assert set(large) == names and {r["method"] for r in large.values()} == {"jarque_bera"}
    moment = {r["column"]: (r["jb"], r["p_value"], r["is_normal"]) for r in stats.normality_moments(lineitem).collect()}
    assert {c: (r["statistic"], r["p_value"], r["is_normal"]) for c, r in large.items()} == moment
    few = stats.normality_shapiro(lineitem.limit(100)).collect()
    assert {r["column"] for r in few if r["method"] == "shapiro_wilk" and r["statistic"] is not None} == names
    odd = spark.createDataFrame([(1.0, None, float(i)) for i in range(9)], "flat double, gone double, v double")
    got = {r["column"]: (r["n"], r["method"], r["p_value"] is None) for r in stats.normality_shapiro(odd).collect()}
    assert got == {"flat": (9, "constant", True), "gone": (0, "too_few", True), "v": (9, "shapiro_wilk", False)}


# ---- series ----

def test_rolling_mean_by_ranges(events):
    # one group holds a third of the rows
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    args = (hot, "user_id", "ts", "event_id", "value", 7)
    one = series.rolling_mean(*args)
    cut = series.rolling_mean(*args, every=20)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, cut.collect()))


def test_rolling_mean_of_one(events):
    out = series.rolling_mean(events, "user_id", "ts", "event_id", "value", 1, every=20)
    assert out.where(F.abs(F.col("rolling") - F.col("value")) > 1e-4).count() == 0
    assert out.count() == events.count()


@pytest.mark.parametrize("unit", ["year", "quarter", "month", "week", "day", "hour", "minute"])
def test_period_numbers_count_up_by_one(spark, unit):
    steps = spark.range(40).select(F.expr(
        f"timestamp_ntz'2019-12-30 00:00:00' + make_interval({{}})".format(
            {"year": "id", "quarter": "0, 3 * id", "month": "0, id", "week": "0, 0, id", "day": "0, 0, 0, id",
             "hour": "0, 0, 0, 0, id", "minute": "0, 0, 0, 0, 0, id"}[unit].replace("id", "cast(id as int)"))).alias("t"))
    period = F.date_trunc(unit, "t").cast("timestamp_ntz")
    numbers = [r[0] for r in steps.select(series._period_number(period, unit)).orderBy("t").collect()]
    assert all(b - a == 1 for a, b in zip(numbers, numbers[1:]))


# ---- categorical ----

def test_dtype_suggestions(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02", "a", "x1", None, "nan"), (" 2.5 ", "2024-01-03", "b", "x2", None, "3")],
        "n string, d string, c string, u string, gone string, nn string")
    got = {c: r["suggestion"] for c, r in table(categorical.dtype_suggestions(df)).items()}
    assert got == {"n": "Convert to numeric", "d": "Convert to datetime", "c": "Convert to category",
                   "u": "Convert to category", "gone": "Convert to numeric", "nn": "Convert to numeric"}


def test_constant_columns(messy):
    assert set(table(categorical.constant_columns(messy))) == {"flat", "gone"}


def test_imbalance_of_a_hot_class(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 5 + [("c",)], "k string")
    row = categorical.class_imbalance(df).first()
    assert (row["imbalance_ratio"], row["distribution"]) == (0.02, "a=50, b=5, c=1")


# ---- plots ----

def test_histogram_matches_numpy(lineitem):
    values = lineitem.select("l_extendedprice").toPandas()["l_extendedprice"].to_numpy()
    counts, edges = np.histogram(values, bins=30)
    rows = plotdata.histogram(lineitem, ["l_extendedprice"]).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    np.testing.assert_allclose([r["lo"] for r in rows], edges[:-1], atol=1e-4)


def test_histogram_sums_to_the_present_values(messy):
    rows = plotdata.histogram(messy).groupBy("column").agg(F.sum("count").alias("n"), F.count("*").alias("b")).collect()
    assert {(r["column"], r["n"], r["b"]) for r in rows} == {("id", 8, 30), ("x", 6, 30), ("flat", 8, 30)}


def test_kde_equals_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 500), rng.lognormal(2, 1.5, 300), [400.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    rows = plotdata.kde(df, digits=15).orderBy("point").collect()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose([r["density"] for r in rows], want, atol=want.max() * 1e-9)
    assert plotdata.kde(df.withColumn("v", F.lit(1.0))).count() == 0


def test_qq_runs_of_a_hot_value(spark, monkeypatch):
    df = spark.createDataFrame([(1.0,)] * 70 + [(float(i),) for i in range(2, 30)], "v double")
    whole = plotdata.qq_points(df).orderBy("rank").collect()
    monkeypatch.setattr(plotdata, "RUN", 16)
    cut = plotdata.qq_points(df).orderBy("rank").collect()
    assert whole == cut and [r["rank"] for r in cut] == list(range(1, 99))


def test_box_of_a_flat_column(messy):
    row = plotdata.box_stats(messy, ["flat"]).first()
    assert (row["whisker_lo"], row["whisker_hi"], row["fliers"]) == (5.0, 5.0, 0)


def test_samples_do_not_depend_on_partitioning(lineitem):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    picks = [basics.sample_rows(lineitem.repartition(p), key, 50).select(*key).collect() for p in (1, 3, 8)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 50
    other = basics.sample_rows(lineitem, key, 50, seed=1).select(*key).collect()
    assert other != picks[0]


# ---- tests and features ----

def test_welch_and_anova_by_hand(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    row = adhoc.t_test(df, "g", "v", "a", "b").first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    assert row["t"] == pytest.approx((2.5 - 6) / math.sqrt(va + vb), abs=1e-4)
    f = adhoc.anova(df, "g", "v").first()
    assert (f["groups"], f["dof_between"], f["dof_within"]) == (2, 1, 7) and 0 < f["p_value"] < 1


def test_chi_square_with_empty_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 4, "p string, q string")
    row = adhoc.chi_square_test(df, "p", "q").first()
    assert (row["n"], row["dof"], row["statistic"]) == (10, 1, 10.0)


def test_one_hot_of_any_width_unless_asked(lineitem):
    parts = lineitem.select(F.col("l_partkey").cast("string").alias("k"))
    assert len(features.one_hot(parts, ["k"]).columns) == parts.distinct().count()
    with pytest.raises(ValueError):
        features.one_hot(lineitem.select(F.col("l_partkey").cast("string").alias("k")), ["k"], most=10)


@pytest.mark.parametrize("every", [3, 1 << 18])
def test_label_encode_by_ranges(lineitem, monkeypatch, every):
    monkeypatch.setattr(ordering, "EVERY", every)
    rows = features.label_encode(lineitem.withColumn("k", F.concat(F.lit("p"), "l_partkey")), "k")
    codes = {r["k"]: r["k_code"] for r in rows.select("k", "k_code").distinct().collect()}
    assert [codes[k] for k in sorted(codes)] == list(range(len(codes)))


def test_scaling_keeps_gaps(messy):
    rows = features.min_max_scale(messy, ["x", "flat"]).orderBy("id").collect()
    assert rows[2]["x_scaled"] is None and rows[4]["x_scaled"] == 1.0 and rows[0]["flat_scaled"] == 0.0


# ---- models ----

@pytest.mark.parametrize("every", [3, 1 << 18])
def test_auc_by_ranges(spark, monkeypatch, every):
    monkeypatch.setattr(ordering, "EVERY", every)
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 40)) / 10) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "y", "s", "1").first()["auc"] == pytest.approx(want, rel=1e-12)
    last = metrics.roc_curve(df, "y", "s", "1").orderBy("threshold").first()
    assert (last["tpr"], last["fpr"]) == (1.0, 1.0)


def test_confusion_cells_sum_to_rows(lineitem):
    pred = lineitem.withColumn("p", F.lit("A"))
    assert metrics.confusion_matrix(pred, "l_returnflag", "p").agg(F.sum("count")).first()[0] == lineitem.count()
    report = table(metrics.classification_report(pred, "l_returnflag", "p"), "class")
    assert report["R"]["precision"] == 0.0 and report["A"]["recall"] == 1.0


@pytest.mark.parametrize("values, kind, task", [
    ("id", "multiclass", "classification"), ("flat", "binary", "classification"), ("cat", "multiclass", "classification")])
def test_detect_task(messy, values, kind, task):
    row = training.detect_task(messy, values).first()
    assert (row["target_type"], row["task"]) == (kind, task)


def test_search_space_is_the_full_grid():
    class_space = {n: len(g) for n, (_, g) in training.search_space("classification", 2, 100).items()}
    assert class_space == {"random_forest": 12, "gradient_boosting": 8, "decision_tree": 6, "logistic_regression": 3}
    many = training.search_space("classification", 3, 100)["gradient_boosting"]
    assert len(many[1]) == 8


def test_three_class_boosting_grid(spark):
    rows = [(i, float(i % 3) + (i % 7) / 50, "abc"[i % 3]) for i in range(120)]
    prep = training.prepare(spark.createDataFrame(rows, "id long, x double, y string"), "y", "id")
    estimator, grid = training.search_space("classification", 3, 100)["gradient_boosting"]
    model = estimator.copy(grid[0]).fit(prep.train)
    assert model.transform(prep.test).where(F.col("prediction") == F.col("__label")).count() > 0


def test_wide_strings_are_hashed(spark):
    rows = [(i, f"user{i}", float(i % 5), i % 2) for i in range(300)]
    prep = training.prepare(spark.createDataFrame(rows, "id long, who string, x double, y int"), "y", "id")
    assert prep.train.count() + prep.test.count() == 300
    assert prep.train.first()["__features"].size > 4000


def test_feature_names(spark):
    rows = [(i, "pq"[i % 2], float(i), i % 2) for i in range(60)]
    prep = training.prepare(spark.createDataFrame(rows, "id long, s string, x double, y int"), "y", "id")
    names = [r["feature"] for r in training.feature_importance(prep, training.train_model(prep, "decision_tree")).collect()]
    assert {"x", "s_p", "s_q"} <= set(names)
    logistic = training.feature_importance(prep, training.train_model(prep, "logistic_regression"))
    assert logistic.first()["importance"] > 0


# ---- search, chat, files, reports ----

def test_search_repeats_and_caps(spark):
    rows = [(f"wine {i}", "red wine data" if i % 2 else None, f"u{i}", "s1" if i < 8 else "s2", "csv", i) for i in range(12)]
    cat = spark.createDataFrame(rows, "title string, description string, url string, source string, type string, stars long")
    hits = catalog.search_all(cat, ["WINE", "red"], 4, ["s2"])
    s1 = [(r["position"], r["url"], r["query_no"]) for r in hits.where("source = 's1'").orderBy("position").collect()]
    assert s1 == [(1, "u7", 0), (2, "u6", 0), (3, "u7", 1), (4, "u5", 1)]
    assert hits.where("source = 's2'").count() == 4
    shown = {r["url"]: r["description"] for r in hits.collect()}
    assert shown["u6"] == "No description" and shown["u7"] == "red wine data..."
    everywhere = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source string")
    assert {r["source"]: r["hits"] for r in catalog.source_counts(hits, everywhere).collect()} == {
        "s1": 4, "s2": 4, "s3": 0, "TOTAL": 8}


def test_query_labels(spark):
    q = spark.createDataFrame([("Finance & Economics",), ("R&D",)], "query string")
    terms = spark.createDataFrame([("r d", "labs", 1), ("rd", "labs", 2), ("rd", "RD", 3)], "term string, related string, weight int")
    got = {(r["query"], r["position"], r["term"]) for r in catalog.expand_query(q, terms).collect()}
    assert got == {("finance economics", 0, "finance economics"), ("rd", 0, "rd"), ("rd", 1, "labs")}


def test_chat_jobs(spark):
    log = spark.createDataFrame([
        (1, 0, "system", "be kind"), (1, 1, "user", "x" * 51), (1, 2, "assistant", "```python\na = 1\n```"),
        (2, 0, "assistant", '{"a": {"b": 1}}'), (2, 1, "user", "Please DRAW it"),
    ], "conv_id long, turn long, role string, text string")
    assert table(chatlog.session_titles(log), "conv_id")[1]["title"] == "x" * 50 + "..."
    assert table(chatlog.recent_context(log), "conv_id")[2]["context"].endswith("\nuser: Please DRAW it...")
    assert [r["code"] for r in chatlog.extract_code_blocks(log).collect()] == ["a = 1"]
    assert [r["payload"] for r in chatlog.extract_json_payloads(log).collect()] == ['{"a": {"b": 1}}']
    routed = table(chatlog.route_requests(log), "conv_id")
    assert routed[2]["needs_visualization"] and not routed[2]["needs_visualization_short"]


def test_read_table_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'a,b,c,d,e,f\n1,1.5,True,NA,x,2024\n2,NaN,False,,"y, z",N/A\nnull,3,,null,n/a,2e3\n')
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "double", "string", "double"]
    assert [r["e"] for r in df.collect()] == ["x", "y, z", None]
    want = pd.read_csv(tmp_path / "t.csv")
    assert df.toPandas().isna().sum().sum() == want.isna().sum().sum()


def test_text_preview_and_manifest(spark, tmp_path):
    (tmp_path / "long.txt").write_text("ab" * 600)
    (tmp_path / "short.TXT").write_text("hello\nyou")
    (tmp_path / "pic.JPEG").write_bytes(b"\x00\x01")
    got = {r["path"].rsplit("/", 1)[1]: r["preview"] for r in files.read_text_preview(spark, str(tmp_path / "*.*[tT]")).collect()}
    assert got["long.txt"] == "ab" * 500 + "..." and got["short.TXT"] == "hello\nyou"
    kinds = {r["name"]: r["kind"] for r in files.file_manifest(spark, str(tmp_path)).collect()}
    assert kinds == {"long.txt": "text", "short.TXT": "text", "pic.JPEG": "image"}


def test_deep_eda_has_all_sections(lineitem):
    rows = reports.deep_eda(lineitem).collect()
    assert {r["section"] for r in rows} == {"overview", "cleaning", "summary", "insights"}


def test_reports_on_messy_and_empty_tables(messy):
    for df in (messy, messy.limit(0), messy.select("cat"), messy.select("id", "x")):
        assert reports.deep_eda(df).count() > 0
        results, status = reports.enterprise_eda(df)
        assert [r["status"] for r in status.orderBy("priority").collect()] == ["ok"] * 7
        assert reports.column_report(df).count() > 0
        assert reports.profile_context(df).count() > 0
        assert reports.data_report(df).count() > 0


def test_registered_grid_searches_take_every_model(spark, monkeypatch):
    from sparkeda.operators import training
    from workload import w_models

    taken = []
    monkeypatch.setattr(training, "prepare", lambda *a: None)
    monkeypatch.setattr(training, "grid_search", lambda p, names=None, **other: taken.append(names))
    for name in ("grid_search", "grid_search_regression"):
        w_models.R.queries[name](spark, "/root/testdata/sf0.001")
    assert taken == [None, None]
