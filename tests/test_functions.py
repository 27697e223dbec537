"""Order statistics by ranges, the normal distribution and test tails."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions import ordering, sketch, tails
from sparkeda.functions.kinds import kind_of, numeric_columns, round_to, string_columns
from sparkeda.functions.longform import numeric_long, string_long
from sparkeda.functions.normal import inverse_normal, lilliefors_p, normal_cdf, shapiro_wilk

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def by_column(frame):
    return {r["column"]: (r["nn"], list(r["q"])) for r in frame.collect()}


def test_quantiles_by_ranges_equal_built_in(lineitem):
    names = [c for c, t in lineitem.dtypes if t in ("bigint", "int", "double")]
    built_in = lineitem.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, PROBS))).alias(c) for c in names]).first()
    for every in (50, None):
        assert by_column(ordering.exact_quantiles(lineitem, None, PROBS, every)) == {c: (6000, built_in[c]) for c in names}


def test_ranges_follow_the_distinct_values(spark):
    """As many rows of few values make few ranges; a range stays bounded where all values differ."""
    few = spark.range(200_000).select(F.lit("v").alias("column"), (F.col("id") % 100).cast("double").alias("value"))
    many = spark.range(200_000).select(F.lit("v").alias("column"), (F.col("id") / 7).alias("value"))
    for long, most in ((few, 100), (many, 8000)):
        held = ordering.place(long, 1000).groupBy("slot").agg(F.countDistinct("value").alias("k")).agg(F.max("k"), F.count("*")).first()
        assert held[0] <= most
    assert 120 < held[1] < 300


def test_a_long_chain_of_quantiles_stays_small(lineitem):
    plan = ordering.exact_quantiles(lineitem, None, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_quantiles_equal_numpy_with_a_hot_value(spark, parts, monkeypatch):
    monkeypatch.setattr(ordering, "EVERY", 100)
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(0, 3, 2000), np.full(1000, 1.5), [1e18, -1e18]])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(values)],
                               "v double, w double").repartition(parts)
    got = by_column(ordering.exact_quantiles(df, None, PROBS))
    assert got["v"][0] == len(values)
    np.testing.assert_allclose(got["v"][1], np.quantile(values, PROBS), rtol=1e-12)
    held = np.array([float(i) for i in range(len(values)) if i % 3 == 0])
    np.testing.assert_allclose(got["w"][1], np.quantile(held, PROBS), rtol=1e-12)


def test_quantiles_of_nothing(spark, messy):
    empty = messy.limit(0)
    assert ordering.exact_quantiles(empty, None, [0.5]).count() == 0
    got = by_column(ordering.exact_quantiles(messy, ["x", "gone"], [0.5], 2))
    assert got == {"x": (6, [2.0])}


@pytest.mark.parametrize("kind", ["normal", "few", "rounded", "sorted"])
def test_sketch_brackets_hold_every_rank(kind):
    rng = np.random.default_rng(3)
    for most in (2, 7, 40):
        values = {"normal": rng.normal(size=900), "few": rng.integers(0, 30, 900).astype(float),
                  "rounded": np.round(rng.lognormal(0, 2, 900), 1), "sorted": np.arange(900.0)}[kind]
        pieces = [p for p in np.split(values, sorted(rng.integers(0, 900, 6))) if len(p)]
        half = sketch.merged([sketch.sketched(p, most) for p in pieces[:3]], most)
        whole = sketch.merged([half, *(sketch.sketched(p, most) for p in pieces[3:])], 4 * most)
        order = np.sort(values)
        assert whole[1].sum() == 900 and len(whole[0]) <= 4 * most
        for low in range(1, 900):
            a, b = sketch.bracket(whole, low, low + 1)
            assert (a is None or a < order[low - 1]) and order[low] <= b
        upto = np.searchsorted(order, whole[0], side="right") - np.cumsum(whole[1])
        assert (0 <= upto).all() and (upto <= whole[2]).all()


def test_sketch_of_few_values_is_exact_and_of_many_narrow():
    rng = np.random.default_rng(4)
    hot = sketch.sketched(np.concatenate([np.full(10 ** 5, 2.5), np.arange(100.0)]), 128)
    assert hot[2] == 0 and sketch.bracket(hot, 50_000, 50_001) == (2.0, 2.5)
    values = rng.normal(size=1 << 20)
    a, b = sketch.bracket(sketch.merged([sketch.sketched(p, 4096) for p in np.split(values, 4)], 4 * 4096), 1 << 18, (1 << 18) + 1)
    assert ((values > a) & (values <= b)).sum() < len(values) / 1000


@pytest.mark.parametrize("most", [1, 3, 64])
def test_quantiles_through_coarse_sketches(spark, most, monkeypatch):
    """Flushes, merges and wide intervals: many tasks, a tiny buffer, infinities, equal values and a column without a value."""
    monkeypatch.setattr(sketch, "CELLS", 64)
    monkeypatch.setattr(sketch, "ROWS", 16)
    rng = np.random.default_rng(most)
    rows = [(float(rng.choice([math.inf, -math.inf, 0.0, -0.0, 7.0, rng.normal()])), int(rng.integers(0, 9)), None, None if i % 5 else float("nan"))
            for i in range(400)]
    df = spark.createDataFrame(rows, "x double, k int, gone double, nans double").repartition(11)
    got = by_column(ordering.exact_quantiles(df, None, [0.0, 0.03, 0.5, 0.97, 1.0], most))
    assert set(got) == {"x", "k"}
    for at, name in enumerate(("x", "k")):
        order = sorted(r[at] for r in rows)
        for p, q in zip([0.0, 0.03, 0.5, 0.97, 1.0], got[name][1]):
            lo, hi = order[math.floor(p * 399)], order[math.ceil(p * 399)]
            assert q == lo or lo != hi and (math.isnan(q) or lo <= q <= hi)


def test_quantiles_scan_twice(lineitem):
    """The first scan runs when the plan is built; what is left reads the table once."""
    found = ordering.exact_quantiles(lineitem, None, [0.25, 0.5])
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_slots_are_monotone(lineitem):
    long = numeric_long(lineitem, ["l_extendedprice"])
    spans = ordering.place(long, 40).groupBy("slot").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    rows = spans.orderBy("slot").collect()
    assert len(rows) > 100
    assert all(p["b"] < n["a"] for p, n in zip(rows, rows[1:]))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_by_ranges(lineitem, descending):
    counted = numeric_long(lineitem, ["l_quantity", "l_partkey"]).groupBy("column", "value").agg(
        F.count("*").alias("k"), F.sum("value").alias("s"))
    before = W.partitionBy("column").orderBy(F.col("value").desc() if descending else F.col("value")).rowsBetween(W.unboundedPreceding, -1)
    one = counted.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in ("k", "s")})
    cut = ordering.running_totals(counted, ["k", "s"], descending, 40)
    rows = lambda f: sorted((r["column"], r["value"], r["k_before"], round(r["s_before"], 6)) for r in f.collect())
    assert rows(one) == rows(cut)


def test_running_totals_of_text(lineitem):
    counted = string_long(lineitem).groupBy("column", "value").agg(F.count("*").alias("k"))
    cut = ordering.running_totals(counted, ["k"], every=2)
    totals = {}
    for r in sorted(cut.collect(), key=lambda r: (r["column"], r["value"])):
        assert r["k_before"] == totals.get(r["column"], 0)
        totals[r["column"]] = totals.get(r["column"], 0) + r["k"]


def test_inverse_normal(spark):
    ps = [1e-300, 1e-20, 1e-6, 0.01, 0.2, 0.5, 0.6, 0.975, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inverse_normal(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-13, abs=1e-15)


def test_normal_cdf(spark):
    zs = [-9.0, -7.5, -3.0, -1.0, 0.0, 0.5, 1.96, 4.0, 8.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-6, abs=1e-13)


def test_shapiro_published_values():
    # the worked example of Shapiro and Wilk's paper (1965), recomputed by the 1995 algorithm
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float)
    w, p = shapiro_wilk(weights)
    assert w == pytest.approx(0.79, abs=0.005)
    assert p == pytest.approx(0.0067, abs=0.0006)
    assert math.isnan(shapiro_wilk(np.full(10, 3.0))[0])
    normal = np.array([NormalDist().inv_cdf((i + 0.5) / 500) for i in range(500)])
    assert shapiro_wilk(normal)[0] > 0.999


def test_lilliefors_published_values(spark):
    """Critical values of Lilliefors' tables, and Stephens' for large samples; p falls as the distance grows."""
    table = {(20, 0.15): 0.167, (20, 0.05): 0.192, (20, 0.01): 0.223, (30, 0.2): 0.131, (30, 0.05): 0.159, (30, 0.01): 0.185}
    large = {(n, p): x / (n ** 0.5 - 0.01 + 0.85 / n ** 0.5) for n in (100, 1000, 10 ** 6) for p, x in ((0.15, 0.775), (0.1, 0.819), (0.05, 0.895), (0.01, 1.035))}
    rows = [(n, p, d) for (n, p), d in {**table, **large}.items()]
    for r in spark.createDataFrame(rows, "n long, p double, d double").select("*", lilliefors_p(F.col("d"), F.col("n")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], rel=0.12), r
    falling = [r[0] for r in spark.range(1, 400).select(lilliefors_p(F.col("id") / 2000.0, F.lit(500))).collect()]
    assert falling[0] == 1.0 and falling[-1] < 1e-6
    assert all(a >= b - 0.002 for a, b in zip(falling, falling[1:]))
    assert spark.range(1).select(lilliefors_p(F.lit(0.3), F.lit(4))).first()[0] is None


def test_tails_match_tables():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.chi_square_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi_square_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi_square_upper(2.0, 2) == pytest.approx(math.exp(-1), rel=1e-12)
    assert tails.f_upper(4.256, 2, 9) == pytest.approx(0.05, abs=1e-4)


def test_kinds(messy):
    assert numeric_columns(messy) == ["id", "x", "flat", "gone"]
    assert string_columns(messy) == ["cat", "num_text", "tok"]
    assert kind_of(messy.schema["flag"].dataType) == "other"


def test_round_to(spark):
    rows = [(14.285,), (0.125,), (-0.0001,), (2.5,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(round_to(F.col("x"), 2)).collect()]
    assert got == list(np.round([r[0] for r in rows], 2) + 0.0)
    assert math.copysign(1, got[2]) == 1


def test_a_task_that_sketches_holds_few_values(monkeypatch):
    """However many rows a task reads: an executor holds this for each of its cores."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    draw = np.random.default_rng(1)
    batches = (pa.RecordBatch.from_arrays([pa.array(draw.random(10_000)) for _ in range(8)], [f"c{i}" for i in range(8)]) for _ in range(120))
    tracemalloc.start()
    made = list(sketch._task(8, sketch.MOST)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 8 and all(sum(m.column("weights")[0].as_py()) == 1_200_000 for m in made)
    assert peak < 40_000_000
