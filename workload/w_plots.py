"""Plot data queries."""

from __future__ import annotations

from itertools import combinations

from sparkeda.functions import normal
from sparkeda.operators import plotdata as plot
from sparkeda.operators import stats
from workload.common import (
    EVENTS_NUMBERS, LINEITEM, LINEITEM_NUMBERS, Registry, big, long_sql, on, rnd, source, union,
)
from workload.w_categorical import CORR, PART_TEXTS, top_sql, totals
from workload.w_stats import corr_sql, matrix_sql

R = Registry()


def histogram_sql(table: str, cols: list[str], bins: int = 30) -> str:
    return f"""
    WITH l AS ({long_sql(table, cols)}),
    m AS (SELECT "column", min(value) AS a, max(value) AS b FROM l GROUP BY 1),
    e AS (SELECT "column", CASE WHEN a = b THEN a - 0.5 ELSE a END AS f, CASE WHEN a = b THEN b + 0.5 ELSE b END AS t
          FROM m),
    s AS (SELECT *, (t - f) / {bins}.0::DOUBLE AS step FROM e),
    g AS (SELECT l."column", value, f, t, step,
            least(CAST(floor((value - f) / (t - f) * {bins}.0::DOUBLE) AS BIGINT), {bins - 1}) AS i
          FROM l JOIN s ON l."column" = s."column"),
    c AS (SELECT "column", i - (CASE WHEN value < f + i * step THEN 1 ELSE 0 END)
            + (CASE WHEN i < {bins - 1} AND value >= f + (i + 1) * step THEN 1 ELSE 0 END) AS bin, count(*) AS k
          FROM g GROUP BY 1, 2),
    grid AS (SELECT s.*, CAST(bin AS BIGINT) AS bin FROM s, range({bins}) r(bin))
    SELECT grid."column", grid.bin, {rnd('f + grid.bin * step', 4)} AS lo,
      {rnd(f'CASE WHEN grid.bin = {bins - 1} THEN t ELSE f + (grid.bin + 1) * step END', 4)} AS hi,
      coalesce(k, 0) AS count
    FROM grid LEFT JOIN c ON grid."column" = c."column" AND grid.bin = c.bin"""


def kde_sql(table: str, cols: list[str], points: int, cut: float, digits: int = 8) -> str:
    """The plain sum over rows at every grid point; equal values are weighted, which changes nothing."""
    return f"""
    WITH l AS ({long_sql(table, cols)}),
    s AS (SELECT "column", count(*) AS n, min(value) AS a, max(value) AS b,
            stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw FROM l GROUP BY 1),
    g AS (SELECT s.*, CAST(i AS BIGINT) AS point,
            a - {cut} * bw + i * ((b + {cut} * bw - (a - {cut} * bw)) / {points - 1}.0) AS x FROM s, range({points}) r(i)),
    w AS (SELECT "column", value, count(*) AS k FROM l GROUP BY 1, 2)
    SELECT g."column", point, {rnd('any_value(x)', 4)} AS x,
      {rnd('sum(k * exp(-0.5 * pow((x - value) / bw, 2))) / any_value(n * bw * sqrt(2 * pi()))', digits)} AS density
    FROM g JOIN w ON g."column" = w."column" GROUP BY 1, 2"""


def box_sql(table: str, cols: list[str]) -> str:
    def one(c: str) -> str:
        return f"""(WITH b AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
            quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
            FROM {source(table)}),
          x AS (SELECT CAST({c} AS DOUBLE) AS v, q1, q2, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
                FROM {source(table)}, b WHERE {c} IS NOT NULL)
          SELECT '{c}' AS "column", {rnd('any_value(q1)', 4)} AS q25, {rnd('any_value(q2)', 4)} AS q50,
            {rnd('any_value(q3)', 4)} AS q75,
            {rnd('least(min(v) FILTER (WHERE v BETWEEN lo AND hi), any_value(q1))', 4)} AS whisker_lo,
            {rnd('greatest(max(v) FILTER (WHERE v BETWEEN lo AND hi), any_value(q3))', 4)} AS whisker_hi,
            count(*) FILTER (WHERE v < lo OR v > hi) AS fliers FROM x)"""
    return union([one(c) for c in cols])


def _horner(x: str, highest_first: list[float]) -> str:
    out = repr(highest_first[0]) + "::DOUBLE"
    for c in highest_first[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def inverse_normal_sql(p: str) -> str:
    """Normal quantile of the column ``p``; ``rr`` is the square root of -ln(min(p, 1 - p))."""
    def ratio(x: str, num: list[float], den: list[float]) -> str:
        return f"{_horner(x, num[::-1])} / {_horner(x, den[::-1])}"

    near = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    rr = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(near, normal.CENTRE_NUM, normal.CENTRE_DEN)}
        WHEN {rr} <= 5 THEN sign({p} - 0.5) * {ratio(f'({rr} - 1.6)', normal.MIDDLE_NUM, normal.MIDDLE_DEN)}
        ELSE sign({p} - 0.5) * {ratio(f'({rr} - 5.0)', normal.TAIL_NUM, normal.TAIL_DEN)} END"""


def qq_sql(table: str, cols: list[str]) -> str:
    return f"""SELECT "column", rank, {inverse_normal_sql('p')} AS theoretical, value FROM (
      SELECT *, CASE WHEN n = 1 THEN 0.5::DOUBLE WHEN rank = 1 THEN 1 - pow(0.5::DOUBLE, 1.0 / n)
        WHEN rank = n THEN 1 - (1 - pow(0.5::DOUBLE, 1.0 / n))
        ELSE (rank - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM (
        SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank,
          CAST(count(*) OVER (PARTITION BY "column") AS DOUBLE) AS n FROM ({long_sql(table, cols)})))"""


R.add("histogram", on("lineitem_nulls", plot.histogram), histogram_sql("lineitem_nulls", LINEITEM_NUMBERS))
R.add("histogram_constant", on("lineitem_const", lambda df: plot.histogram(df, ["l_tax", "one"])),
      histogram_sql("lineitem_const", ["l_tax", "one"]))
R.add("kde", on("lineitem_nulls", plot.kde),
      kde_sql("lineitem_nulls", LINEITEM_NUMBERS, 200, 3.0))
R.add("kde_events", on("events", lambda df: plot.kde(df, ["value"])), kde_sql("events", ["value"], 200, 3.0))
R.add("box_stats", on("events", plot.box_stats), box_sql("events", EVENTS_NUMBERS))
R.add("violin", on("events", lambda df: plot.violin(df, ["user_id", "value"])), f"""
    SELECT k.*, q25, q50, q75 FROM ({kde_sql('events', ['user_id', 'value'], 100, 2.0)}) k
    JOIN ({box_sql('events', ['user_id', 'value'])}) b ON k."column" = b."column" """)


def _rounded_qq(df):
    from pyspark.sql import functions as F

    from sparkeda.functions.kinds import round_to
    return plot.qq_points(df, ["c_acctbal"]).withColumn("theoretical", round_to(F.col("theoretical"), 8))


R.add("qq_points", on("customer", _rounded_qq),
      f"SELECT \"column\", rank, {rnd('theoretical', 8)} AS theoretical, value FROM ({qq_sql('customer', ['c_acctbal'])})")
R.add("qq_line", on("events", plot.qq_line), f"""
    SELECT "column", count(*) AS n, {rnd('regr_slope(value, theoretical)', 4)} AS slope,
      {rnd('regr_intercept(value, theoretical)', 4)} AS intercept, {rnd('corr(value, theoretical)', 6)} AS r
    FROM ({qq_sql('events', EVENTS_NUMBERS)}) GROUP BY 1""")


def ks_sql(table: str, cols: list[str]) -> str:
    z, t = "abs(z)", normal.LILLIEFORS_TAIL
    tail = f"{t[0]} * e * e * (m + {t[1]}) + {t[2]} * e * sqrt(m + {t[1]}) + {t[3]} + {t[4]} / sqrt(m) + {t[5]} / m"
    hart = f"exp(-z * z / 2) * {_horner(z, normal.HART_NUM)} / {_horner(z, normal.HART_DEN)}"
    deep = f"exp(-z * z / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 0.65)))) / sqrt(2 * pi())"
    return f"""
    WITH l AS ({long_sql(table, cols)}),
    m AS (SELECT "column", count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM l GROUP BY 1),
    c AS (SELECT "column", value, count(*) AS k FROM l GROUP BY 1, 2),
    r AS (SELECT c.*, n, (value - mean) / sd AS z,
            sum(k) OVER (PARTITION BY c."column" ORDER BY value) AS upto FROM c JOIN m ON c."column" = m."column"),
    t AS (SELECT *, CASE WHEN abs(z) > 7 THEN {deep} ELSE {hart} END AS tail FROM r),
    p AS (SELECT *, CASE WHEN z > 0 THEN 1 - tail ELSE tail END AS cdf FROM t),
    d AS (SELECT "column", any_value(n) AS n,
            max(greatest(abs(cdf - CAST(upto - k AS DOUBLE) / n), abs(CAST(upto AS DOUBLE) / n - cdf))) AS d
          FROM p GROUP BY 1),
    s AS (SELECT *, (sqrt(n) - 0.01 + 0.85 / sqrt(n)) * d AS x, least(n, 100)::DOUBLE AS m FROM d),
    w AS (SELECT *, x / (sqrt(m) - 0.01 + 0.85 / sqrt(m)) AS e FROM s),
    q AS (SELECT *, exp({tail}) AS tail FROM w),
    v AS (SELECT *, least(1.0, CASE WHEN tail <= 0.1 OR x > 0.9 THEN tail WHEN x <= 0.302 THEN 1.0
            WHEN x <= 0.5 THEN {_horner('x', normal.LILLIEFORS_LOW[::-1])} ELSE {_horner('x', normal.LILLIEFORS_HIGH[::-1])} END)::DOUBLE AS p FROM q)
    SELECT "column", n, {rnd('d', 5)} AS d, {rnd('sqrt(CAST(n AS DOUBLE)) * d', 3)} AS scaled_d, {rnd('p', 4)} AS p_value, p > 0.05 AS is_normal
    FROM v"""




def shapiro_sql(table: str, cols: list[str]) -> str:
    """W and its p-value for columns of 8 to 5000 values."""
    def poly(x: str, highest_first: list[float]) -> str:
        return _horner(x, highest_first)

    u, ln = "(1 / sqrt(n))", "ln(n)"
    y = f"CASE WHEN n <= 11 THEN -ln({poly('n', normal.SMALL_SHIFT)} - ln(1 - w)) ELSE ln(1 - w) END"
    z = f"(({y} - zm) / zs)"
    hart = f"exp(-{z} * {z} / 2) * {_horner(f'abs({z})', normal.HART_NUM)} / {_horner(f'abs({z})', normal.HART_DEN)}"
    return f"""
    WITH l AS ({long_sql(table, cols)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS i,
            CAST(count(*) OVER (PARTITION BY "column") AS DOUBLE) AS n, avg(value) OVER (PARTITION BY "column") AS mean FROM l),
    p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r WHERE n BETWEEN 8 AND 5000),
    m AS (SELECT *, {inverse_normal_sql('p')} AS m FROM p),
    s AS (SELECT "column", sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2 FROM m GROUP BY 1),
    a AS (SELECT m.*, mm, m1, m2, {poly(u, normal.OUTER_WEIGHT)} + m1 / sqrt(mm) AS a1,
            {poly(u, normal.NEXT_WEIGHT)} + m2 / sqrt(mm) AS a2 FROM m JOIN s ON m."column" = s."column"),
    c AS (SELECT *, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2
            ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM a),
    w AS (SELECT "column", any_value(n) AS n, pow(sum(a * (value - mean)), 2) / sum(pow(value - mean, 2)) AS w
          FROM c GROUP BY 1),
    t AS (SELECT *, CASE WHEN n <= 11 THEN {poly('n', normal.SMALL_MEAN)} ELSE {poly(ln, normal.LARGE_MEAN)} END AS zm,
            exp(CASE WHEN n <= 11 THEN {poly('n', normal.SMALL_LOG_SD)} ELSE {poly(ln, normal.LARGE_LOG_SD)} END) AS zs
          FROM w),
    q AS (SELECT *, CASE WHEN {z} > 0 THEN {hart} ELSE 1 - {hart} END AS p FROM t)
    SELECT "column", CAST(n AS BIGINT) AS n, 'shapiro_wilk' AS method, round(w, 4) AS statistic, round(p, 6) AS p_value,
      p > 0.05 AS is_normal FROM q"""


R.add("normality_shapiro", on("supplier", stats.normality_shapiro),
      shapiro_sql("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]))
R.add("normality_ks", on("events", stats.normality_ks), ks_sql("events", EVENTS_NUMBERS))
R.add("bar_counts", on("part", plot.bar_counts), top_sql("part", PART_TEXTS, 15))
R.add("pie_shares", on("lineitem", plot.pie_shares), f"""
    SELECT "column", value, k AS count, {rnd('k * 100.0::DOUBLE / n', 1)} AS share_pct FROM (
      SELECT *, count(*) OVER w AS classes, sum(k) OVER w AS n FROM ({totals('lineitem', ['l_returnflag', 'l_linestatus'])})
      WINDOW w AS (PARTITION BY "column")) WHERE classes <= 8""")
R.add("corr_heatmap", on("lineitem", plot.corr_heatmap), matrix_sql("lineitem", LINEITEM_NUMBERS, 2))
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ALL_PAIRS = list(combinations(CORR, 2))
_CELLS = union([f"""SELECT '{a}' AS col1, '{b}' AS col2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, {', '.join(_KEY)}
    FROM {source('lineitem_corr')}""" for a, b in _ALL_PAIRS])
R.add("scatter_sample", on("lineitem_corr", lambda df: plot.scatter_sample(df, _KEY)), f"""
    WITH top AS (SELECT col1, col2 FROM ({union([corr_sql('lineitem_corr', a, b) for a, b in _ALL_PAIRS])})
      WHERE r IS NOT NULL ORDER BY abs(r) DESC, col1, col2 LIMIT 3),
    c AS ({_CELLS})
    SELECT col1, col2, x, y FROM c JOIN top USING (col1, col2)
    QUALIFY row_number() OVER (PARTITION BY col1, col2
      ORDER BY md5(concat_ws('|', {', '.join(_KEY)}, '42')), {', '.join(_KEY)}, x, y) <= 2000""")
R.add("pairplot_sample", on("customer", lambda df: plot.pairplot_sample(df, "c_custkey")), """
    SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY md5(concat_ws('|', c_custkey, '42')), c_custkey LIMIT 500""")
R.add("stacked_bar", on("lineitem", lambda df: plot.stacked_bar(df, "l_returnflag", "l_linestatus")),
      "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
_KIND = {"l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "d"}
R.add("plot_advice", on("lineitem_corr", plot.plot_advice), union([
    *[f"""SELECT {big('1' if _KIND.get(c) == 'd' else '4' if _KIND.get(c) == 't' else '3')} AS priority, '{c}' AS "column",
        CAST(NULL AS VARCHAR) AS with_column, {
        f"CASE WHEN count(DISTINCT {c}) >= 0 THEN 'line' END" if _KIND.get(c) == 'd' else
        f"CASE WHEN count(DISTINCT {c}) <= 8 THEN 'pie' WHEN count(DISTINCT {c}) <= 50 THEN 'bar' ELSE 'bar_top_15' END"
        if _KIND.get(c) == 't' else f"CASE WHEN count(DISTINCT {c}) > 10 THEN 'histogram' ELSE 'bar' END"} AS chart
        FROM {source('lineitem_corr')}""" for c in [*LINEITEM, "q2", "neg_tax"]],
    "SELECT 2::BIGINT, col1, col2, 'scatter' FROM ("
    + union([corr_sql("lineitem_corr", a, b) for a, b in combinations(CORR, 2)]) + ") WHERE abs(r) > 0.8",
]))
