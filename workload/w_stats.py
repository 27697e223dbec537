"""Statistics, correlation and time queries."""

from __future__ import annotations

from itertools import combinations


from sparkeda.operators import relate, series, stats
from workload.common import (
    EVENTS_NUMBERS, LINEITEM_NUMBERS, LINEITEM_TEXTS, Registry, big, long_sql, on, pct, per_column, rnd,
    source, union,
)

R = Registry()


def describe_number(c: str, digits: int = 4) -> str:
    x = f"CAST({c} AS DOUBLE)"
    parts = [f"count({c}) AS count"]
    for name, e in (("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"),
                    ("q25", f"quantile_cont({x}, 0.25)"), ("q50", f"quantile_cont({x}, 0.5)"),
                    ("q75", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")):
        parts.append(f"{rnd(e, digits)} AS {name}")
    return ", ".join(parts)


def describe_text_sql(table: str, cols: list[str]) -> str:
    return f"""
    WITH l AS ({long_sql(table, cols, 'VARCHAR')}), c AS (SELECT "column", value, count(*) AS k FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY k DESC, value) AS rn,
            sum(k) OVER (PARTITION BY "column") AS n, count(*) OVER (PARTITION BY "column") AS u FROM c)
    SELECT "column", {big('n')} AS count, u AS "unique", value AS top, k AS freq FROM r WHERE rn = 1"""


R.add("describe_numeric", on("lineitem_nulls", stats.describe_numeric),
      per_column("lineitem_nulls", LINEITEM_NUMBERS, describe_number))
R.add("describe_numeric_gaps", on("lineitem_const", stats.describe_numeric),
      per_column("lineitem_const", [*LINEITEM_NUMBERS, "one", "nothing"], describe_number))
R.add("describe_categorical", on("lineitem_nulls", stats.describe_categorical),
      describe_text_sql("lineitem_nulls", LINEITEM_TEXTS))
R.add("describe_all", on("lineitem_nulls", stats.describe_all), f"""
    SELECT *, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq
    FROM ({per_column('lineitem_nulls', LINEITEM_NUMBERS, describe_number)})
    UNION ALL BY NAME SELECT * FROM ({describe_text_sql('lineitem_nulls', LINEITEM_TEXTS)})""")
R.add("skewness", on("lineitem_const", stats.skewness), per_column(
    "lineitem_const", [*LINEITEM_NUMBERS, "one", "nothing"], lambda c: f"{rnd(f'skewness(CAST({c} AS DOUBLE))', 3)} AS skewness"))
R.add("kurtosis", on("lineitem_const", stats.kurtosis), per_column(
    "lineitem_const", [*LINEITEM_NUMBERS, "one", "nothing"], lambda c: f"{rnd(f'kurtosis(CAST({c} AS DOUBLE))', 3)} AS kurtosis"))
_SKEWED = union([f"SELECT '{c}' AS \"column\", {rnd(f'skewness(CAST({c} AS DOUBLE))', 3)} AS skewness FROM events"
                 for c in EVENTS_NUMBERS])
R.add("skew_labels", on("events", stats.skew_labels), f"""
    SELECT "column", skewness, CASE WHEN abs(skewness) > 1 THEN 'Highly Skewed' WHEN abs(skewness) > 0.5 THEN 'Moderate'
      ELSE 'Symmetric' END AS label FROM ({_SKEWED})""")
R.add("heavy_tails", on("events", stats.heavy_tails), "SELECT \"column\", " + rnd("k", 3) + " AS kurtosis FROM ("
      + per_column("events", EVENTS_NUMBERS, lambda c: f"kurtosis(CAST({c} AS DOUBLE)) AS k") + ") WHERE abs(k) > 3")
R.add("variance_median", on("lineitem_const", stats.variance_median), per_column(
    "lineitem_const", [*LINEITEM_NUMBERS, "one", "nothing"], lambda c: f"""{rnd(f'var_samp(CAST({c} AS DOUBLE))', 3)} AS variance,
        {rnd(f'median(CAST({c} AS DOUBLE))', 4)} AS median"""))


def iqr_sql(table: str, cols: list[str]) -> str:
    def one(c: str) -> str:
        return f"""
        (WITH b AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                      count(*) AS n FROM {source(table)})
        SELECT '{c}' AS "column", count(*) AS count, {pct('count(*)', 'any_value(n)')} AS pct,
          {rnd('any_value(q1 - 1.5 * (q3 - q1))', 3)} AS lower, {rnd('any_value(q3 + 1.5 * (q3 - q1))', 3)} AS upper
        FROM {source(table)}, b
        WHERE CAST({c} AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST({c} AS DOUBLE) > q3 + 1.5 * (q3 - q1)
        HAVING count(*) > 0)"""
    return union([one(c) for c in cols])


def z_sql(table: str, cols: list[str]) -> str:
    def one(c: str) -> str:
        return f"""
        (WITH b AS (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_pop(CAST({c} AS DOUBLE)) AS s, count(*) AS n
                    FROM {source(table)})
        SELECT '{c}' AS "column", count(*) AS count, {pct('count(*)', 'any_value(n)')} AS pct FROM {source(table)}, b
        WHERE s > 0 AND abs((CAST({c} AS DOUBLE) - m) / s) > 3 HAVING count(*) > 0)"""
    return union([one(c) for c in cols])


R.add("iqr_outliers", on("events", stats.iqr_outliers), iqr_sql("events", EVENTS_NUMBERS))
R.add("iqr_outliers_lineitem", on("lineitem_nulls", lambda df: stats.iqr_outliers(df, fence=0.5)),
      iqr_sql("lineitem_nulls", LINEITEM_NUMBERS).replace("1.5 *", "0.5 *"))
R.add("zscore_outliers", on("events", stats.zscore_outliers), z_sql("events", EVENTS_NUMBERS))
R.add("outlier_rows", on("events", lambda df: stats.outlier_rows(df, "value")), """
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT events.* FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def jb_sql(table: str, cols: list[str]) -> str:
    return f"""
    SELECT "column", {rnd('jb', 3)} AS jb, {rnd('exp(-jb / 2)', 6)} AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM (
      SELECT "column", n / 6 * (s * s + k * k / 4) AS jb FROM (
        SELECT "column", CAST(count(*) AS DOUBLE) AS n,
          avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS s,
          avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS k
        FROM (SELECT *, avg(value) OVER (PARTITION BY "column") AS m FROM ({long_sql(table, cols)}))
        GROUP BY 1))"""


R.add("normality_moments", on("lineitem", stats.normality_moments), jb_sql("lineitem", LINEITEM_NUMBERS))


def corr_sql(table: str, a: str, b: str) -> str:
    r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"SELECT '{a}' AS col1, '{b}' AS col2, CASE WHEN isnan({r}) THEN NULL ELSE {r} END AS r FROM {source(table)}"


def matrix_sql(table: str, cols: list[str], digits: int, constant: tuple[str, ...] = ()) -> str:
    rows = [corr_sql(table, a, b) for a in cols for b in cols if a != b]
    own = [f"SELECT '{c}' AS col1, '{c}' AS col2, {'CAST(NULL AS DOUBLE)' if c in constant else '1.0::DOUBLE'} AS r"
           for c in cols]
    return f"SELECT col1, col2, {rnd('r', digits)} AS corr FROM ({union(rows + own)})"


CORR = [*LINEITEM_NUMBERS, "q2", "neg_tax"]
_PAIRS = union([corr_sql("lineitem_corr", a, b) for a, b in combinations(CORR, 2)])
R.add("correlation_matrix", on("lineitem_nulls", relate.correlation_matrix),
      matrix_sql("lineitem_nulls", LINEITEM_NUMBERS, 3))
R.add("correlation_matrix_constant", on("lineitem_const", lambda df: relate.correlation_matrix(
          df, ["l_quantity", "l_tax", "one", "nothing"])),
      matrix_sql("lineitem_const", ["l_quantity", "l_tax", "one", "nothing"], 3, ("one", "nothing")))
R.add("high_corr_pairs", on("lineitem_corr", relate.high_corr_pairs), f"""
    SELECT col1, col2, {rnd('abs(r)', 3)} AS corr, {rnd('r', 3)} AS signed FROM ({_PAIRS}) WHERE abs(r) > 0.8""")
R.add("top_corr_pairs", on("lineitem_corr", lambda df: relate.top_corr_pairs(df.drop("neg_tax"))), f"""
    SELECT col1, col2, {rnd('abs(r)', 3)} AS corr FROM (
    {union([corr_sql('lineitem_corr', a, b) for a, b in combinations(CORR[:-1], 2)])})
    ORDER BY abs(r) DESC, col1, col2 LIMIT 3""")
R.add("pair_corr", on("lineitem_nulls", lambda df: relate.pair_corr(df, "l_quantity", "l_tax")), f"""
    SELECT 'l_quantity' AS col1, 'l_tax' AS col2, count(*) AS n, {rnd('corr(l_quantity, l_tax)', 4)} AS corr
    FROM {source('lineitem_nulls')} WHERE l_tax IS NOT NULL""")


def profile_sql() -> str:
    def row(metric: str, value: str, label: str = "CAST(NULL AS VARCHAR)", tail: str = "") -> str:
        return f"SELECT '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, {label} AS label FROM events{tail}"

    rows = [row("rows", "count(*)"), row("missing", "count(*) - count(value)"),
            row("missing_pct", pct("count(*) - count(value)", "count(*)")), row("nunique", "count(DISTINCT value)")]
    for name, e in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"),
                    ("q25", "quantile_cont(value, 0.25)"), ("q50", "quantile_cont(value, 0.5)"),
                    ("q75", "quantile_cont(value, 0.75)"), ("max", "max(value)")):
        rows.append(row(name, rnd(e, 4)))
    rows += [row("skewness", rnd("skewness(value)", 3)), row("kurtosis", rnd("kurtosis(value)", 3)),
             row("shape", "NULL", "CASE WHEN abs(skewness(value)) > 1 THEN 'Highly Skewed' "
                 "WHEN abs(skewness(value)) > 0.5 THEN 'Moderate' ELSE 'Symmetric' END")]
    counted = union([
        f"SELECT 'iqr_outliers' AS metric, CAST(count AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS label "
        f"FROM ({iqr_sql('events', ['value'])})",
        f"SELECT 'z_outliers', CAST(count AS DOUBLE), CAST(NULL AS VARCHAR) FROM ({z_sql('events', ['value'])})"])
    return union([*rows, counted])


R.add("column_profile", on("events", lambda df: stats.column_profile(df, "value")), profile_sql())
_MONTHS = """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n, avg(o_totalprice) AS m,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS t FROM orders GROUP BY 1, 4"""
R.add("trend", on("orders", lambda df: series.trend(df, "o_orderdate", "o_totalprice")), f"""
    SELECT period, n, {rnd('m', 4)} AS mean, {rnd('(SELECT regr_slope(m, t) FROM p)', 4)} AS slope
    FROM p""".replace("SELECT period", f"WITH p AS ({_MONTHS}) SELECT period", 1))
R.add("seasonality", on("orders", lambda df: series.seasonality(df, "o_orderdate", "o_totalprice")), f"""
    SELECT CAST(month(o_orderdate) AS BIGINT) AS season, count(*) AS n, {rnd('avg(o_totalprice)', 4)} AS mean,
      {rnd('avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders)', 4)} AS index FROM orders GROUP BY 1""")
R.add("autocorrelation", on("orders", lambda df: series.autocorrelation(df, "o_orderdate", "o_totalprice")), f"""
    WITH p AS ({_MONTHS}), k AS (SELECT unnest([1, 2, 3, 6, 12]) AS lag)
    SELECT {big('lag')} AS lag, count(*) AS n, {rnd('corr(a.m, b.m)', 4)} AS corr
    FROM k, p a, p b WHERE b.t = a.t + lag GROUP BY 1""")
R.add("rolling_mean", on("events", lambda df: series.rolling_mean(df, "user_id", "ts", "event_id", "value", 7)), f"""
    SELECT user_id, event_id, ts, value, {rnd('avg(value) OVER w', 4)} AS rolling FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
R.add("line_series", on("orders", lambda df: series.line_series(df, "o_orderkey", "o_totalprice")), f"""
    WITH e AS (SELECT CAST(min(o_orderkey) AS DOUBLE) AS lo, CAST(max(o_orderkey) AS DOUBLE) AS hi FROM orders)
    SELECT CAST(least(floor((CAST(o_orderkey AS DOUBLE) - lo) * 200.0 / (hi - lo)), 199) AS BIGINT) AS point,
      count(*) AS n, {rnd('avg(o_totalprice)', 4)} AS mean FROM orders, e GROUP BY 1""")
