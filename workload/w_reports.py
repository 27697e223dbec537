"""Composite reports, and their SQL assembled from the same parts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sparkeda.operators.quality import PLACEHOLDER_TOKENS
from sparkeda.plans import reports
from workload.common import LINEITEM, LINEITEM_NUMBERS, LINEITEM_TEXTS, Registry, long_sql, on, pct, rnd, source, union
from workload.w_basics import KINDS, LINEITEM_SCHEMA, LINEITEM_TYPES, bytes_sql
from workload.w_categorical import balance_sql, distinct_where, dtype_sql, top_sql
from workload.w_plots import shapiro_sql
from workload.w_stats import corr_sql, describe_text_sql, iqr_sql, jb_sql, z_sql

R = Registry()
T = "lineitem_nulls"
S = source(T)
NO_LABEL, NO_VALUE = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"


def cell(column: str, metric: str, value: str = NO_VALUE, label: str = NO_LABEL, tail: str = f" FROM {S}") -> str:
    return (f"SELECT {column} AS \"column\", {metric} AS metric, CAST({value} AS DOUBLE) AS value, "
            f"CAST({label} AS VARCHAR) AS label{tail}")


def lit(text: str) -> str:
    return f"'{text}'"


def melt_sql(frame: str, values: dict[str, str], labels: dict[str, str] | None = None) -> str:
    """Rows of a frame with a ``column`` column: metric name -> expression."""
    every = [cell('"column"', lit(m), e, tail=f" FROM ({frame})") for m, e in values.items()]
    every += [cell('"column"', lit(m), label=e, tail=f" FROM ({frame})") for m, e in (labels or {}).items()]
    return union(every)


def types_sql() -> list[str]:
    found: dict[str, int] = {}
    for t in LINEITEM_TYPES:
        found[KINDS[t][0]] = found.get(KINDS[t][0], 0) + 1
    return [cell("'*'", lit(f"columns_{t}"), str(k), tail="") for t, k in found.items()]


def overview_sql() -> str:
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {S}))"
    return union([
        cell("'*'", "'rows'", "count(*)"), cell("'*'", "'cols'", str(len(LINEITEM)), tail=""),
        cell("'*'", "'duplicates'", f"count(*) - {distinct}"),
        cell("'*'", "'bytes'", "sum(bytes)", tail=f" FROM ({bytes_sql(T, LINEITEM_SCHEMA)})"),
        *types_sql(), *[cell(lit(c), "'dtype'", label=lit(KINDS[t][0]), tail="") for c, t in LINEITEM_SCHEMA],
    ])


def missing_rows(digits: int = 2, only: bool = True) -> list[str]:
    tail = f" FROM {S}" + (" HAVING count(*) > count({c})" if only else "")
    return [x for c in LINEITEM for x in (
        cell(lit(c), "'missing'", f"count(*) - count({c})", tail=tail.replace("{c}", c)),
        cell(lit(c), "'missing_pct'", pct(f"count(*) - count({c})", "count(*)", digits), tail=tail.replace("{c}", c)))]


_cells = " + ".join(f"count(*) - count({c})" for c in LINEITEM)
_whole = " AND ".join(f"{c} IS NOT NULL" for c in LINEITEM)
_full = f"count(*) FILTER (WHERE {_whole})"


def quality_sql() -> str:
    size = f"(count(*) * {len(LINEITEM)})"
    return union([
        *missing_rows(), cell("'*'", "'missing_cells'", _cells), cell("'*'", "'total_cells'", size),
        cell("'*'", "'completeness_pct'", pct(f"{size} - ({_cells})", size)),
        cell("'*'", "'complete_rows'", _full), cell("'*'", "'complete_pct'", pct(_full, "count(*)")),
        *[cell(lit(c), lit(f"placeholder {t}"), "count(*)",
               tail=f" FROM {S} WHERE lower(trim({c})) = '{t.lower()}' HAVING count(*) > 0")
          for c in LINEITEM_TEXTS for t in PLACEHOLDER_TOKENS],
    ])


def describe_cells(c: str) -> dict[str, str]:
    x = f"CAST({c} AS DOUBLE)"
    return {
        "count": f"count({c})", "mean": rnd(f"avg({x})", 4), "std": rnd(f"stddev_samp({x})", 4), "min": rnd(f"min({x})", 4),
        "q25": rnd(f"quantile_cont({x}, 0.25)", 4), "q50": rnd(f"quantile_cont({x}, 0.5)", 4),
        "q75": rnd(f"quantile_cont({x}, 0.75)", 4), "max": rnd(f"max({x})", 4),
    }


def statistics_sql() -> str:
    out = []
    for c in LINEITEM_NUMBERS:
        x = f"CAST({c} AS DOUBLE)"
        every = {
            **describe_cells(c), "skewness": rnd(f"skewness({x})", 3), "kurtosis": rnd(f"kurtosis({x})", 3),
            "variance": rnd(f"var_samp({x})", 3), "highly_skewed": f"(abs(skewness({x})) > 1)::INT",
            "heavy_tailed": f"(abs(kurtosis({x})) > 3)::INT",
        }
        out += [cell(lit(c), lit(m), e) for m, e in every.items()]
    return union(out)


def outliers_sql() -> str:
    return union([
        melt_sql(iqr_sql(T, LINEITEM_NUMBERS), {"iqr_outliers": "count", "iqr_pct": "pct", "lower": "lower", "upper": "upper"}),
        melt_sql(z_sql(T, LINEITEM_NUMBERS), {"z_outliers": "count", "z_pct": "pct"})])


def correlation_sql() -> str:
    pairs = union([corr_sql(T, a, b) for a, b in combinations(LINEITEM_NUMBERS, 2)])
    return union([cell("col1", "'corr'", rnd("r", 3), "col2", f" FROM ({pairs})"),
                  cell("col1", "'high_corr'", rnd("abs(r)", 3), "col2", f" FROM ({pairs}) WHERE abs(r) > 0.8")])


def nunique_cells(cols: list[str]) -> list[str]:
    return [cell(lit(c), "'nunique'", f"count(DISTINCT {c})") for c in cols]


def categorical_sql() -> str:
    balance = f"SELECT * FROM ({balance_sql(T, LINEITEM_TEXTS)}) WHERE classes BETWEEN 2 AND 20"
    return union([
        *nunique_cells(LINEITEM_TEXTS),
        cell('"column"', "'value_count'", "count", "value", f" FROM ({top_sql(T, LINEITEM_TEXTS, 10)})"),
        melt_sql(balance, {"imbalance_ratio": rnd("ratio", 3)}, {"min_class": "min_class", "max_class": "max_class"})])


def risk_sql() -> str:
    parts = []
    for c in LINEITEM:
        parts.append(cell(lit(c), "'leakage_pct'", rnd(f"count(DISTINCT {c}) * 100.0::DOUBLE / count(*)", 2),
                          tail=f" FROM {S} HAVING count(DISTINCT {c}) > 0.9 * count(*)"))
        parts.append(cell(lit(c), "'constant'", f"count(DISTINCT {c})", tail=f" FROM {S} HAVING count(DISTINCT {c}) <= 1"))
    for c in LINEITEM_NUMBERS:
        parts.append(cell(lit(c), "'low_variance'", rnd(f"var_samp(CAST({c} AS DOUBLE))", 6),
                          tail=f" FROM {S} HAVING var_samp(CAST({c} AS DOUBLE)) < 0.01"))
        parts.append(cell(lit(c), "'transform'", label="'log'",
                          tail=f" FROM {S} HAVING abs(skewness(CAST({c} AS DOUBLE))) > 1"))
    for c in LINEITEM_TEXTS:
        pick = (f"CASE WHEN count(DISTINCT {c}) <= 10 THEN 'one-hot' WHEN count(DISTINCT {c}) <= 50 THEN 'label' "
                f"WHEN count(DISTINCT {c}) <= 0.9 * count(*) THEN 'frequency' ELSE 'drop' END")
        parts.append(cell(lit(c), "'encoding'", label=pick))
    return union(parts)


def describe_text_cells() -> str:
    return melt_sql(describe_text_sql(T, LINEITEM_TEXTS),
                    {"count": "count", "unique": '"unique"', "freq": "freq"}, {"top": "top"})


def normality_cells() -> str:
    tests = f"""
        WITH c AS (SELECT "column", count(*) AS n FROM ({long_sql(T, LINEITEM_NUMBERS)}) GROUP BY 1)
        SELECT j."column", jb AS statistic, p_value, 'jarque_bera' AS method
        FROM ({jb_sql(T, LINEITEM_NUMBERS)}) j JOIN c ON j."column" = c."column" WHERE n > 5000
        UNION ALL SELECT "column", statistic, p_value, method FROM ({shapiro_sql(T, LINEITEM_NUMBERS)})"""
    return melt_sql(tests, {"normality_statistic": "statistic", "normality_p": "p_value"}, {"normality_test": "method"})


def insights_sql() -> str:
    imbalance = f"""WITH b AS ({balance_sql(T, LINEITEM_TEXTS)}), t AS ({top_sql(T, LINEITEM_TEXTS, 10)})
        SELECT "column", any_value(ratio) AS ratio, string_agg(value || '=' || count, ', ' ORDER BY rank) AS dist
        FROM b JOIN t USING ("column") WHERE classes BETWEEN 2 AND 20 AND ratio < 0.2 GROUP BY 1"""
    return union([
        melt_sql(distinct_where(T, LINEITEM_TEXTS, "nunique > 50"), {"high_cardinality": "nunique"}),
        melt_sql(imbalance, {"imbalance_ratio": rnd("ratio", 3)}, {"distribution": "dist"}),
        melt_sql(distinct_where(T, LINEITEM, "nunique <= 1"), {"constant": "nunique"}),
        *[cell(lit(c), "'low_variance'", rnd(f"var_samp(CAST({c} AS DOUBLE))", 6),
               tail=f" FROM {S} HAVING var_samp(CAST({c} AS DOUBLE)) < 0.01") for c in LINEITEM_NUMBERS],
        melt_sql(dtype_sql(T, LINEITEM_TEXTS), {}, {"suggestion": "suggestion"}),
    ])


TASK_SQL = {
    "overview": overview_sql, "quality": quality_sql, "statistics": statistics_sql, "outliers": outliers_sql,
    "correlation": correlation_sql, "categorical": categorical_sql, "risk": risk_sql,
}

R.add("enterprise_eda", on(T, lambda df: reports.enterprise_eda(df)[0]),
      union([f"SELECT '{name}' AS task, * FROM ({build()})" for name, build in TASK_SQL.items()]))


def _broken(df):
    """The status table when one task fails while it runs."""
    tasks = {
        "overview": reports.TASKS["overview"],
        "broken": lambda facts: facts.df.select(
            F.lit("*").alias("column"), F.lit("x").alias("metric"),
            F.when(F.col("l_quantity") > 0, F.raise_error(F.lit("this task cannot run"))).cast("double").alias("value"),
            F.lit("").alias("label")),
        "quality": reports.TASKS["quality"],
    }
    return reports.enterprise_eda(df, tasks)[1].select("priority", "task", "status")


R.add("enterprise_status", on(T, _broken), """
    SELECT * FROM (VALUES (1::BIGINT, 'overview', 'ok'), (2, 'broken', 'failed'), (3, 'quality', 'ok')) t(priority, task, status)""")
R.add("deep_eda", on(T, reports.deep_eda), union([f"SELECT '{s}' AS section, * FROM ({sql})" for s, sql in (
    ("overview", overview_sql()), ("cleaning", quality_sql()),
    ("summary", union([statistics_sql(), describe_text_cells(), outliers_sql(), correlation_sql(), normality_cells()])),
    ("insights", insights_sql()))]))
R.add("profile_context", on(T, reports.profile_context), union([
    cell("'*'", "'rows'", "count(*)"), cell("'*'", "'cols'", str(len(LINEITEM)), tail=""),
    *[x for c, t in LINEITEM_SCHEMA for x in (
        cell(lit(c), "'dtype'", label=lit(KINDS[t][0]), tail=""), cell(lit(c), "'kind'", label=lit(KINDS[t][1]), tail=""))],
    *missing_rows(only=False), *nunique_cells(LINEITEM),
    *[cell(lit(c), lit(m), e) for c in LINEITEM_NUMBERS for m, e in describe_cells(c).items()], describe_text_cells(),
]))
R.add("data_report", on(T, reports.data_report), union([
    cell("'*'", "'rows'", "count(*)"), cell("'*'", "'cols'", str(len(LINEITEM)), tail=""),
    cell("'*'", "'bytes'", "sum(bytes)", tail=f" FROM ({bytes_sql(T, LINEITEM_SCHEMA)})"), *types_sql(), *missing_rows(1),
    *[cell(lit(c), lit(m), e) for c in LINEITEM_NUMBERS for m, e in describe_cells(c).items()],
    *nunique_cells(LINEITEM_TEXTS),
]))


def ratio_sql(text: str, number: str) -> str:
    return cell(lit(text), "'correlation_ratio'", rnd("sqrt(sum(n * pow(m - g, 2)) / (sum(n * pow(m - g, 2)) + sum(n * v)))", 4),
                lit(number), f""" FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (
        SELECT count(*) AS n, avg(CAST({number} AS DOUBLE)) AS m, var_pop(CAST({number} AS DOUBLE)) AS v FROM {S}
        WHERE {text} IS NOT NULL AND {number} IS NOT NULL GROUP BY {text}))""")


def uncertainty_sql(a: str, b: str) -> str:
    """Entropies of the complete pairs; a text's own entropy is the divisor."""
    def h(keys: str) -> str:
        return (f"(SELECT -sum(p * ln(p)) FROM (SELECT CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p FROM {S} "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {keys}))")
    return cell(lit(a), "'uncertainty'", rnd(f"({h(a)} + {h(b)} - {h(f'{a}, {b}')}) / {h(a)}", 4), lit(b), "")


R.add("column_report", on(T, reports.column_report), union([
    *[cell(lit(c), "'rows'", "count(*)") for c in LINEITEM], *missing_rows(only=False), *nunique_cells(LINEITEM),
    statistics_sql(), melt_sql(describe_text_sql(T, LINEITEM_TEXTS), {"freq": "freq"}, {"top": "top"}),
    *[cell("col1", "'pearson'", rnd("r", 3), "col2", f" FROM ({corr_sql(T, a, b)})")
      for a, b in combinations(LINEITEM_NUMBERS, 2)],
    *[ratio_sql(t, c) for t in LINEITEM_TEXTS for c in LINEITEM_NUMBERS],
    uncertainty_sql("l_returnflag", "l_linestatus"), uncertainty_sql("l_linestatus", "l_returnflag"),
]))
