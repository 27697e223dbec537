"""Categorical and risk queries."""

from __future__ import annotations

from itertools import combinations

from sparkeda.operators import categorical as cat
from workload.common import (
    LINEITEM, LINEITEM_NUMBERS, Registry, long_sql, on, per_column, rnd, source, union,
)
from workload.w_basics import LINEITEM_SCHEMA
from workload.w_stats import corr_sql, iqr_sql

R = Registry()
PART_TEXTS = ["p_name", "p_brand", "p_type"]
DOC_TEXTS = ["text", "lang", "source"]


def totals(table: str, cols: list[str]) -> str:
    return f'SELECT "column", value, count(*) AS k FROM ({long_sql(table, cols, "VARCHAR")}) GROUP BY 1, 2'


def top_sql(table: str, cols: list[str], k: int) -> str:
    return f"""SELECT "column", value, k AS count, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY k DESC, value) AS rank
        FROM ({totals(table, cols)})) WHERE rank <= {k}"""


R.add("value_counts", on("part", cat.value_counts), top_sql("part", PART_TEXTS, 10))
R.add("high_cardinality", on("part", cat.high_cardinality), "SELECT * FROM (" + per_column(
    "part", PART_TEXTS, lambda c: f"count(DISTINCT {c}) AS nunique") + ") WHERE nunique > 50")


def balance_sql(table: str, cols: list[str]) -> str:
    return f"""SELECT "column", count(*) AS classes, first(value ORDER BY k, value) AS min_class, min(k) AS min_count,
        first(value ORDER BY k DESC, value) AS max_class, max(k) AS max_count,
        CAST(min(k) AS DOUBLE) / greatest(max(k), 1) AS ratio FROM ({totals(table, cols)}) GROUP BY 1"""


R.add("class_imbalance", on("documents", lambda df: cat.class_imbalance(df, ["lang", "source"])), f"""
    WITH b AS ({balance_sql('documents', ['lang', 'source'])}), t AS ({top_sql('documents', ['lang', 'source'], 10)})
    SELECT "column", any_value(classes) AS classes, {rnd('any_value(ratio)', 3)} AS imbalance_ratio,
      string_agg(value || '=' || count, ', ' ORDER BY rank) AS distribution
    FROM b JOIN t USING ("column") WHERE classes BETWEEN 2 AND 20 AND ratio < 0.2 GROUP BY 1""")
R.add("class_imbalance_roles", on("conversations", cat.class_imbalance), f"""
    WITH b AS ({balance_sql('conversations', ['role', 'text'])}), t AS ({top_sql('conversations', ['role', 'text'], 10)})
    SELECT "column", any_value(classes) AS classes, {rnd('any_value(ratio)', 3)} AS imbalance_ratio,
      string_agg(value || '=' || count, ', ' ORDER BY rank) AS distribution
    FROM b JOIN t USING ("column") WHERE classes BETWEEN 2 AND 20 AND ratio < 0.2 GROUP BY 1""")
R.add("class_balance_all", on("lineitem", cat.class_balance_all), f"""
    SELECT "column", classes, min_class, min_count, max_class, max_count, {rnd('ratio', 3)} AS imbalance_ratio
    FROM ({balance_sql('lineitem', ['l_returnflag', 'l_linestatus'])}) WHERE classes BETWEEN 2 AND 20""")
R.add("target_imbalance", on("labels", lambda df: cat.target_imbalance(df, "quality")), f"""
    SELECT CAST(quality AS VARCHAR) AS value, count(*) AS count,
      {rnd('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 2)} AS share_pct,
      {rnd('CAST(count(*) AS DOUBLE) / max(count(*)) OVER ()', 3)} AS ratio_to_largest FROM labels GROUP BY 1""")


def distinct_where(table: str, cols: list[str], test: str) -> str:
    return "SELECT * FROM (" + per_column(table, cols, lambda c: f"count(DISTINCT {c}) AS nunique") + f") WHERE {test}"


R.add("constant_columns", on("lineitem_const", cat.constant_columns),
      distinct_where("lineitem_const", [*LINEITEM, "one", "nothing"], "nunique <= 1"))
R.add("low_variance", on("lineitem", cat.low_variance), "SELECT \"column\", " + rnd("v", 6) + " AS variance FROM ("
      + per_column("lineitem", LINEITEM_NUMBERS, lambda c: f"var_samp(CAST({c} AS DOUBLE)) AS v") + ") WHERE v < 0.01")
R.add("leakage_columns", on("customer", cat.leakage_columns), f"""
    SELECT "column", nunique, {rnd('nunique * 100.0::DOUBLE / n', 2)} AS unique_pct FROM (
    {per_column('customer', ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'],
                lambda c: f'count(DISTINCT {c}) AS nunique, count(*) AS n')}) WHERE nunique > 0.9 * n""")

ORDERS_TEXT = ["key_text", "price_text", "date_text", "o_orderpriority", "cust_text"]


def dtype_sql(table: str, cols: list[str]) -> str:
    """Number, then the formats that occur in the test tables, then few values."""
    return f"""SELECT * FROM (SELECT "column", CASE WHEN bad_number = 0 THEN 'Convert to numeric'
        WHEN bad_time = 0 THEN 'Convert to datetime' WHEN u < 20 THEN 'Convert to category' END AS suggestion FROM (
        {per_column(table, cols, lambda c: f'''
          count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS bad_number,
          count(*) FILTER (WHERE {c} IS NOT NULL AND try_strptime({c}, '%Y-%m-%d') IS NULL) AS bad_time,
          count(DISTINCT {c}) AS u''')})) WHERE suggestion IS NOT NULL"""


R.add("dtype_suggestions", on("orders_text", cat.dtype_suggestions), dtype_sql("orders_text", ORDERS_TEXT))
R.add("cardinality_summary", on("documents", cat.cardinality_summary),
      per_column("documents", DOC_TEXTS, lambda c: f"count(DISTINCT {c}) AS nunique"))
R.add("numeric_as_category", on("lineitem_nulls", cat.numeric_as_category), f"""
    SELECT "column", value, count(*) AS count FROM ({long_sql('lineitem_nulls', LINEITEM_NUMBERS)})
    WHERE "column" IN (SELECT "column" FROM ({distinct_where('lineitem_nulls', LINEITEM_NUMBERS, 'nunique <= 10')}))
    GROUP BY 1, 2""")
R.add("encoding_advice", on("part", cat.encoding_advice), f"""
    SELECT "column", nunique, CASE WHEN nunique <= 10 THEN 'one-hot' WHEN nunique <= 50 THEN 'label'
      WHEN nunique <= 0.9 * n THEN 'frequency' ELSE 'drop' END AS encoding FROM (
    {per_column('part', PART_TEXTS, lambda c: f'count(DISTINCT {c}) AS nunique, count(*) AS n')})""")

CORR = [*LINEITEM_NUMBERS, "q2", "neg_tax"]
_NULL = "CAST(NULL AS VARCHAR) AS with_column"
R.add("transform_advice", on("lineitem_corr", cat.transform_advice), union([
    f"SELECT \"column\", 'log' AS advice, {_NULL} FROM ("
    + per_column("lineitem_corr", CORR, lambda c: f"skewness(CAST({c} AS DOUBLE)) AS s") + ") WHERE abs(s) > 1",
    "SELECT col1, 'interaction', col2 FROM ("
    + union([corr_sql("lineitem_corr", a, b) for a, b in combinations(CORR, 2)]) + ") WHERE abs(r) > 0.8",
    f"SELECT \"column\", 'drop_constant', {_NULL} FROM ("
    + distinct_where("lineitem_corr", [*LINEITEM, "q2", "neg_tax"], "nunique <= 1") + ")",
    f"SELECT \"column\", 'drop_low_variance', {_NULL} FROM ("
    + per_column("lineitem_corr", CORR, lambda c: f"var_samp(CAST({c} AS DOUBLE)) AS v") + ") WHERE v < 0.01",
]))

_TYPES = dict(LINEITEM_SCHEMA)
_gap = lambda c: "CAST(count(*) - count({0}) AS DOUBLE) / count(*) * 100".format(c)
R.add("cleaning_advice", on("lineitem_nulls", cat.cleaning_advice), union([
    "SELECT \"column\", advice FROM (" + per_column("lineitem_nulls", LINEITEM, lambda c:
        f"count(*) - count({c}) AS gaps, CASE WHEN {_gap(c)} > 50 THEN 'drop_column' ELSE "
        f"'{'impute_mode' if _TYPES[c] in ('VARCHAR', 'TIMESTAMP') else 'impute_median'}' END AS advice")
    + ") WHERE gaps > 0",
    "SELECT \"column\", 'drop_constant' FROM (" + distinct_where("lineitem_nulls", LINEITEM, "nunique <= 1") + ")",
    "SELECT \"column\", 'cap_outliers' FROM (" + iqr_sql("lineitem_nulls", LINEITEM_NUMBERS) + ") WHERE pct > 1",
]))
R.add("cleaning_advice_tokens", on("orders_tokens", cat.cleaning_advice),
      "SELECT 'o_orderstatus' AS \"column\", 'replace_placeholders' AS advice FROM "
      f"{source('orders_tokens')} WHERE trim(o_orderstatus) IN ('N/A', 'na', '-') HAVING count(*) > 0")
