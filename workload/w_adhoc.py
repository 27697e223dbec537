"""Ad hoc question and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.functions.kinds import round_to
from sparkeda.operators import adhoc, features
from workload.common import LINEITEM_NUMBERS, Registry, big, on, rnd, source

R = Registry()

R.add("scalar_agg", on("customer", lambda df: adhoc.scalar_agg(df, "c_acctbal", "mean")),
      f"SELECT 'c_acctbal' AS \"column\", 'mean' AS fn, {rnd('avg(c_acctbal)', 4)} AS value FROM customer")
R.add("scalar_agg_median", on("lineitem", lambda df: adhoc.scalar_agg(df, "l_extendedprice", "median")),
      f"SELECT 'l_extendedprice' AS \"column\", 'median' AS fn, {rnd('median(l_extendedprice)', 4)} AS value FROM lineitem")
R.add("group_agg", on("customer", lambda df: adhoc.group_agg(df, "c_mktsegment", "c_acctbal", "mean")),
      f"SELECT c_mktsegment, {rnd('avg(c_acctbal)', 4)} AS value FROM customer GROUP BY 1")
R.add("top_group", on("orders", lambda df: adhoc.top_group(df, "o_orderpriority", "o_totalprice", "sum", 2)), f"""
    SELECT o_orderpriority, {rnd('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1
    ORDER BY value DESC, o_orderpriority LIMIT 1""")
R.add("outlier_count", on("events", lambda df: adhoc.outlier_count(df, "value")), """
    WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT 'value' AS "column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
      AS outliers FROM events, b""")
# p-values need distribution tails that SQL lacks: the statistic is compared, the tails are unit-tested.
R.add("chi_square_test", on("lineitem", lambda df: adhoc.chi_square_test(df, "l_returnflag", "l_linenumber").drop("p_value")), f"""
    WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
    ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1),
    n AS (SELECT count(*) AS n FROM lineitem),
    g AS (SELECT ra.a, cb.b, coalesce(o, 0) AS o, CAST(ra AS DOUBLE) * cb / n AS e
          FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)
    SELECT (SELECT n FROM n) AS n, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof,
      {rnd('sum((o - e) * (o - e) / e)', 4)} AS statistic FROM g""")
R.add("chi_square_p_value", on("lineitem", lambda df: adhoc.chi_square_test(df, "l_returnflag", "l_linenumber")))
_welch = """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n1, count(*) FILTER (WHERE o_orderstatus = 'O') AS n2,
    avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m1, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m2,
    var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS v1,
    var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS v2 FROM orders"""
R.add("t_test", on("orders", lambda df: adhoc.t_test(df, "o_orderstatus", "o_totalprice", "F", "O").drop("p_value")), f"""
    SELECT n1, n2, {rnd('m1', 4)} AS mean1, {rnd('m2', 4)} AS mean2, {rnd('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 4)} AS t,
      {rnd('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))', 3)} AS dof
    FROM ({_welch})""")
R.add("t_test_p_value", on("orders", lambda df: adhoc.t_test(df, "o_orderstatus", "o_totalprice", "F", "O")))
R.add("anova", on("orders", lambda df: adhoc.anova(df, "o_orderpriority", "o_totalprice").drop("p_value")), f"""
    WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
               FROM orders GROUP BY 1), t AS (SELECT avg(o_totalprice) AS gm FROM orders)
    SELECT count(*) AS groups, {big('sum(n)')} AS n,
      {rnd('(sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))', 4)} AS f,
      count(*) - 1 AS dof_between, {big('sum(n) - count(*)')} AS dof_within FROM g, t""")
R.add("anova_p_value", on("orders", lambda df: adhoc.anova(df, "o_orderpriority", "o_totalprice")))


def rounded(df, cols, digits=6):
    return df.withColumns({c: round_to(F.col(c), digits) for c in cols})


KEY = ["event_id"]
R.add("log_transform", on("events", lambda df: rounded(
          features.log_transform(df.select("event_id", "user_id", "value")), ["value_log"])),
      f"SELECT event_id, user_id, value, {rnd('CASE WHEN value > -1 THEN ln(1 + value) END', 6)} AS value_log FROM events")
R.add("power_transform", on("customer", lambda df: rounded(
          features.power_transform(df, ["c_acctbal"]), ["c_acctbal_pow"])),
      f"SELECT *, {rnd('sign(c_acctbal) * sqrt(abs(c_acctbal))', 6)} AS c_acctbal_pow FROM customer")
R.add("min_max_scale", on("lineitem_nulls", lambda df: rounded(features.min_max_scale(
          df.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"), ["l_extendedprice", "l_tax"]),
          ["l_extendedprice_scaled", "l_tax_scaled"])), f"""
    WITH t AS (SELECT * FROM {source('lineitem_nulls')}), s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b,
      min(l_tax) AS c, max(l_tax) AS d FROM t)
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, {rnd('(l_extendedprice - a) / (b - a)', 6)}
      AS l_extendedprice_scaled, {rnd('(l_tax - c) / (d - c)', 6)} AS l_tax_scaled FROM t, s""")
R.add("zscore_scale", on("lineitem_nulls", lambda df: rounded(features.zscore_scale(
          df.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"), ["l_extendedprice", "l_tax"]),
          ["l_extendedprice_z", "l_tax_z"])), f"""
    WITH t AS (SELECT * FROM {source('lineitem_nulls')}), s AS (SELECT avg(l_extendedprice) AS a,
      stddev_pop(l_extendedprice) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS d FROM t)
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, {rnd('(l_extendedprice - a) / b', 6)} AS l_extendedprice_z,
      {rnd('(l_tax - c) / d', 6)} AS l_tax_z FROM t, s""")
R.add("bin_column", on("part", lambda df: features.bin_column(df, "p_size", edges=[10, 20, 35]).select("p_partkey", "p_size_bin")),
      f"""SELECT p_partkey, {big('(p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 35)::INT')} AS p_size_bin FROM part""")
R.add("bin_quantiles", on("customer", lambda df: features.bin_column(df, "c_acctbal", quantiles=4).select(
          "c_custkey", "c_acctbal_bin")), f"""
    WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b,
                 quantile_cont(c_acctbal, 0.75) AS c FROM customer)
    SELECT c_custkey, {big('(c_acctbal >= a)::INT + (c_acctbal >= b)::INT + (c_acctbal >= c)::INT')} AS c_acctbal_bin
    FROM customer, q""")
R.add("ratio_feature", on("lineitem", lambda df: rounded(features.ratio_feature(
          df.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount",
          "price_per_discount"), ["price_per_discount"], 3)),
      f"""SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount,
        {rnd('CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END', 3)} AS price_per_discount FROM lineitem""")
R.add("interaction_terms", on("lineitem_corr", lambda df: rounded(features.interaction_terms(
          df.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "q2", "neg_tax")),
          ["l_quantity_x_q2", "l_tax_x_neg_tax"])),
      f"""SELECT l_orderkey, l_linenumber, l_quantity, l_tax, q2, neg_tax, {rnd('l_quantity * q2', 6)} AS l_quantity_x_q2,
        {rnd('l_tax * neg_tax', 6)} AS l_tax_x_neg_tax FROM {source('lineitem_corr')}""")
R.add("one_hot", on("lineitem", lambda df: features.one_hot(
          df.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])),
      """SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS l_returnflag_A, (l_returnflag = 'N')::INT AS l_returnflag_N,
        (l_returnflag = 'R')::INT AS l_returnflag_R, (l_linestatus = 'F')::INT AS l_linestatus_F,
        (l_linestatus = 'O')::INT AS l_linestatus_O FROM lineitem""")
R.add("label_encode", on("part", lambda df: features.label_encode(df, "p_name").select("p_partkey", "p_name", "p_name_code")),
      "SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name_code FROM part")
R.add("pca", on("lineitem", lambda df: features.pca(
          df, 2, LINEITEM_NUMBERS, keep=["l_orderkey", "l_linenumber"])))
R.add("drop_redundant", on("lineitem_corr", features.drop_redundant),
      f"SELECT * EXCLUDE (l_discount, l_tax, neg_tax, q2) FROM {source('lineitem_corr')}")
