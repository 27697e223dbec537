"""Named answers to the usual ad hoc questions.

Anything else is plain Spark: ``df.createOrReplaceTempView(name)`` and ``spark.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import present, quoted, round_to
from sparkeda.functions.ordering import exact_quantiles
from sparkeda.functions.tails import chi_square_p_value, f_p_value, t_p_value
from sparkeda.operators.stats import iqr_bounds

AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.countDistinct,
}


def _aggregate(df: DataFrame, col: str, fn: str) -> Column:
    if fn not in AGGREGATES:
        raise ValueError(f"fn must be one of {sorted(AGGREGATES)}, not {fn!r}")
    value = present(df, col)
    return AGGREGATES[fn](value if fn in ("count", "nunique") else value.cast("double"))


def scalar_agg(df: DataFrame, col: str, fn: str = "mean", digits: int = 4) -> DataFrame:
    """One row ``(column, fn, value)``; ``fn`` also takes ``median``."""
    if fn == "median":
        one = exact_quantiles(df, [col], [0.5]).select(F.col("q")[0].alias("value"))
    else:
        one = df.agg(_aggregate(df, col, fn).cast("double").alias("value"))
    return one.select(F.lit(col).alias("column"), F.lit(fn).alias("fn"), round_to(F.col("value"), digits).alias("value"))


def group_agg(df: DataFrame, by: str, col: str, fn: str = "mean", digits: int = 4) -> DataFrame:
    """``(by, value)`` per group, highest first."""
    return (
        df.groupBy(quoted(by).alias(by)).agg(_aggregate(df, col, fn).cast("double").alias("value"))
        .select(by, round_to(F.col("value"), digits).alias("value")).orderBy(F.desc("value"), by)
    )


def top_group(df: DataFrame, by: str, col: str, fn: str = "mean", digits: int = 4) -> DataFrame:
    """The group with the highest value; ties go to the smaller group name."""
    return group_agg(df, by, col, fn, digits).limit(1)


def outlier_count(df: DataFrame, col: str) -> DataFrame:
    """One row: how many values lie strictly outside the IQR fences, also when none does."""
    b = iqr_bounds(df, [col]).select(F.struct("lower", "upper")).scalar()
    x = present(df, col).cast("double")
    return df.agg(F.count_if((x < b["lower"]) | (x > b["upper"])).alias("outliers")).select(
        F.lit(col).alias("column"), "outliers")


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, dof, statistic, p_value)``: independence of two categorical columns.

    Only cells that occur are formed. The empty ones add their expected counts, which is what
    the expected counts of the others leave of n, so no cell grid is built.
    """
    cells = df.select(quoted(a).alias("a"), quoted(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").groupBy(
        "a", "b").agg(F.count("*").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    size = rows.agg(F.sum("ra").alias("n"), F.count("*").alias("r")).select(F.struct("*")).scalar()
    width = cols.agg(F.count("*")).scalar()
    expected = F.col("ra") * F.col("cb").cast("double") / size["n"]
    fit = cells.join(rows, "a").join(cols, "b").withColumn("e", expected).agg(
        F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("seen"), F.sum("e").alias("covered"))
    return (
        fit.select(size["n"].alias("n"), ((size["r"] - 1) * (width - 1)).alias("dof"),
                   (F.col("seen") + (size["n"] - F.col("covered"))).alias("x"))
        .select("n", "dof", round_to(F.col("x"), 4).alias("statistic"),
                round_to(chi_square_p_value("x", F.col("dof").cast("double")), 6).alias("p_value"))
    )


def _groups(df: DataFrame, by: str, col: str) -> DataFrame:
    x = present(df, col).cast("double")
    return df.where(quoted(by).isNotNull()).groupBy(quoted(by).alias("g")).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).where("n > 0")


def t_test(df: DataFrame, by: str, col: str, first: str, second: str) -> DataFrame:
    """One row ``(n1, n2, mean1, mean2, t, dof, p_value)``: Welch's test between two groups."""
    groups = _groups(df.where(quoted(by).isin(first, second)), by, col)

    def of(name: str, field: str) -> Column:
        return F.max(F.when(F.col("g") == name, F.col(field)))

    one = groups.agg(*[
        of(g, f).alias(f"{f}{i}") for i, g in ((1, first), (2, second)) for f in ("n", "m", "v")])
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2))
    dof = F.try_divide(F.pow(s1 + s2, 2), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))
    return one.select("n1", "n2", "m1", "m2", t.alias("t"), dof.alias("dof")).select(
        "n1", "n2", round_to(F.col("m1"), 4).alias("mean1"), round_to(F.col("m2"), 4).alias("mean2"),
        round_to(F.col("t"), 4).alias("t"), round_to(F.col("dof"), 3).alias("dof"),
        round_to(t_p_value("t", "dof"), 6).alias("p_value"))


def anova(df: DataFrame, by: str, col: str) -> DataFrame:
    """One row ``(groups, n, f, dof_between, dof_within, p_value)``: one-way analysis of variance."""
    groups = _groups(df, by, col)
    grand = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    sums = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - grand, 2)).alias("between"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("within"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide(F.col("between"), d1), F.try_divide(F.col("within"), d2))
    return sums.select("groups", "n", f.alias("f"), d1.alias("dof_between"), d2.alias("dof_within")).select(
        "groups", "n", round_to(F.col("f"), 4).alias("f"), "dof_between", "dof_within",
        round_to(f_p_value("f", F.col("dof_between").cast("double"), F.col("dof_within").cast("double")), 6)
        .alias("p_value"))
