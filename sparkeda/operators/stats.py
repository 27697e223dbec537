"""Distribution statistics, outliers and normality."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.digests import first_texts, text_totals
from sparkeda.functions.kinds import numeric_columns, percent, present, quoted, round_to, string_columns
from sparkeda.functions.longform import empty_like, every_column, held, numeric_long
from sparkeda.functions.normal import shapiro_wilk
from sparkeda.functions.ordering import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
FENCE = 1.5


def _v() -> Column:
    return F.col("value")


def moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, nn, mean, std, pstd, var, min, max, skew, kurt)``, one pass and one row for every numeric column.

    Skew and kurtosis carry the bias correction; both are NULL for too few values and
    for a constant column. A column without a value has nn 0 and NULL elsewhere.
    """
    n, g1, g2 = F.col("nn").cast("double"), F.col("g1"), F.col("g2")
    raw = numeric_long(df, cols).groupBy("column").agg(
        F.count("value").alias("nn"), F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"), F.stddev_pop("value").alias("pstd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    varies = F.col("max") > F.col("min")
    skew = F.when((n > 2) & varies, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & varies, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return every_column(df, numeric_columns(df, cols)).join(raw, "column", "left").select(
        "column", F.coalesce("nn", F.lit(0)).cast("long").alias("nn"), "mean", F.sqrt("var").alias("std"), "pstd", "var", "min", "max",
        skew.alias("skew"), kurt.alias("kurt"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """``(column, count, mean, std, min, q25, q50, q75, max)`` with exact quartiles."""
    spread = exact_quantiles(df, cols, QUARTILES).drop("nn")
    joined = moments(df, cols).join(spread, "column", "left")
    return joined.select(
        "column", F.col("nn").alias("count"),
        *[round_to(F.col(c), digits).alias(c) for c in ("mean", "std", "min")],
        *[round_to(F.col("q")[i], digits).alias(f"q{int(p * 100)}") for i, p in enumerate(QUARTILES)],
        round_to(F.col("max"), digits).alias("max"),
    )


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, unique, top, freq)`` per string column; ties go to the smaller value. The counts are taken when this is called."""
    best = F.min(F.struct((-F.col("count")).alias("less"), "head")).alias("best")
    found = held(text_totals(df, cols).groupBy("column").agg(F.sum("count").alias("count"), F.count("*").alias("unique"), best))
    top = first_texts(df, found.select("column", "best.head", (-F.col("best.less")).alias("count")))
    return every_column(df, string_columns(df, cols)).join(found, "column", "left").join(top, "column", "left").select(
        "column", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("count", "unique")),
        F.coalesce("value", "best.head").alias("top"), (-F.col("best.less")).alias("freq"))


def describe_all(df: DataFrame, max_cols: int | None = None, digits: int = 4) -> DataFrame:
    """Numeric and string descriptions in one table; absent entries are NULL."""
    names = df.columns[:max_cols] if max_cols else df.columns
    return describe_numeric(df, names, digits).unionByName(describe_categorical(df, names), allowMissingColumns=True)


def skewness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return moments(df, cols).select("column", round_to(F.col("skew"), 3).alias("skewness"))


def kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return moments(df, cols).select("column", round_to(F.col("kurt"), 3).alias("kurtosis"))


def skew_labels(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    size = F.abs("skewness")
    label = F.when(size > 1, "Highly Skewed").when(size > 0.5, "Moderate").otherwise("Symmetric")
    return skewness(df, cols).withColumn("label", label)


def heavy_tails(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Columns whose |excess kurtosis| is above ``limit`` (compared before rounding)."""
    return moments(df, cols).where(F.abs("kurt") > limit).select(
        "column", round_to(F.col("kurt"), 3).alias("kurtosis"))


def variance_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    middle = exact_quantiles(df, cols, [0.5]).select("column", F.col("q")[0].alias("q50"))
    return moments(df, cols).join(middle, "column", "left").select(
        "column", round_to(F.col("var"), 3).alias("variance"), round_to(F.col("q50"), 4).alias("median"))


def iqr_bounds(
    df: DataFrame, cols: Sequence[str] | None = None, fence: float = FENCE, spread: DataFrame | None = None
) -> DataFrame:
    """``(column, nn, q25, q50, q75, lower, upper)``, one row per numeric column.

    ``spread`` may hand in quartiles already taken by :func:`exact_quantiles`.
    """
    q = (exact_quantiles(df, cols, QUARTILES) if spread is None else spread).select(
        "column", "nn", *[F.col("q")[i].alias(f"q{int(p * 100)}") for i, p in enumerate(QUARTILES)])
    reach = F.lit(fence) * (F.col("q75") - F.col("q25"))
    return q.withColumns({"lower": F.col("q25") - reach, "upper": F.col("q75") + reach})


def _beyond() -> Column:
    return (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, fence: float = FENCE) -> DataFrame:
    """``(column, count, pct, lower, upper)`` of columns with values strictly outside the fences.

    The bounds are one row per column; the share is of all rows, missing ones included.
    """
    rows = df.agg(F.count("*")).scalar()
    bounds = iqr_bounds(df, cols, fence).select("column", "lower", "upper")
    return (
        numeric_long(df, cols).join(F.broadcast(bounds), "column")
        .groupBy("column", "lower", "upper").agg(F.count_if(_beyond()).alias("count"))
        .where("count > 0")
        .select("column", "count", percent(F.col("count"), rows).alias("pct"),
                round_to(F.col("lower"), 3).alias("lower"), round_to(F.col("upper"), 3).alias("upper"))
    )


def zscore_outliers(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """``(column, count, pct)`` of columns with |z| above ``limit``; population deviation."""
    rows = df.agg(F.count("*")).scalar()
    scale = moments(df, cols).where((F.col("nn") > 2) & (F.col("pstd") > 0)).select("column", "mean", "pstd")
    z = F.abs((F.col("value") - F.col("mean")) / F.col("pstd"))
    return (
        numeric_long(df, cols).join(F.broadcast(scale), "column")
        .groupBy("column").agg(F.count_if(z > limit).alias("count")).where("count > 0")
        .select("column", "count", percent(F.col("count"), rows).alias("pct"))
    )


def outlier_counts(df: DataFrame, spread: DataFrame, moment: DataFrame, rows: DataFrame) -> DataFrame:
    """Both outlier tests in one pass over ready quartiles and moments.

    ``(column, iqr_outliers, iqr_pct, lower, upper, z_outliers, z_pct)``; counts may be 0.
    """
    z_ok = (F.col("n") > 2) & (F.col("pstd") > 0)
    limits = iqr_bounds(df, spread=spread).select("column", "lower", "upper").join(
        moment.select("column", F.col("nn").alias("n"), "mean", "pstd"), "column")
    far = z_ok & (F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("pstd"))) > 3.0)
    total = rows.scalar()
    return (
        numeric_long(df).join(F.broadcast(limits), "column")
        .groupBy("column", "lower", "upper").agg(F.count_if(_beyond()).alias("i"), F.count_if(far).alias("z"))
        .select("column", F.col("i").alias("iqr_outliers"), percent(F.col("i"), total).alias("iqr_pct"),
                round_to(F.col("lower"), 3).alias("lower"), round_to(F.col("upper"), 3).alias("upper"),
                F.col("z").alias("z_outliers"), percent(F.col("z"), total).alias("z_pct"))
    )


def outlier_rows(df: DataFrame, col: str, method: str = "iqr", limit: float | None = None) -> DataFrame:
    """The rows whose ``col`` lies outside the IQR fences, or beyond ``limit`` deviations."""
    x = present(df, col).cast("double")
    if method == "iqr":
        b = iqr_bounds(df, [col], limit or FENCE).select(F.struct("lower", "upper")).scalar()
        return df.where((x < b["lower"]) | (x > b["upper"]))
    b = moments(df, [col]).select(F.struct("mean", "pstd")).scalar()
    return df.where(F.abs(F.try_divide(x - b["mean"], b["pstd"])) > (limit or 3.0))


def normality_moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Jarque-Bera from the moments: ``(column, jb, p_value, is_normal)``, any size.

    p is the chi-square tail with two degrees of freedom, exp(-JB / 2).
    """
    n = F.col("nn").cast("double")
    raw = numeric_long(df, cols).groupBy("column").agg(
        F.count("value").alias("nn"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    ).where("hi > lo")
    jb = n / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)
    p = F.exp(-F.col("jb") / 2)
    return raw.select("column", jb.alias("jb")).select(
        "column", round_to(F.col("jb"), 3).alias("jb"), round_to(p, 6).alias("p_value"), (p > 0.05).alias("is_normal"))


def normality_shapiro(
    df: DataFrame, cols: Sequence[str] | None = None, least: int = 8, most: int = 5000
) -> DataFrame:
    """``(column, n, method, statistic, p_value, is_normal)``, one row for every numeric column.

    Columns with ``least`` to ``most`` values take the Shapiro-Wilk test, which is defined for these, so a group holds at most
    ``most`` values; rows of other columns are not shuffled. Longer columns take the test of the moments (``jarque_bera``).
    For fewer values (``too_few``) and a single value (``constant``) there is no test.
    """
    names = numeric_columns(df, cols)
    if not names:
        return empty_like(df, "column string, n long, method string, statistic double, p_value double, is_normal boolean")
    long = numeric_long(df, names)
    size = every_column(df, names).join(long.groupBy("column").agg(
        F.count("*").alias("n"), (F.max("value") > F.min("value")).alias("varies")), "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).cast("long").alias("size"), F.coalesce("varies", F.lit(False)).alias("varies"))
    fit = size.where(F.col("size").between(least, most) & F.col("varies"))

    def test(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(part["value"].to_numpy())
        row = pd.DataFrame({
            "column": [key[0]], "n": [len(part)], "statistic": [round(w, 4)],
            "p_value": [round(p, 6)], "is_normal": [bool(p > 0.05)],
        })
        return row if math.isfinite(w) else row.iloc[:0]

    kept = long.join(F.broadcast(fit.select("column")), "column", "left_semi")
    tested = kept.groupBy("column").applyInPandas(
        test, "column string, n long, statistic double, p_value double, is_normal boolean").drop("n")
    large = normality_moments(df, names).select(
        "column", F.col("jb").alias("l_statistic"), F.col("p_value").alias("l_p"), F.col("is_normal").alias("l_normal"))
    long_column = F.col("size") > most
    method = (F.when(F.col("size") < least, "too_few").when(~F.col("varies"), "constant").when(long_column, "jarque_bera")
              .otherwise("shapiro_wilk"))
    return size.join(tested, "column", "left").join(large, "column", "left").select(
        "column", F.col("size").alias("n"), method.alias("method"),
        *(F.when(long_column, F.col(b)).otherwise(F.col(a)).alias(a)
          for a, b in (("statistic", "l_statistic"), ("p_value", "l_p"), ("is_normal", "l_normal"))))


def normality_ks(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance to the fitted normal: ``(column, n, d, scaled_d, p_value, is_normal)``, any size.

    The empirical distribution needs each value's rank, taken by ranges rather than by one sort.
    ``scaled_d`` is sqrt(n) * d; ``p_value`` allows for the mean and deviation being estimated, as critical values for a known
    normal (1.36 for ``scaled_d`` at 5 %) do not. Constant columns are absent.
    """
    from sparkeda.functions.normal import lilliefors_p, normal_cdf
    from sparkeda.functions.ordering import running_totals

    counted = numeric_long(df, cols).groupBy("column", "value").agg(F.count("*").alias("times"))
    ranked = running_totals(counted, ["times"])
    scale = moments(df, cols).where("std > 0").select("column", "nn", "mean", "std")
    cdf = normal_cdf((F.col("value") - F.col("mean")) / F.col("std"))
    n = F.col("nn").cast("double")
    gap = F.greatest(
        F.abs(F.col("cdf") - F.col("times_before") / n),
        F.abs((F.col("times_before") + F.col("times")) / n - F.col("cdf")),
    )
    return (
        ranked.join(F.broadcast(scale), "column").withColumn("cdf", cdf)
        .groupBy("column").agg(F.max("nn").alias("n"), F.max(gap).alias("d"))
        .select("column", "n", round_to(F.col("d"), 5).alias("d"),
                round_to(F.sqrt(F.col("n").cast("double")) * F.col("d"), 3).alias("scaled_d"),
                round_to(lilliefors_p(F.col("d"), F.col("n")), 4).alias("p_value"), (lilliefors_p(F.col("d"), F.col("n")) > 0.05).alias("is_normal"))
    )


def column_profile(df: DataFrame, col: str) -> DataFrame:
    """``(metric, value, label)`` for one column: counts, shape, outliers and advice."""
    from sparkeda.operators.categorical import dtype_suggestions, encoding_advice
    from sparkeda.operators.quality import _missing, nunique

    one = df.select(quoted(col))
    ddl = "metric string, value double, label string"

    def rows(frame: DataFrame, *names: str) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"),
                     F.lit(None).cast("string").alias("label")) for n in names])
        return frame.select(F.inline(entries))

    def label(frame: DataFrame, metric: str, name: str) -> DataFrame:
        return frame.select(F.lit(metric).alias("metric"), F.lit(None).cast("double").alias("value"),
                            F.col(name).alias("label"))

    facts = _missing(one, [col]).withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))
    parts = [rows(facts, "rows", "missing", "missing_pct"), rows(nunique(one), "nunique")]
    if numeric_columns(one):
        parts += [
            rows(describe_numeric(one), "mean", "std", "min", "q25", "q50", "q75", "max"),
            rows(skewness(one), "skewness"), rows(kurtosis(one), "kurtosis"),
            label(skew_labels(one), "shape", "label"),
            rows(iqr_outliers(one).withColumnRenamed("count", "iqr_outliers"), "iqr_outliers"),
            rows(zscore_outliers(one).withColumnRenamed("count", "z_outliers"), "z_outliers"),
        ]
    elif string_columns(one):
        parts += [
            label(describe_categorical(one), "top", "top"), rows(describe_categorical(one), "freq"),
            label(dtype_suggestions(one), "type_advice", "suggestion"),
            label(encoding_advice(one), "encoding", "encoding"),
        ]
    out = empty_like(df, ddl)
    for p in parts:
        out = out.unionByName(p)
    return out
