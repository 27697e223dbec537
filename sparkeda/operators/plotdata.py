"""The aggregates behind each chart."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import (
    columns_of, numeric_columns, quoted, round_to, string_columns,
)
from sparkeda.functions.longform import empty_like, numeric_long
from sparkeda.functions.normal import inverse_normal
from sparkeda.functions.ordering import running_totals
from sparkeda.operators.basics import complete_sample
from sparkeda.operators.categorical import narrow_columns, value_counts, value_totals
from sparkeda.operators.quality import nunique
from sparkeda.operators.relate import correlation_matrix, pair_stats, top_corr_pairs
from sparkeda.operators.stats import iqr_bounds

BINS = 30
RUN = 1 << 20


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """``(column, bin, lo, hi, count)``: equal-width bins over [min, max], the last one closed.

    A constant column gets [x - 0.5, x + 0.5]. Infinite values have no bin and are left out. Empty bins are listed. A value that the
    division puts on the wrong side of a bin edge is moved to the bin the edge says.
    """
    names = numeric_columns(df, cols)
    long = numeric_long(df, names).where(~F.col("value").isin(float("inf"), float("-inf")))
    flat = F.col("a") == F.col("b")
    ends = long.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b")).select(
        "column",
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("first"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("last"),
    ).withColumn("step", (F.col("last") - F.col("first")) / F.lit(float(bins)))

    def edge(i: Column) -> Column:
        return F.col("first") + i * F.col("step")

    raw = F.floor((F.col("value") - F.col("first")) / (F.col("last") - F.col("first")) * F.lit(float(bins)))
    guess = F.col("guess")
    down = (F.col("value") < edge(guess)).cast("long")
    up = ((guess < bins - 1) & (F.col("value") >= edge(guess + 1))).cast("long")
    counts = (
        long.join(F.broadcast(ends), "column")
        .withColumn("guess", F.least(raw, F.lit(bins - 1)))
        .groupBy("column", (guess - down + up).cast("long").alias("bin")).agg(F.count("*").alias("held"))
    )
    grid = ends.select("column", "first", "last", "step",
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    right = F.when(F.col("bin") == bins - 1, F.col("last")).otherwise(edge(F.col("bin") + 1))
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", round_to(edge(F.col("bin")), 4).alias("lo"), round_to(right, 4).alias("hi"),
        F.coalesce("held", F.lit(0)).cast("long").alias("count"))


def _bandwidths(long: DataFrame, cut: float, points: int) -> DataFrame:
    """``(column, nn, a, bw, start, step)`` for Scott's rule, columns that vary only."""
    return (
        long.groupBy("column").agg(
            F.count("*").alias("nn"), F.stddev_samp("value").alias("sd"),
            F.min("value").alias("a"), F.max("value").alias("b"))
        .where("nn > 1 AND sd > 0")
        .withColumn("bw", F.col("sd") * F.pow(F.col("nn").cast("double"), F.lit(-0.2)))
        .withColumn("start", F.col("a") - F.lit(cut) * F.col("bw"))
        .withColumn("step", (F.col("b") + F.lit(cut) * F.col("bw") - F.col("start")) / F.lit(points - 1.0))
        .drop("sd", "b")
    )


def kde(
    df: DataFrame, cols: Sequence[str] | None = None, points: int = 200, cut: float = 3.0,
    digits: int = 8,
) -> DataFrame:
    """``(column, point, x, density)``: Gaussian kernel density with Scott's bandwidth on a grid.

    A fast Gauss transform: rows are summed into cells half a bandwidth wide, each holding
    the first moments of its values around the cell's middle, and every cell then adds its
    series to the grid points within reach. The series is cut below 1e-14 of the peak; summing
    many rows in doubles leaves about 1e-12. Only cells, never rows times points, leave the scan.
    """
    names = numeric_columns(df, cols)
    long = numeric_long(df, names)
    shape = _bandwidths(long, cut, points)
    terms, reach = 14, 8.5
    cell = F.floor((F.col("value") - F.col("a")) / (F.col("bw") / 2))
    u = F.col("u")
    power: list[Column] = [F.exp(-u * u / 2)]
    for k in range(1, terms):
        power.append(power[-1] * u / F.lit(float(k)))
    middle = F.col("a") + (F.col("cell") + 0.5) * F.col("bw") / 2
    cells = (
        long.join(F.broadcast(shape), "column").withColumn("cell", cell)
        .withColumn("u", (F.col("value") - middle) / F.col("bw"))
        .groupBy("column", "cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(power)])
        .join(F.broadcast(shape), "column").withColumn("mid", middle)
    )

    def index(x: Column) -> Column:
        return (x - F.col("start")) / F.col("step")

    near = cells.select(
        "*",
        F.greatest(F.lit(0), F.ceil(index(F.col("mid") - reach * F.col("bw")))).cast("long").alias("from"),
        F.least(F.lit(points - 1), F.floor(index(F.col("mid") + reach * F.col("bw")))).cast("long").alias("to"),
    ).where("from <= to").select("*", F.explode(F.sequence("from", "to")).alias("point"))
    t = F.col("t")
    series = F.col(f"m{terms - 1}")
    for k in range(terms - 2, -1, -1):
        series = series * t + F.col(f"m{k}")
    weight = F.exp(-t * t / 2) * series / (F.col("nn") * F.col("bw") * math.sqrt(2 * math.pi))
    dens = (
        near.withColumn("t", (F.col("start") + F.col("point") * F.col("step") - F.col("mid")) / F.col("bw"))
        .groupBy("column", "point").agg(F.sum(weight).alias("d"))
    )
    grid = shape.select("column", "start", "step",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point"))
    return grid.join(dens, ["column", "point"], "left").select(
        "column", "point", round_to(F.col("start") + F.col("point") * F.col("step"), 4).alias("x"),
        round_to(F.coalesce("d", F.lit(0.0)), digits).alias("density"))


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """``(column, q25, q50, q75, whisker_lo, whisker_hi, fliers)`` of each box."""
    names = numeric_columns(df, cols)
    bounds = iqr_bounds(df, names)
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    spans = (
        numeric_long(df, names).join(F.broadcast(bounds), "column")
        .groupBy("column", "q25", "q50", "q75").agg(
            F.min(F.when(inside, F.col("value"))).alias("lo"), F.max(F.when(inside, F.col("value"))).alias("hi"),
            F.count_if(~inside).alias("fliers"))
    )
    low = F.least("lo", "q25")
    high = F.greatest("hi", "q75")
    return spans.select(
        "column", *[round_to(F.col(c), digits).alias(c) for c in ("q25", "q50", "q75")],
        round_to(low, digits).alias("whisker_lo"), round_to(high, digits).alias("whisker_hi"), "fliers")


def violin(df: DataFrame, cols: Sequence[str] | None = None, points: int = 100) -> DataFrame:
    """Density outline (cut at two bandwidths) with the quartiles of each column."""
    names = numeric_columns(df, cols)
    quartiles = box_stats(df, names).select("column", "q25", "q50", "q75")
    return kde(df, names, points, 2.0).join(F.broadcast(quartiles), "column")


def qq_points(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, rank, theoretical, value)``: every ordered value against its normal median.

    Ranks come from running totals over distinct values; a value repeated more than ``RUN``
    times is spread over tasks in runs before its ranks are written out.
    """
    names = numeric_columns(df, cols)
    counted = numeric_long(df, names).groupBy("column", "value").agg(F.count("*").alias("times"))
    sizes = counted.groupBy("column").agg(F.sum("times").alias("nn"))
    ranked = running_totals(counted, ["times"]).join(F.broadcast(sizes), "column")
    span = ranked.select("column", "value", "nn", (F.col("times_before") + 1).alias("from"),
                         (F.col("times_before") + F.col("times")).alias("to"))
    usual = span.where(F.col("to") - F.col("from") < RUN)
    runs = F.sequence("from", "to", F.lit(RUN).cast("long"))
    hot = (
        span.where(F.col("to") - F.col("from") >= RUN)
        .select("column", "value", "nn", F.explode(runs).alias("from"), "to")
        .withColumn("to", F.least("to", F.col("from") + RUN - 1))
        .repartition("column", "value", "from")
    )
    n = F.col("nn").cast("double")
    first = 1 - F.pow(F.lit(0.5), 1 / n)
    median = (
        F.when(F.col("nn") == 1, F.lit(0.5)).when(F.col("rank") == 1, first).when(F.col("rank") == F.col("nn"), 1 - first)
        .otherwise((F.col("rank") - 0.3175) / (n + 0.365))
    )
    return (
        usual.unionByName(hot)
        .select("column", "value", "nn", F.explode(F.sequence("from", "to")).alias("rank"))
        .select("column", "rank", inverse_normal(median).alias("theoretical"), "value")
    )


def qq_line(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n, slope, intercept, r)``: the least-squares line through the QQ points."""
    x, y = "theoretical", "value"
    sums = qq_points(df, cols).groupBy("column").agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"),
        F.var_pop(x).alias("vx"), F.stddev_pop(y).alias("sy"))
    slope = F.try_divide(F.col("c"), F.col("vx"))
    return sums.select(
        "column", "n", round_to(slope, 4).alias("slope"),
        round_to(F.col("my") - slope * F.col("mx"), 4).alias("intercept"),
        round_to(F.try_divide(F.col("c"), F.sqrt("vx") * F.col("sy")), 6).alias("r"))


def bar_counts(df: DataFrame, cols: Sequence[str] | None = None, k: int = 15) -> DataFrame:
    """Top values of the string columns."""
    return value_counts(df, string_columns(df, cols), k)


def pie_shares(df: DataFrame, cols: Sequence[str] | None = None, most: int = 8) -> DataFrame:
    """``(column, value, count, share_pct)`` of string columns with at most ``most`` values."""
    totals = value_totals(df, narrow_columns(df, string_columns(df, cols), most))
    sums = totals.groupBy("column").agg(F.count("*").alias("classes"), F.sum("count").alias("n")).where(
        F.col("classes") <= most)
    return totals.join(F.broadcast(sums), "column").select(
        "column", "value", "count", round_to(F.col("count") * 100.0 / F.col("n"), 1).alias("share_pct"))


def corr_heatmap(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return correlation_matrix(df, cols, digits=2)


def scatter_sample(df: DataFrame, key: str, cols: Sequence[str] | None = None, pairs: int = 3, k: int = 2000) -> DataFrame:
    """``(col1, col2, x, y)``: at most ``k`` complete rows for each of the strongest pairs.

    The names of the strongest pairs (``pairs`` rows) decide the plan, so they are fetched first.
    """
    out = empty_like(df, "col1 string, col2 string, x double, y double")
    for a, b, _ in top_corr_pairs(df, cols, pairs).collect():
        sample = complete_sample(df, [a, b], key, k)
        out = out.unionByName(sample.select(
            F.lit(a).alias("col1"), F.lit(b).alias("col2"),
            quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y")))
    return out


def pairplot_sample(df: DataFrame, key: str, cols: Sequence[str] | None = None, k: int = 500) -> DataFrame:
    """At most ``k`` complete rows of the numeric columns, however many there are."""
    names = numeric_columns(df, cols)
    return complete_sample(df, names, key, k)


def stacked_bar(df: DataFrame, by: str, split: str) -> DataFrame:
    """``(by, split, count)`` for two categories, long form."""
    return df.groupBy(quoted(by).alias(by), quoted(split).alias(split)).agg(F.count("*").alias("count"))


def plot_advice(df: DataFrame) -> DataFrame:
    """``(priority, column, with_column, chart)`` from fixed rules.

    1 line for a time column; 2 scatter for a pair with |r| > 0.8; 3 histogram for a numeric
    column with more than ten values, else bar; 4 pie up to 8 categories, bar up to 50, above
    that bar of the top 15.
    """
    nothing = F.lit(None).cast("string").alias("with_column")
    times = columns_of(df, "datetime")
    numeric, texts = numeric_columns(df), string_columns(df)
    u = F.col("nunique")
    chart = (
        F.when(F.col("column").isin(times), "line")
        .when(F.col("column").isin(numeric), F.when(u > 10, "histogram").otherwise("bar"))
        .otherwise(F.when(u <= 8, "pie").when(u <= 50, "bar").otherwise("bar_top_15"))
    )
    priority = F.when(F.col("column").isin(times), 1).when(F.col("column").isin(numeric), 3).otherwise(4).cast("long")
    single = nunique(df, times + numeric + texts).select(
        priority.alias("priority"), "column", nothing, chart.alias("chart"))
    pairs = pair_stats(df).where(F.abs("r") > 0.8).select(
        F.lit(2).cast("long").alias("priority"), F.col("col1").alias("column"), F.col("col2").alias("with_column"),
        F.lit("scatter").alias("chart"))
    return single.unionByName(pairs)
