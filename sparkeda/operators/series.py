"""Columns over time or in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.kinds import present, quoted, round_to
from sparkeda.functions.ordering import value_cuts, with_slot

SEASONS = {"month": F.month, "weekday": F.weekday, "quarter": F.quarter, "hour": F.hour}


def _period_means(df: DataFrame, time: str, col: str, unit: str) -> DataFrame:
    """``(period, n, total)``: one row per period, combined before the shuffle."""
    return df.groupBy(F.date_trunc(unit, quoted(time)).cast("timestamp_ntz").alias("period")).agg(
        F.count(present(df, col)).alias("n"), F.sum(present(df, col).cast("double")).alias("total"),
    ).where("period IS NOT NULL")


def _period_number(period: Column, unit: str) -> Column:
    """Whole number that grows by one from a period to the next, whatever the session's time zone."""
    months = (F.year(period) * 12 + F.month(period)).cast("long")
    days = F.unix_date(period.cast("date")).cast("long")
    numbers = {
        "year": F.year(period).cast("long"), "quarter": F.floor((months - 1) / F.lit(3)), "month": months,
        "week": F.floor((days - 4) / F.lit(7)), "day": days, "hour": days * 24 + F.hour(period),
        "minute": days * 1440 + F.hour(period) * 60 + F.minute(period),
    }
    return numbers[unit].cast("long")


def trend(df: DataFrame, time: str, col: str, unit: str = "month") -> DataFrame:
    """``(period, n, mean, slope)``: mean per period and the slope of that mean per period."""
    per = _period_means(df, time, col, unit).where("n > 0").select(
        "period", "n", (F.col("total") / F.col("n")).alias("mean"))
    number = _period_number(F.col("period"), unit).cast("double")
    slope = per.agg(F.regr_slope(F.col("mean"), number)).scalar()
    return per.select("period", "n", round_to(F.col("mean"), 4).alias("mean"), round_to(slope, 4).alias("slope"))


def seasonality(df: DataFrame, time: str, col: str, season: str = "month") -> DataFrame:
    """``(season, n, mean, index)``: mean per month, weekday, ... and its ratio to the overall mean."""
    x = present(df, col).cast("double")
    overall = df.agg(F.avg(x)).scalar()
    return (
        df.where(quoted(time).isNotNull())
        .groupBy(SEASONS[season](quoted(time)).cast("long").alias("season"))
        .agg(F.count(x).alias("n"), F.avg(x).alias("m"))
        .select("season", "n", round_to(F.col("m"), 4).alias("mean"),
                round_to(F.try_divide(F.col("m"), overall), 4).alias("index"))
    )


def autocorrelation(
    df: DataFrame, time: str, col: str, unit: str = "month", lags: Sequence[int] = (1, 2, 3, 6, 12)
) -> DataFrame:
    """``(lag, n, corr)``: correlation of the period means with themselves ``lag`` periods later.

    Periods are matched by number through an equi-join, so no row order is needed.
    """
    per = _period_means(df, time, col, unit).where("n > 0").select(
        _period_number(F.col("period"), unit).alias("t"), (F.col("total") / F.col("n")).alias("x"))
    ahead = per.select("t", F.col("x").alias("y"))
    shifted = per.select(F.explode(F.array(*[F.lit(k).cast("long") for k in lags])).alias("lag"), "t", "x")
    matched = shifted.withColumn("t", F.col("t") + F.col("lag")).join(ahead, "t")
    r = F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))
    return (
        matched.groupBy("lag").agg(
            F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"),
            F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
        .select("lag", "n", round_to(r, 4).alias("corr"))
    )


def line_series(df: DataFrame, order_by: str, col: str, points: int = 200) -> DataFrame:
    """``(point, n, mean)``: the column along an order key, averaged into a fixed number of points."""
    k = quoted(order_by).cast("double")
    ends = df.agg(F.min(k).alias("lo"), F.max(k).alias("hi")).select(F.struct("lo", "hi")).scalar()
    width = F.nullif(ends["hi"] - ends["lo"], F.lit(0.0))
    point = F.coalesce(
        F.least(F.floor((k - ends["lo"]) * F.lit(float(points)) / width), F.lit(points - 1)), F.lit(0)
    ).cast("long")
    x = present(df, col).cast("double")
    return df.where(k.isNotNull()).groupBy(point.alias("point")).agg(
        F.count(x).alias("n"), round_to(F.avg(x), 4).alias("mean"))


def rolling_mean(
    df: DataFrame, by: str, order_by: str, key: str, col: str, window: int,
    digits: int = 4, every: int | None = None,
) -> DataFrame:
    """``(by, key, order_by, value, rolling)``: mean of the last ``window`` rows per group.

    Row order is ``order_by`` then the unique ``key``. A group may hold a third of a large
    table, so the time axis is cut into ranges of about ``every`` times: each
    (group, range) is a window of its own and starts with the last ``window - 1`` rows of
    the ranges before it.
    """
    rows = df.select(
        quoted(by).alias(by), quoted(order_by).alias(order_by), quoted(key).alias(key),
        present(df, col).cast("double").alias("value"),
    )
    out = [by, key, order_by, "value"]
    place = F.struct(order_by, key)                       # unique, so equal times can be cut as well
    axis = rows.select(F.lit("axis").alias("column"), place.alias("value"))
    cuts = value_cuts(axis, every).select("cuts").scalar()
    keyed = rows.withColumnRenamed("value", "x").select("*", place.alias("value"), cuts.alias("cuts"))
    cut = with_slot(keyed).drop("value").withColumnRenamed("x", "value")
    newest = W.partitionBy(by, "slot").orderBy(F.col(order_by).desc(), F.col(key).desc())
    tails = (
        cut.withColumn("back", F.row_number().over(newest)).where(F.col("back") < window)
        .groupBy(by, "slot").agg(F.sort_array(F.collect_list(F.struct(order_by, key, "value"))).alias("tail"))
    )                                                     # < window rows per (group, range)
    earlier = W.partitionBy(by).orderBy("slot").rowsBetween(1 - window, -1)
    carried = (
        tails.withColumn("before", F.flatten(F.collect_list("tail").over(earlier)))
        .withColumn("before", F.slice("before", F.greatest(F.lit(1), F.size("before") - (window - 2)), window))
        .select(by, "slot", F.inline("before")).withColumn("carried", F.lit(True))
    )
    frame = W.partitionBy(by, "slot").orderBy(order_by, key).rowsBetween(1 - window, 0)
    return (
        cut.withColumn("carried", F.lit(False)).unionByName(carried)
        .withColumn("rolling", round_to(F.avg("value").over(frame), digits))
        .where(~F.col("carried")).select(*out, "rolling")
    )
