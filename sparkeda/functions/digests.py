"""Counting long values by 128-bit digests; a text itself is read again only where it belongs to a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.longform import string_long

#: Letters of a text that go along with its digest: they order most texts, and shorter ones need no second look.
HEAD = 64
#: Places that the digests of a result are dealt to; what is broadcast holds at most one number for each.
PLACES = 1 << 20
KEY = ["d1", "d2"]


def digest(*values: Column) -> list[Column]:
    """``d1``, ``d2``: two 64-bit hashes of the values; a missing value differs from every other."""
    known = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(F.lit(0), *known).alias("d1"), F.xxhash64(F.lit(1), *known).alias("d2")]


def thinned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose digest is not among ``wanted``."""
    place = F.pmod("d1", F.lit(PLACES)).alias("place")
    return rows.withColumn("place", place).join(F.broadcast(wanted.select(place).distinct()), "place", "left_semi").drop("place")


def text_totals(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, d1, d2, head, count)`` for every text of the string columns."""
    head = F.left("value", F.lit(HEAD)).alias("head")            # a key, not a minimum: aggregates of texts are sorted, not hashed
    return string_long(df, cols).select("column", head, *digest(F.col("value"))).groupBy("column", *KEY, "head").agg(F.count("*").alias("count"))


def _one_text() -> Column:
    """The text of a digest's group, of which ``value`` is the least and ``last`` the largest."""
    return F.when(F.col("value") == F.col("last"), F.col("value")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("string"))


def first_texts(df: DataFrame, heads: DataFrame) -> DataFrame:
    """``(column, value)``: the least text with the given beginning and count, for each of ``heads`` (column, head, count).

    ``heads`` has one row for each column at most. Only columns whose beginning is cut are read, and of them its texts alone.
    """
    cut = heads.where(F.length("head") >= HEAD)
    names = [r["column"] for r in cut.select("column").collect()]
    texts = string_long(df, names).join(F.broadcast(cut.withColumnRenamed("count", "wanted")), "column").where(F.left("value", F.lit(HEAD)) == F.col("head"))
    counted = texts.select("column", "wanted", "value", *digest(F.col("value"))).groupBy("column", "wanted", *KEY).agg(
        F.count("*").alias("times"), F.min("value").alias("value"), F.max("value").alias("last"))
    return counted.where("times = wanted").groupBy("column").agg(F.min(_one_text()).alias("value"))


def leading_texts(df: DataFrame, cols: Sequence[str] | None, k: int) -> DataFrame:
    """``(column, value, count, rank)``: the ``k`` most frequent texts of each string column, ties by the text.

    Texts with the same beginning and count stay together until they are read; a digest that two of them share is an error.
    """
    in_column = W.partitionBy("column")
    lead = text_totals(df, cols).withColumn("at", F.rank().over(in_column.orderBy(F.desc("count"), "head"))).where(F.col("at") <= k).drop("at")
    cut = lead.where(F.length("head") >= HEAD).select("column", *KEY)
    texts = string_long(df, cols).where(F.length("value") >= HEAD).select("column", "value", *digest(F.col("value")))
    found = thinned(texts, cut).groupBy("column", *KEY).agg(F.min("value").alias("value"), F.max("value").alias("last"))
    order = in_column.orderBy(F.desc("count"), "value")
    return (
        lead.join(found.select("column", *KEY, _one_text().alias("value")), ["column", *KEY], "left")
        .select("column", F.coalesce("value", "head").alias("value"), "count")
        .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    )
