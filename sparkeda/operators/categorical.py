"""Categorical columns and the risks they carry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.digests import leading_texts
from sparkeda.functions.kinds import numeric_columns, present, quoted, round_to, string_columns
from sparkeda.functions.longform import numeric_long, rows_from, string_long, text_long
from sparkeda.operators.quality import nunique
from sparkeda.operators.stats import moments

# Datetime layouts tried on text columns, each with the shape a text must have to be tried.
DATETIME_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd MMM yyyy": r"^\d{2} [A-Za-z]{3} \d{4}$",
    "MMM dd, yyyy": r"^[A-Za-z]{3} \d{2}, \d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}
NUMBER = r"^\s*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|(?i:nan|inf|infinity))\s*$"


def value_totals(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, count)`` for every value; combined map-side, a hot value is one row."""
    return string_long(df, cols).groupBy("column", "value").agg(F.count("*").alias("count"))


def top_values(totals: DataFrame, k: int) -> DataFrame:
    """Top ``k`` values per column with their rank; each task passes on ``k`` rows per column."""
    order = W.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return totals.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """``(column, value, count, rank)``: top values per string column, ties by value."""
    return leading_texts(df, cols, k)


def _distinct(df: DataFrame, names: Sequence[str], known: DataFrame | None) -> DataFrame:
    """``(column, nunique)`` of ``names``: from ``known`` distinct counts, or counted here."""
    if not names:
        return _no_columns(df)
    return nunique(df, names) if known is None else known.where(F.col("column").isin(list(names)))


def narrow_columns(df: DataFrame, names: Sequence[str], most: int) -> list[str]:
    """``names`` that may have at most ``most`` distinct values, so that wide columns need no exact count.

    A sketch of d values has at most d of its registers set, so the estimate for a column with ``most``
    values stays near ``most``; ten times that, and at least 200, leaves no narrow column out.
    """
    if not names:
        return []
    guess = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if guess[i] <= max(200, 10 * most)]


def high_cardinality(
    df: DataFrame, cols: Sequence[str] | None = None, limit: int = 50, distinct: DataFrame | None = None
) -> DataFrame:
    """String columns with more than ``limit`` distinct values."""
    return _distinct(df, string_columns(df, cols), distinct).where(F.col("nunique") > limit)


def _no_columns(df: DataFrame) -> DataFrame:
    return df.limit(0).select(F.lit("").alias("column"), F.lit(0).cast("long").alias("nunique"))


def _balance(totals: DataFrame) -> DataFrame:
    """``(column, classes, min_class, min_count, max_class, max_count, ratio)`` per column."""
    low = F.min(F.struct("count", "value"))
    high = F.min(F.struct((-F.col("count")).alias("neg"), "value"))
    return totals.groupBy("column").agg(
        F.count("*").alias("classes"), low.alias("low"), high.alias("high"),
    ).select(
        "column", "classes", F.col("low.value").alias("min_class"), F.col("low.count").alias("min_count"),
        F.col("high.value").alias("max_class"), (-F.col("high.neg")).alias("max_count"),
        (F.col("low.count") / F.greatest(-F.col("high.neg"), F.lit(1))).alias("ratio"),
    )


def class_imbalance(
    df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.2, classes: tuple[int, int] = (2, 20),
    totals: DataFrame | None = None,
) -> DataFrame:
    """``(column, classes, imbalance_ratio, distribution)`` of string columns with few, uneven classes.

    ``distribution`` lists the top ten values as ``value=count``, most frequent first.
    """
    if totals is None:
        totals = value_totals(df, narrow_columns(df, string_columns(df, cols), classes[1]))
    uneven = _balance(totals).where(F.col("classes").between(*classes) & (F.col("ratio") < limit))
    listed = top_values(totals, 10).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
    text = F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string"))), ", ")
    return uneven.join(listed, "column").select(
        "column", "classes", round_to(F.col("ratio"), 3).alias("imbalance_ratio"), text.alias("distribution"))


def class_balance_all(
    df: DataFrame, cols: Sequence[str] | None = None, classes: tuple[int, int] = (2, 20)
) -> DataFrame:
    """Smallest and largest class of every string column with 2..20 classes, and their ratio."""
    names = narrow_columns(df, string_columns(df, cols), classes[1])
    return _balance(value_totals(df, names)).where(F.col("classes").between(*classes)).select(
        "column", "classes", "min_class", "min_count", "max_class", "max_count",
        round_to(F.col("ratio"), 3).alias("imbalance_ratio"))


def target_imbalance(df: DataFrame, target: str) -> DataFrame:
    """``(value, count, share_pct, ratio_to_largest)`` of a target column of any scalar type."""
    totals = text_long(df, [target]).groupBy("value").agg(F.count("*").alias("count"))
    whole = totals.agg(F.sum("count").alias("n"), F.max("count").alias("top")).select(F.struct("n", "top")).scalar()
    return totals.select(
        "value", "count", round_to(F.col("count") * 100.0 / whole["n"], 2).alias("share_pct"),
        round_to(F.col("count") / whole["top"], 3).alias("ratio_to_largest"))


def constant_columns(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """Columns with at most one distinct value, all-missing ones included.

    Without ready ``distinct`` counts, least and greatest value tell it: one pass, no shuffle of values.
    """
    if distinct is not None:
        return distinct.where(F.col("nunique") <= 1)
    values = [F.to_json(quoted(c)) if df.schema[c].dataType.typeName() == "map" else present(df, c) for c in df.columns]
    one = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = [[("column", F.lit(c)), ("nunique", F.when(F.col(f"lo{i}").isNull(), 0).when(
        F.col(f"lo{i}") == F.col(f"hi{i}"), 1).cast("long"))] for i, c in enumerate(df.columns)]
    return rows_from(one, rows).where(F.col("nunique").isNotNull())


def low_variance(
    df: DataFrame, cols: Sequence[str] | None = None, limit: float = 0.01, moment: DataFrame | None = None
) -> DataFrame:
    """``(column, variance)`` of numeric columns whose sample variance is below ``limit``."""
    return (moments(df, cols) if moment is None else moment).where(F.col("var") < limit).select("column", round_to(F.col("var"), 6).alias("variance"))


def leakage_columns(df: DataFrame, share: float = 0.9, distinct: DataFrame | None = None) -> DataFrame:
    """``(column, nunique, unique_pct)`` of columns whose values are nearly all distinct."""
    rows = df.agg(F.count("*")).scalar()
    return _distinct(df, df.columns, distinct).where(F.col("nunique") > F.lit(share) * rows).select(
        "column", "nunique", round_to(F.col("nunique") * 100.0 / rows, 2).alias("unique_pct"))


def dtype_suggestions(
    df: DataFrame, cols: Sequence[str] | None = None, formats: Mapping[str, str] = DATETIME_FORMATS,
    distinct: DataFrame | None = None,
) -> DataFrame:
    """``(column, suggestion)`` per string column: numeric, else datetime, else category below 20 values.

    A failed parse is costly, so a text is parsed only when its shape allows.
    """
    names = string_columns(df, cols)
    if not names:
        return df.limit(0).select(F.lit("").alias("column"), F.lit("").alias("suggestion"))
    text = F.col("value")
    number = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    moment = F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in formats.items()])
    parses = string_long(df, names, keep_null=True).groupBy("column").agg(
        F.count_if(F.col("value").isNotNull() & number.isNull()).alias("not_number"),
        F.count_if(F.col("value").isNotNull() & moment.isNull()).alias("not_time"),
    )
    advice = (
        F.when(F.col("not_number") == 0, "Convert to numeric")
        .when(F.col("not_time") == 0, "Convert to datetime")
        .when(F.col("nunique") < 20, "Convert to category")
    )
    counts = _distinct(df, narrow_columns(df, names, 20) if distinct is None else names, distinct)
    return parses.join(counts, "column", "left").select(
        "column", advice.alias("suggestion")).where(F.col("suggestion").isNotNull())


def cardinality_summary(df: DataFrame) -> DataFrame:
    """Distinct counts of the string columns."""
    names = string_columns(df)
    return _distinct(df, names, None)


def numeric_as_category(df: DataFrame, cols: Sequence[str] | None = None, most: int = 10) -> DataFrame:
    """``(column, value, count)`` of numeric columns with at most ``most`` distinct values.

    Wide columns are left out by a sketch before any value is shuffled.
    """
    names = narrow_columns(df, numeric_columns(df, cols), most)
    totals = numeric_long(df, names).groupBy("column", "value").agg(F.count("*").alias("count"))
    few = totals.groupBy("column").agg(F.count("*").alias("values")).where(F.col("values") <= most)
    return totals.join(F.broadcast(few.select("column")), "column", "left_semi").select("column", "value", "count")


def encoding_advice(
    df: DataFrame, cols: Sequence[str] | None = None, distinct: DataFrame | None = None
) -> DataFrame:
    """``(column, nunique, encoding)``: one-hot up to 10 values, label up to 50, frequency up to 90 % of rows, else drop."""
    rows = df.agg(F.count("*")).scalar()
    u = F.col("nunique")
    pick = (
        F.when(u <= 10, "one-hot").when(u <= 50, "label").when(u <= F.lit(0.9) * rows, "frequency").otherwise("drop")
    )
    return _distinct(df, string_columns(df, cols), distinct).withColumn("encoding", pick)


def _advice(frame: DataFrame, text: str, other: Column | None = None) -> DataFrame:
    return frame.select("column", F.lit(text).alias("advice"),
                        (other if other is not None else F.lit(None).cast("string")).alias("with_column"))


def transform_advice(df: DataFrame) -> DataFrame:
    """``(column, advice, with_column)``: log for |skew| > 1, interaction for |r| > 0.8, drop when constant or flat."""
    from sparkeda.operators.relate import pair_stats

    strong = pair_stats(df).where(F.abs("r") > 0.8).select(F.col("col1").alias("column"), "col2")
    return (
        _advice(moments(df).where(F.abs("skew") > 1), "log")
        .unionByName(_advice(strong, "interaction", F.col("col2")))
        .unionByName(_advice(constant_columns(df), "drop_constant"))
        .unionByName(_advice(low_variance(df), "drop_low_variance"))
    )


def cleaning_advice(df: DataFrame) -> DataFrame:
    """``(column, advice)`` from fixed rules.

    Missing above 50 %: drop_column; missing at all: impute_median (numeric) or impute_mode;
    placeholder tokens: replace_placeholders; constant: drop_constant; IQR outliers above 1 %
    of rows: cap_outliers; a text column that parses: convert_type.
    """
    from sparkeda.operators.quality import missing_by_column, placeholders
    from sparkeda.operators.stats import iqr_outliers

    numeric = numeric_columns(df)
    gaps = missing_by_column(df)
    fill = F.when(F.col("missing_pct") > 50, "drop_column").when(
        F.col("column").isin(numeric), "impute_median").otherwise("impute_mode")
    parts = [
        gaps.select("column", fill.alias("advice")),
        placeholders(df).select("column").distinct().withColumn("advice", F.lit("replace_placeholders")),
        constant_columns(df).select("column", F.lit("drop_constant").alias("advice")),
        iqr_outliers(df).where("pct > 1").select("column", F.lit("cap_outliers").alias("advice")),
        dtype_suggestions(df).where("suggestion != 'Convert to category'").select(
            "column", F.lit("convert_type").alias("advice")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
