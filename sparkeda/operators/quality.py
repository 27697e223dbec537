"""Table overview, missing values, duplicates, placeholders and quality scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.digests import KEY, digest, thinned
from sparkeda.functions.kinds import (
    FIXED_WIDTHS, is_missing, kind_of, numeric_columns, percent, present, quoted, round_to,
)
from sparkeda.functions.longform import numeric_long, rows_from, string_long
from sparkeda.functions.ordering import exact_quantiles

# Texts that stand for "missing", in report order.
PLACEHOLDER_TOKENS = ["?", "NA", "N/A", "na", "-", "--", "null", "none", "unknown", ""]

AT_ONCE = 3
COUNTABLE = ("numeric", "categorical", "datetime")


def _countable(df: DataFrame, name: str) -> Column:
    """Something ``countDistinct`` can group on; maps go through JSON text."""
    return F.to_json(quoted(name)) if df.schema[name].dataType.typeName() == "map" else present(df, name)


def _distinct_key(df: DataFrame, name: str) -> Column:
    """What stands for a value where distinct ones are counted: of a text its digest, NULL where it is missing."""
    if kind_of(df.schema[name].dataType) != "categorical":
        return _countable(df, name)
    return F.when(quoted(name).isNotNull(), F.struct(*digest(quoted(name))))


def _row_totals(df: DataFrame) -> DataFrame:
    """``(d1, d2, copies)``: how often each row stands in the table, by its digest."""
    return df.select(*digest(*(_countable(df, c) for c in df.columns))).groupBy(*KEY).agg(F.count("*").alias("copies"))


def nunique(
    df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, at_once: int = AT_ONCE
) -> DataFrame:
    """``(column, nunique)``: distinct non-missing values per column.

    Exact by default: values are first reduced to one row each, so a hot value is one
    row after the map side. Counting k columns together makes k rows of k cells out of each
    row, so ``at_once`` columns are counted together; each part reads only its own columns.
    ``approx`` needs one pass and no wide shuffle.
    """
    names = list(cols or df.columns)
    count = F.approx_count_distinct if approx else F.countDistinct
    size = len(names) if approx else at_once
    parts = []
    for start in range(0, len(names), size):
        part = names[start:start + size]
        one = df.agg(*[count(_countable(df, c) if approx else _distinct_key(df, c)).alias(f"d{i}") for i, c in enumerate(part)])
        parts.append(rows_from(one, [[("column", F.lit(c)), ("nunique", F.col(f"d{i}"))] for i, c in enumerate(part)]))
    return reduce(DataFrame.unionByName, parts)


def _missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, rows, missing)`` for every column, in one pass."""
    one = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    return rows_from(one, [
        [("column", F.lit(c)), ("rows", F.col("rows")), ("missing", F.col(f"m{i}"))] for i, c in enumerate(cols)
    ])


def column_catalog(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, kind, non_null, nunique)`` per column."""
    facts = _missing(df, df.columns).join(nunique(df), "column")
    types = rows_from(df.limit(0).agg(F.count("*")), [[
        ("column", F.lit(f.name)), ("position", F.lit(i)),
        ("dtype", F.lit(f.dataType.simpleString())), ("kind", F.lit(kind_of(f.dataType))),
    ] for i, f in enumerate(df.schema)])
    return facts.join(F.broadcast(types), "column").select(
        "position", "column", "dtype", "kind",
        (F.col("rows") - F.col("missing")).alias("non_null"), "nunique",
    )


def estimated_bytes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, bytes)``: data bytes held by the present values of each column."""
    names = list(cols or df.columns)
    sizes = []
    for c in names:
        kind = df.schema[c].dataType.simpleString()
        if kind in FIXED_WIDTHS:
            sizes.append(F.count(quoted(c)) * F.lit(FIXED_WIDTHS[kind]))
        elif kind == "string":
            sizes.append(F.sum(F.octet_length(quoted(c))))
        elif kind.startswith("decimal"):
            sizes.append(F.count(quoted(c)) * F.lit(16))
        else:
            sizes.append(F.sum(F.octet_length(F.to_json(F.struct(quoted(c))))))
    one = df.agg(*[F.coalesce(s, F.lit(0)).cast("long").alias(f"b{i}") for i, s in enumerate(sizes)])
    return rows_from(one, [[("column", F.lit(c)), ("bytes", F.col(f"b{i}"))] for i, c in enumerate(names)])


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier row (missing equals missing)."""
    return _row_totals(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Each repeated row once, with its number of copies.

    Rows are counted by digest first; those whose digest repeats are read again and counted by their values.
    """
    if not any(kind_of(f.dataType) == "categorical" for f in df.schema):
        return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("copies")).where("copies > 1")
    row = F.struct(*[quoted(c).alias(c) for c in df.columns]).alias("row")
    keyed = df.select(row, *digest(*(_countable(df, c) for c in df.columns)))
    some = thinned(keyed, _row_totals(df).where("copies > 1")).select("row.*")
    return some.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicates_by_key(df: DataFrame, key: str) -> DataFrame:
    """Keys of rows whose other columns repeat a row with a smaller key, and that first key.

    The repeated contents are found by an aggregate, so no group is held in one task;
    the way back to the keys is an equi-join that adaptive execution splits on skew.
    """
    others = [c for c in df.columns if c != key]
    firsts = (
        df.groupBy(*[quoted(c) for c in others])
        .agg(F.min(quoted(key)).alias("first_key"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    left, right = df.alias("l"), firsts.alias("r")
    same = F.lit(True)
    for c in others:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return (
        left.join(right, same)
        .where(F.col(f"l.`{key}`") > F.col("r.first_key"))
        .select(F.col(f"l.`{key}`").alias(key), F.col("r.first_key"), F.col("r.copies"))
    )


def table_overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows, data bytes and columns per kind."""
    kinds = [kind_of(f.dataType) for f in df.schema]
    counted = _row_totals(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicates"),
    )
    size = estimated_bytes(df).agg(F.sum("bytes").alias("bytes"))
    return counted.select(
        "rows", F.lit(len(kinds)).cast("long").alias("cols"), "duplicates",
        size.scalar().alias("bytes"),
        *[F.lit(kinds.count(k)).cast("long").alias(f"{k}_cols") for k in (*COUNTABLE, "other")],
    )


def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, missing, missing_pct)`` of columns with a missing value, most first."""
    return (
        _missing(df, list(cols or df.columns)).where("missing > 0")
        .select("column", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct"))
        .orderBy(F.desc("missing"), "column")
    )


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: missing cells, all cells and completeness %."""
    return (
        _missing(df, df.columns)
        .agg(F.sum("missing").alias("missing_cells"), F.sum("rows").alias("total_cells"))
        .withColumn("completeness_pct", percent(F.col("total_cells") - F.col("missing_cells"), F.col("total_cells")))
    )


def complete_rows(df: DataFrame) -> DataFrame:
    """One row: rows without any missing value, and their share."""
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & ~is_missing(df, c)
    counted = df.agg(F.count("*").alias("rows"), F.count_if(whole).alias("complete_rows"))
    return counted.select("rows", "complete_rows", percent(F.col("complete_rows"), F.col("rows")).alias("complete_pct"))


def missing_matrix(df: DataFrame, key: str, cols: Sequence[str] | None = None, blocks: int = 50) -> DataFrame:
    """``(block, column, rows, missing_share)``: share missing per row block along a numeric key."""
    names = [c for c in (cols or df.columns) if c != key]
    k = quoted(key).cast("double")
    ends = df.agg(F.min(k).alias("lo"), F.max(k).alias("hi")).select(F.struct("lo", "hi")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    block = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide((k - lo) * F.lit(float(blocks)), hi - lo)), F.lit(blocks - 1))
    ).cast("long")
    one = df.groupBy(block.alias("block")).agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(names)
    ])
    return one.select("block", "rows", F.inline(entries)).select(
        "block", "column", "rows",
        round_to(F.col("missing").cast("double") / F.col("rows"), 4).alias("missing_share"),
    )


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(pattern, missing_cols, rows)``: which columns go missing together."""
    names = list(cols or df.columns)
    gone = F.concat_ws(",", *[F.when(is_missing(df, c), F.lit(c)) for c in names])
    many = sum((is_missing(df, c).cast("long") for c in names), F.lit(0).cast("long"))
    return df.groupBy(gone.alias("pattern"), many.alias("missing_cols")).agg(F.count("*").alias("rows"))


def placeholders(
    df: DataFrame, cols: Sequence[str] | None = None, tokens: Sequence[str] = PLACEHOLDER_TOKENS
) -> DataFrame:
    """``(column, token, count)``: cells equal to a token after trimming, ignoring case.

    A cell that matches two spellings of one token counts under both, as in the source data's
    report format; NULL is missing, not the text ``none``.
    """
    folded = sorted({t.lower() for t in tokens})
    whole = r"(?i)^\s*(" + "|".join(re.escape(t) for t in folded) + r")\s*$"     # fails early on long texts
    hits = (
        string_long(df, cols).where(F.col("value").rlike(whole))
        .select("column", F.lower(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("folded"))
        .where(F.col("folded").isin(folded))
        .groupBy("column", "folded").agg(F.count("*").alias("count"))
    )
    spellings = F.create_map(*[
        x for t in folded for x in (F.lit(t), F.array(*[F.lit(s) for s in tokens if s.lower() == t]))
    ])
    return hits.select("column", F.explode(spellings[F.col("folded")]).alias("token"), "count")


def invalid_zeros(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, zeros, zero_pct)``: zeros per numeric column, a common stand-in for missing."""
    rows = df.agg(F.count("*")).scalar()
    return (
        numeric_long(df, cols, keep_null=True).groupBy("column")
        .agg(F.count_if(F.col("value") == 0).alias("zeros"))
        .select("column", "zeros", percent(F.col("zeros"), rows).alias("zero_pct"))
    )


def impute(df: DataFrame, cols: Sequence[str] | None = None, how: str = "mean") -> DataFrame:
    """Numeric columns as doubles with missing values filled by the column's mean or median."""
    names = numeric_columns(df, cols)
    if how == "mean":
        one = df.agg(*[F.avg(present(df, c).cast("double")).alias(f"f{i}") for i, c in enumerate(names)])
    elif how == "median":
        middle = exact_quantiles(df, names, [0.5])
        one = middle.agg(*[
            F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"f{i}") for i, c in enumerate(names)
        ])
    else:
        raise ValueError(f"how must be 'mean' or 'median', not {how!r}")
    fills = one.select(F.struct("*")).scalar()
    filled = {
        c: F.coalesce(present(df, c).cast("double"), fills.getField(f"f{i}")) for i, c in enumerate(names)
    }
    return df.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])


def _score_inputs(df: DataFrame) -> DataFrame:
    """One row with the facts both scores use."""
    from sparkeda.operators.categorical import class_imbalance, high_cardinality
    from sparkeda.operators.stats import skewness

    cells = missing_totals(df).select("missing_cells", "total_cells")
    worst = _missing(df, df.columns).agg(F.max(percent(F.col("missing"), F.col("rows")))).scalar()
    skewed = skewness(df).agg(F.count_if(F.abs("skewness") > 1)).scalar()
    overview = table_overview(df).select("rows", "duplicates", "cols")
    shape = overview.select(F.struct("*")).scalar()
    return cells.select(
        (F.col("missing_cells") / F.greatest(F.col("total_cells"), F.lit(1))).alias("missing_share"),
        (shape["duplicates"] / F.greatest(shape["rows"], F.lit(1))).alias("duplicate_share"),
        (skewed / F.lit(max(1, len(numeric_columns(df))))).alias("skewed_share"),
        worst.alias("worst_missing_pct"),
        class_imbalance(df).agg(F.count("*")).scalar().alias("imbalanced"),
        high_cardinality(df).agg(F.count("*")).scalar().alias("high_card"),
        skewed.alias("skewed"), shape["cols"].alias("cols"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """One row: score 0-100, complexity and risk flags.

    score = 100 * (1 - 0.6 * missing share - 0.25 * duplicate share - 0.15 * skewed numeric share).
    Flags: imbalance (any imbalanced column), high_missing (a column above 20 % missing),
    high_cardinality (any), skewed_distribution (any |skew| > 1). Complexity counts the flags,
    one more above 20 columns: 0-1 low, 2-3 medium, more high.
    """
    facts = _score_inputs(df)
    flags = [
        ("imbalance", F.col("imbalanced") > 0), ("high_missing", F.col("worst_missing_pct") > 20),
        ("high_cardinality", F.col("high_card") > 0), ("skewed_distribution", F.col("skewed") > 0),
    ]
    raised = sum((f.cast("int") for _, f in flags), F.when(F.col("cols") > 20, 1).otherwise(0))
    penalty = 0.6 * F.col("missing_share") + 0.25 * F.col("duplicate_share") + 0.15 * F.col("skewed_share")
    return facts.select(
        round_to(100.0 * (1 - penalty), 1).alias("score"),
        F.when(raised <= 1, "low").when(raised <= 3, "medium").otherwise("high").alias("complexity"),
        F.concat_ws(",", *[F.when(f, F.lit(n)) for n, f in flags]).alias("risk_flags"),
    )


def readiness_score(df: DataFrame) -> DataFrame:
    """One row: readiness for modelling 0-100.

    0.7 * quality score + 30 * (1 - share of columns that are constant or leak a key)
    - the mean share of IQR outliers over numeric columns, in percent; never below 0.
    """
    from sparkeda.operators.categorical import constant_columns, leakage_columns
    from sparkeda.operators.stats import iqr_outliers

    risky = (
        constant_columns(df).select("column").union(leakage_columns(df).select("column")).distinct()
        .agg(F.count("*")).scalar()
    )
    outlying = iqr_outliers(df).agg(F.coalesce(F.sum("pct"), F.lit(0.0))).scalar()
    width = float(max(1, len(df.columns)))
    numeric = float(max(1, len(numeric_columns(df))))
    return quality_score(df).select(
        "score",
        round_to(F.greatest(
            F.lit(0.0),
            0.7 * F.col("score") + 30.0 * (1 - risky / F.lit(width)) - outlying / F.lit(numeric),
        ), 1).alias("readiness"),
    )
