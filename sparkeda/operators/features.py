"""Feature engineering as projections over one-row statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import clean, numeric_columns, present, quoted
from sparkeda.functions.ordering import exact_quantiles, running_totals
from sparkeda.operators.basics import dropna_rows
from sparkeda.operators.categorical import low_variance
from sparkeda.operators.relate import high_corr_pairs
from sparkeda.operators.stats import moments


def _number(df: DataFrame, c: str) -> Column:
    return present(df, c).cast("double")


def _skewed(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    """Names of columns with |skew| > 1, at most as many rows as the schema has columns."""
    found = {r["column"] for r in moments(df, cols).where(F.abs("skew") > 1).select("column").collect()}
    return [c for c in numeric_columns(df, cols) if c in found]


def log_transform(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Adds ``<c>_log`` = ln(1 + c); without ``cols``, for the columns with |skew| > 1. NULL at or below -1."""
    names = list(cols) if cols is not None else _skewed(df, None)
    return df.withColumns({f"{c}_log": F.when(_number(df, c) > -1, F.log1p(_number(df, c))) for c in names})


def power_transform(df: DataFrame, cols: Sequence[str], power: float = 0.5) -> DataFrame:
    """Adds ``<c>_pow`` = sign(c) * |c| ^ power, the signed root by default."""
    return df.withColumns({
        f"{c}_pow": F.signum(_number(df, c)) * F.pow(F.abs(_number(df, c)), F.lit(power)) for c in cols})


def min_max_scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Adds ``<c>_scaled`` in [0, 1]; 0 for a constant column."""
    names = numeric_columns(df, cols)
    one = df.agg(*[f(_number(df, c)).alias(f"{n}{i}") for i, c in enumerate(names)
                   for n, f in (("lo", F.min), ("hi", F.max))])
    ends = one.select(F.struct("*")).scalar()

    def scaled(i: int, c: str) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        x = _number(df, c)
        return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)))

    return df.withColumns({f"{c}_scaled": scaled(i, c) for i, c in enumerate(names)})


def zscore_scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Adds ``<c>_z`` = (c - mean) / population deviation; 0 for a constant column."""
    names = numeric_columns(df, cols)
    one = df.agg(*[f(_number(df, c)).alias(f"{n}{i}") for i, c in enumerate(names)
                   for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scale = one.select(F.struct("*")).scalar()

    def z(i: int, c: str) -> Column:
        x = _number(df, c)
        return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - scale[f"m{i}"], scale[f"s{i}"]), F.lit(0.0)))

    return df.withColumns({f"{c}_z": z(i, c) for i, c in enumerate(names)})


def bin_column(
    df: DataFrame, col: str, edges: Sequence[float] | None = None, quantiles: int | None = None
) -> DataFrame:
    """Adds ``<col>_bin``: how many edges are <= the value, with given edges or the inner quantiles."""
    if edges is None:
        if not quantiles or quantiles < 2:
            raise ValueError("give edges, or quantiles >= 2")
        found = exact_quantiles(df, [col], [i / quantiles for i in range(1, quantiles)]).collect()
        edges = list(found[0]["q"]) if found else []      # quantiles - 1 numbers
    x = _number(df, col)
    place = sum((F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(f"{col}_bin", F.when(x.isNotNull(), place).cast("long"))


def ratio_feature(df: DataFrame, top: str, bottom: str, name: str | None = None, power: int = 1) -> DataFrame:
    """Adds top / bottom ^ power, NULL where the divisor is zero."""
    ratio = F.try_divide(_number(df, top), F.pow(_number(df, bottom), F.lit(float(power))))
    return df.withColumn(name or f"{top}_per_{bottom}", ratio)


def interaction_terms(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None, limit: float = 0.8) -> DataFrame:
    """Adds ``<a>_x_<b>`` products; without ``pairs``, for the pairs with |r| above ``limit``."""
    if pairs is None:
        pairs = [(r["col1"], r["col2"]) for r in high_corr_pairs(df, None, limit).select("col1", "col2").collect()]
    return df.withColumns({f"{a}_x_{b}": _number(df, a) * _number(df, b) for a, b in pairs}) if pairs else df


def one_hot(df: DataFrame, cols: Sequence[str], most: int | None = None) -> DataFrame:
    """Replaces each column by 0/1 columns ``<c>_<value>``, one per value, none dropped.

    The values name the output columns, so they come to the driver as the schema does; a caller who wants no more than
    ``most`` columns says so and gets an error beyond. ``training.prepare_features`` encodes to a vector instead.
    """
    out: list[Column] = [quoted(c) for c in df.columns if c not in cols]
    for c in cols:
        values = df.select(quoted(c).alias("v")).where("v IS NOT NULL").distinct().orderBy("v")
        values = (values if most is None else values.limit(most + 1)).collect()
        if most is not None and len(values) > most:
            raise ValueError(f"{c} has more than {most} values; encode it to a vector instead")
        out += [F.coalesce((quoted(c) == F.lit(r["v"])).cast("int"), F.lit(0)).alias(f"{c}_{r['v']}") for r in values]
    return df.select(*out)


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """Adds ``<col>_code``: position of the value among the sorted distinct values, from 0.

    Positions are running totals over the distinct values, cut into ranges when there are many,
    and come back through an equi-join that adaptive execution broadcasts when the values are
    few and splits when one of them is hot.
    """
    values = df.select(F.lit(col).alias("column"), quoted(col).alias("value")).where("value IS NOT NULL").distinct()
    coded = running_totals(values.withColumn("one", F.lit(1).cast("long")), ["one"]).select(
        F.col("value").alias("__value"), F.col("one_before").alias(f"{col}_code"))
    return df.join(coded, quoted(col) == F.col("__value"), "left").drop("__value")


def pca(df: DataFrame, k: int, cols: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus ``pc1 .. pck``: principal components of the standardised complete rows."""
    names = numeric_columns(df, cols)
    whole = clean(dropna_rows(df, names), [*keep, *[c for c in names if c not in keep]])
    scaled = zscore_scale(whole, names)
    vectors = VectorAssembler(inputCols=[f"{c}_z" for c in names], outputCol="features").transform(scaled)
    fitted = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    parts = fitted.transform(vectors).select(*[quoted(c) for c in keep], vector_to_array("pcs").alias("pcs"))
    return parts.select(*[quoted(c) for c in keep], *[F.col("pcs")[i].alias(f"pc{i + 1}") for i in range(k)])


def drop_redundant(df: DataFrame, limit: float = 0.8, least_variance: float = 0.01) -> DataFrame:
    """Drops flat numeric columns, and the later column of each strongly correlated pair still kept."""
    gone = {r["column"] for r in low_variance(df, None, least_variance).collect()}
    position = {c: i for i, c in enumerate(df.columns)}
    pairs = [(r["col1"], r["col2"]) for r in high_corr_pairs(df, None, limit).collect()]
    for a, b in sorted(pairs, key=lambda p: (position[p[0]], position[p[1]])):
        if a not in gone and b not in gone:
            gone.add(b)
    return df.drop(*gone)
