"""Profile reports: several operators over one table, as one long result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial, reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.functions.kinds import kind_of, numeric_columns, percent, round_to, string_columns
from sparkeda.functions.longform import empty_like, held
from sparkeda.operators import categorical as cat
from sparkeda.operators import quality as qual
from sparkeda.operators import relate, stats
from sparkeda.operators.association import associations

LONG = "column string, metric string, value double, label string"
FACTS = ("missing", "distinct", "moments", "spread", "pairs")
T = TypeVar("T")


def _text(label: Column | None) -> Column:
    return (label if label is not None else F.lit(None)).cast("string")


def melt(frame: DataFrame, metrics: Mapping[str, str], column: Column | None = None) -> DataFrame:
    """``(column, metric, value, label)``: the given columns of ``frame`` as rows.

    ``metrics`` maps a column of ``frame`` to ``'value'`` or ``'label'``.
    """
    name = F.col("column") if column is None else column
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            (F.col(m).cast("double") if part == "value" else F.lit(None).cast("double")).alias("value"),
            (F.col(m).cast("string") if part == "label" else F.lit(None).cast("string")).alias("label"))
        for m, part in metrics.items()
    ]
    return frame.select(name.cast("string").alias("column"), F.inline(F.array(*cells)))


def _values(frame: DataFrame, *names: str, column: Column | None = None) -> DataFrame:
    return melt(frame, {n: "value" for n in names}, column)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)




def concurrently(df: DataFrame, works: Sequence[Callable[[], T]]) -> list[T | Exception]:
    """Results, or the exceptions raised, of works run as concurrent jobs, which fill cores a single job leaves idle."""
    def attempt(work: Callable[[], T]) -> T | Exception:
        try:
            return work()
        except Exception as exc:  # noqa: BLE001 - the caller decides
            return exc

    with ThreadPoolExecutor(max(1, len(works))) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(attempt), works))


class Facts:
    """A table and the schema-sized statistics several sections start from.

    Each is computed on first use, in one scan, and held; a report then scans the table once per
    kind of statistic instead of once per operator.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def gather(self, *names: str) -> Facts:
        """Compute several statistics at once; one that fails is tried again where it is used."""
        concurrently(self.df, [partial(getattr, self, n) for n in names])
        return self

    @cached_property
    def missing(self) -> DataFrame:
        return held(qual._missing(self.df, self.df.columns))

    @property
    def rows(self) -> DataFrame:
        return self.missing.agg(F.max("rows"))

    @cached_property
    def distinct(self) -> DataFrame:
        return held(qual.nunique(self.df))

    @cached_property
    def moments(self) -> DataFrame:
        return held(stats.moments(self.df))

    @cached_property
    def spread(self) -> DataFrame:
        return held(stats.exact_quantiles(self.df, None, stats.QUARTILES))

    @cached_property
    def pairs(self) -> DataFrame:
        return held(relate.pair_stats(self.df))


def _type_rows(df: DataFrame) -> DataFrame:
    types: dict[str, int] = {}
    for f in df.schema:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    rows = [("*", f"columns_{t}", float(k), None) for t, k in types.items()]
    return df.sparkSession.createDataFrame(rows, LONG)


def _dtype_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f.name, "dtype", None, f.dataType.simpleString()) for f in df.schema], LONG)


def _overview(facts: Facts) -> DataFrame:
    df = facts.df
    table = _values(qual.table_overview(df), "rows", "cols", "duplicates", "bytes", column=F.lit("*"))
    return stack([table, _type_rows(df), _dtype_rows(df)])


def _quality(facts: Facts) -> DataFrame:
    df = facts.df
    tokens = qual.placeholders(df).select(
        "column", F.concat(F.lit("placeholder "), F.col("token")).alias("metric"),
        F.col("count").cast("double").alias("value"), _text(None).alias("label"))
    gaps = facts.missing.where("missing > 0").select(
        "column", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct"))
    total = facts.missing.agg(F.sum("missing").alias("missing_cells"), F.sum("rows").alias("total_cells")).withColumn(
        "completeness_pct", percent(F.col("total_cells") - F.col("missing_cells"), F.col("total_cells")))
    return stack([
        _values(gaps, "missing", "missing_pct"),
        _values(total, "missing_cells", "total_cells", "completeness_pct", column=F.lit("*")),
        _values(qual.complete_rows(df), "complete_rows", "complete_pct", column=F.lit("*")),
        tokens,
    ])


SHAPE = ("skewness", "kurtosis", "variance", "highly_skewed", "heavy_tailed")
DESCRIBED = ("count", "mean", "std", "min", *(f"q{int(p * 100)}" for p in stats.QUARTILES), "max")


def _statistics(facts: Facts, more: Sequence[str] = ()) -> DataFrame:
    """The description of each numeric column from its moments and quartiles, and ``more`` about its shape."""
    every = facts.moments.join(facts.spread.drop("nn"), "column", "left").select(
        "column", F.col("nn").alias("count"), *[round_to(F.col(c), 4).alias(c) for c in ("mean", "std", "min")],
        *[round_to(F.col("q")[i], 4).alias(f"q{int(p * 100)}") for i, p in enumerate(stats.QUARTILES)],
        round_to(F.col("max"), 4).alias("max"), round_to(F.col("skew"), 3).alias("skewness"),
        round_to(F.col("kurt"), 3).alias("kurtosis"), round_to(F.col("var"), 3).alias("variance"),
        (F.abs("skew") > 1).cast("double").alias("highly_skewed"),
        (F.abs("kurt") > 3).cast("double").alias("heavy_tailed"))
    return _values(every, *DESCRIBED, *more)


def _outliers(facts: Facts) -> DataFrame:
    both = held(stats.outlier_counts(facts.df, facts.spread, facts.moments, facts.rows))
    return stack([
        _values(both.where("iqr_outliers > 0"), "iqr_outliers", "iqr_pct", "lower", "upper"),
        _values(both.where("z_outliers > 0"), "z_outliers", "z_pct"),
    ])


def _correlation(facts: Facts) -> DataFrame:
    both = facts.pairs.select(F.col("col1").alias("column"), F.col("col2").alias("label"), F.col("r"))
    matrix = both.select("column", F.lit("corr").alias("metric"), round_to(F.col("r"), 3).alias("value"), "label")
    high = both.where(F.abs("r") > 0.8).select(
        "column", F.lit("high_corr").alias("metric"), round_to(F.abs("r"), 3).alias("value"), "label")
    return stack([matrix, high])


def _categorical(facts: Facts) -> DataFrame:
    df = facts.df
    names = string_columns(df)
    if not names:
        return empty_like(df, LONG)
    top = cat.top_values(cat.value_totals(df), 10).select(
        "column", F.lit("value_count").alias("metric"), F.col("count").cast("double").alias("value"),
        F.col("value").alias("label"))
    balance = cat.class_balance_all(df)
    return stack([
        _values(facts.distinct.where(F.col("column").isin(names)), "nunique"), top,
        melt(balance, {"imbalance_ratio": "value", "min_class": "label", "max_class": "label"}),
    ])


def _flat_or_constant(facts: Facts) -> list[DataFrame]:
    df = facts.df
    return [
        _values(cat.constant_columns(df, facts.distinct).withColumnRenamed("nunique", "constant"), "constant"),
        _values(cat.low_variance(df, moment=facts.moments).withColumnRenamed("variance", "low_variance"),
                "low_variance"),
    ]


def _risk(facts: Facts) -> DataFrame:
    df = facts.df
    skewed = facts.moments.where(F.abs("skew") > 1).select("column", F.lit("log").alias("transform"))
    leaks = cat.leakage_columns(df, distinct=facts.distinct).withColumnRenamed("unique_pct", "leakage_pct")
    return stack([
        _values(leaks, "leakage_pct"), *_flat_or_constant(facts), melt(skewed, {"transform": "label"}),
        melt(cat.encoding_advice(df, distinct=facts.distinct), {"encoding": "label"}),
    ])


# The default tasks in priority order.
TASKS: dict[str, Callable[[Facts], DataFrame]] = {
    "overview": _overview, "quality": _quality, "statistics": partial(_statistics, more=SHAPE), "outliers": _outliers,
    "correlation": _correlation, "categorical": _categorical, "risk": _risk,
}


def enterprise_eda(
    df: DataFrame, tasks: Mapping[str, Callable[[Facts], DataFrame]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All tasks in order: ``(results, status)``.

    results is ``(task, column, metric, value, label)``, status ``(priority, task, status, error)``.
    Each task is run and its result, as long as the schema, held; a task that fails while running
    leaves only an error in its status row and the others stand.
    """
    def run(facts: Facts, name: str, build: Callable[[Facts], DataFrame]) -> DataFrame:
        return held(build(facts).select(F.lit(name).alias("task"), "column", "metric", "value", "label"))

    chosen = dict(tasks or TASKS)
    facts = Facts(df).gather(*FACTS)
    results = concurrently(df, [partial(run, facts, name, build) for name, build in chosen.items()])
    done = [r for r in results if not isinstance(r, Exception)]
    status = [
        (i, name, "failed" if isinstance(r, Exception) else "ok", str(r)[:300] if isinstance(r, Exception) else None)
        for i, (name, r) in enumerate(zip(chosen, results), start=1)
    ]
    states = df.sparkSession.createDataFrame(status, "priority long, task string, status string, error string")
    return (stack(done) if done else empty_like(df, f"task string, {LONG}")), states


def deep_eda(df: DataFrame) -> DataFrame:
    """``(section, column, metric, value, label)``: overview, cleaning, summary and insights."""
    facts = Facts(df).gather(*FACTS)
    return _all_held(facts, _deep_parts(facts), "section")


def _all_held(facts: Facts, parts: list[tuple[str | None, Callable[[], DataFrame]]], named: str | None) -> DataFrame:
    """The parts, computed at once and stacked, each with its name in the column ``named``."""
    def run(name: str | None, build: Callable[[], DataFrame]) -> DataFrame:
        first = [F.lit(name).alias(named)] if named else []
        return held(build().select(*first, "column", "metric", "value", "label"))

    results = concurrently(facts.df, [partial(run, *p) for p in parts])
    for r in results:
        if isinstance(r, Exception):
            raise r
    return stack(results)


def _normality(df: DataFrame) -> DataFrame:
    """The normality test that fits each column's size, with its name."""
    tests = stats.normality_shapiro(df).withColumnsRenamed({
        "statistic": "normality_statistic", "p_value": "normality_p", "method": "normality_test"})
    return melt(tests, {"normality_statistic": "value", "normality_p": "value", "normality_test": "label"})


def _deep_parts(facts: Facts) -> list[tuple[str | None, Callable[[], DataFrame]]]:
    df = facts.df
    parts: list[tuple[str | None, Callable[[], DataFrame]]] = [
        ("overview", partial(_overview, facts)), ("cleaning", partial(_quality, facts)),
        ("summary", partial(_statistics, facts, SHAPE)), ("summary", partial(_outliers, facts)),
        ("summary", partial(_correlation, facts)), ("summary", lambda: _normality(df)), ("insights", lambda: stack(_flat_or_constant(facts))),
    ]
    if string_columns(df):
        parts += [
            ("summary", lambda: melt(stats.describe_categorical(df), {
                "count": "value", "unique": "value", "freq": "value", "top": "label"})),
            ("insights", lambda: _values(
                cat.high_cardinality(df, distinct=facts.distinct).withColumnRenamed("nunique", "high_cardinality"),
                "high_cardinality")),
            ("insights", lambda: melt(cat.class_imbalance(df), {"imbalance_ratio": "value", "distribution": "label"})),
            ("insights", lambda: melt(cat.dtype_suggestions(df, distinct=facts.distinct), {"suggestion": "label"})),
        ]
    return parts


def profile_context(df: DataFrame) -> DataFrame:
    """``(column, metric, value, label)``: shape, kinds, missing counts and shares, distinct counts, description."""
    kinds = df.sparkSession.createDataFrame([(f.name, "kind", None, kind_of(f.dataType)) for f in df.schema], LONG)
    facts = Facts(df).gather("missing", "distinct", "moments", "spread")
    gaps = facts.missing.withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))
    shape = gaps.agg(F.max("rows").alias("rows"), F.count("*").alias("cols"))
    texts = string_columns(df)
    return _all_held(facts, [
        (None, lambda: stack([_values(shape, "rows", "cols", column=F.lit("*")), _dtype_rows(df), kinds])),
        (None, lambda: stack([_values(gaps, "missing", "missing_pct"), _values(facts.distinct, "nunique")])),
        (None, lambda: _statistics(facts)),
        (None, lambda: melt(stats.describe_categorical(df, texts), {
            "count": "value", "unique": "value", "top": "label", "freq": "value"})),
    ], None)


def data_report(df: DataFrame) -> DataFrame:
    """``(column, metric, value, label)`` of the chat report: shape, size, types, missing, numbers, first texts."""
    facts = Facts(df).gather("missing", "moments", "spread")
    shape = facts.missing.agg(F.max("rows").alias("rows"), F.count("*").alias("cols"))
    gaps = facts.missing.where("missing > 0").withColumn(
        "missing_pct", percent(F.col("missing"), F.col("rows"), 1))
    return _all_held(facts, [
        (None, lambda: stack([_values(shape, "rows", "cols", column=F.lit("*")), _type_rows(df)])),
        (None, lambda: _values(qual.estimated_bytes(df).agg(F.sum("bytes").alias("bytes")), "bytes",
                               column=F.lit("*"))),
        (None, lambda: stack([_values(gaps, "missing", "missing_pct"), _statistics(facts)])),
        (None, lambda: _values(cat.cardinality_summary(df), "nunique")),
    ], None)


def report_lines(report: DataFrame, title: str, columns: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """``(line_no, line)`` Markdown lines of a long report below its title, one per finding, ``n/a`` where it has no value.

    Lines follow the order of ``parts`` (by default that of the tasks), the table as a whole before its ``columns`` in their
    order, then the metric.
    """
    def place(names: Sequence[str], of: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), of)
        return F.when(at > 0, at).otherwise(len(names) + 1)

    shown = F.coalesce("label", F.round("value", 4).cast("string"), F.lit("n/a"))
    part = next((c for c in ("task", "section") if c in report.columns), None)
    head = F.concat(F.lit("- "), F.col(part), F.lit(" ")) if part else F.lit("- ")
    section = place(parts or list(TASKS), F.col(part)) if part else F.lit(0)
    number = F.lit(2) + section * (len(columns) + 3) + place(["*", *columns], F.col("column"))
    body = report.select(
        number.cast("long").alias("line_no"),
        F.concat(head, F.lit("**"), F.col("column"), F.lit("** "), F.col("metric"), F.lit(": "), shown).alias("line"))
    return report.sparkSession.createDataFrame([(1, f"## {title}")], "line_no long, line string").unionByName(body)


def column_report(df: DataFrame) -> DataFrame:
    """``(column, metric, value, label)``: every column's profile, then its associations with the others.

    Associations are Pearson r between numbers, the correlation ratio of a number by a text
    column, and the uncertainty coefficient between text columns.
    """
    facts = Facts(df).gather(*FACTS)
    return _all_held(facts, _column_parts(facts), None)


def _column_parts(facts: Facts) -> list[tuple[str | None, Callable[[], DataFrame]]]:
    df = facts.df

    def linked(frame: DataFrame, metric: str) -> DataFrame:
        return frame.select(F.col("col1").alias("column"), F.lit(metric).alias("metric"), "value",
                            F.col("col2").alias("label"))

    gaps = facts.missing.withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))
    r = facts.pairs.select("col1", "col2", round_to(F.col("r"), 3).alias("value"))
    parts: list[tuple[str | None, Callable[[], DataFrame]]] = [
        (None, lambda: stack([_values(gaps, "rows", "missing", "missing_pct"), _values(facts.distinct, "nunique")])),
        (None, lambda: linked(r, "pearson")),
        (None, lambda: associations(df, {m["column"]: m["mean"] for m in facts.moments.collect()}).select(
            F.col("col1").alias("column"), "metric", "value", F.col("col2").alias("label"))),
    ]
    if numeric_columns(df):
        parts.append((None, partial(_statistics, facts, SHAPE)))
    if string_columns(df):
        parts.append((None, lambda: melt(stats.describe_categorical(df), {"top": "label", "freq": "value"})))
    return parts
