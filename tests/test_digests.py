"""Counting texts by digest against counting the texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkeda.functions.digests import HEAD, leading_texts, text_totals
from sparkeda.operators import categorical, quality, stats


def table(spark, n=600):
    """Long texts with common beginnings, ties, nulls, and rows that differ only in where a null stands."""
    rng = random.Random(4)
    start = "the same long beginning of very many texts, longer than any head that goes along "
    stock = [start + c * rng.randint(0, 300) for c in "abcdefgh"] + ["", "short", "x" * (HEAD - 1), "x" * HEAD, "x" * (HEAD + 1), "é" * HEAD]
    rows = [(rng.choice([*stock, None]), rng.choice(["u", "v", None]), rng.choice([1.0, float("nan"), None])) for _ in range(n)]
    rows += [("only", None, 2.0), (None, "only", 2.0), (start + "z", start + "z", None), (start + "y", start + "y", None)]
    return rows, spark.createDataFrame(rows, "a string, b string, x double").repartition(7)


def counts(rows, at):
    return Counter(r[at] for r in rows if r[at] is not None)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_leading_texts(spark, k):
    rows, df = table(spark)
    got = {(r["column"], r["rank"]): (r["value"], r["count"]) for r in leading_texts(df, None, k).collect()}
    want = {}
    for at, name in enumerate("ab"):
        for i, (v, n) in enumerate(sorted(counts(rows, at).items(), key=lambda p: (-p[1], p[0].encode()))[:k]):
            want[name, i + 1] = (v, n)
    assert got == want


def test_all_different_with_one_beginning(spark):
    """Every text is a tie of the first place: the smallest is found, and no other is lost."""
    df = spark.range(500).select(F.concat(F.lit("y" * 200), F.lpad(F.col("id").cast("string"), 3, "0")).alias("t"))
    assert stats.describe_categorical(df).first()[1:] == (500, 500, "y" * 200 + "000", 1)
    assert [r["value"][-3:] for r in categorical.value_counts(df, k=3).orderBy("rank").collect()] == ["000", "001", "002"]


def test_counts_and_repeated_rows(spark):
    rows, df = table(spark)
    tidy = [(a, b, None if x != x else x) for a, b, x in rows]
    assert {r["column"]: r["nunique"] for r in quality.nunique(df).collect()} == {
        c: len({r[i] for r in tidy} - {None}) for i, c in enumerate("abx")}
    assert quality.duplicate_count(df).first()[0] == len(rows) - len(set(tidy))
    raw = Counter((a, b, "nan" if x is not None and x != x else x) for a, b, x in rows)
    got = Counter({(r["a"], r["b"], "nan" if r["x"] is not None and r["x"] != r["x"] else r["x"]): r["copies"] for r in quality.duplicate_rows(df).collect()})
    assert got == Counter({k: n for k, n in raw.items() if n > 1})
    assert quality.duplicate_rows(df.limit(0)).count() == 0 and quality.duplicate_count(df.limit(0)).first()[0] == 0


@pytest.mark.parametrize("work", [quality.nunique, quality.duplicate_count, text_totals])
def test_exchanges_hold_no_text(spark, work):
    _, df = table(spark)
    plan = work(df.select("a"))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "partial_" in line]
    assert sent and not any("keys=[a#" in line or "value#" in line.split("functions=")[0] for line in sent)
