"""Associations of text columns against their definitions, row by row."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from sparkeda.operators.association import associations

NUMBERS, TEXTS = ["x", "flat", "k", "gone"], ["a", "b", "key", "one"]


def table(spark, n=900, parts=5):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        a = rng.choice(["red", "green", "blue", "", None])
        b = {"red": "r", "green": "g"}.get(a, rng.choice(["r", "g", "lang " * 400, "é"]))
        x = rng.choice([float("nan"), None, 1e9 + rng.gauss({"red": 3, "green": 5}.get(a, 0), 1)])
        rows.append((x, 0.1, rng.randint(0, 3), None, a, b, f"key {i}" if i % 7 else None, "same"))
    return rows, spark.createDataFrame(rows, "x double, flat double, k int, gone double, a string, b string, key string, one string").repartition(parts)


def eta(pairs):
    groups = defaultdict(list)
    for t, x in pairs:
        groups[t].append(x)
    mean = math.fsum(x for _, x in pairs) / len(pairs)
    total = math.fsum((x - mean) ** 2 for _, x in pairs)
    between = math.fsum(len(g) * (math.fsum(g) / len(g) - mean) ** 2 for g in groups.values())
    return math.sqrt(between / total) if total > 1e-9 else None


def entropy(values):
    n = len(values)
    return -math.fsum(c / n * math.log(c / n) for c in Counter(values).values())


def test_against_definitions(spark):
    rows, df = table(spark)
    got = {(r["metric"], r["col1"], r["col2"]): r["value"] for r in associations(df).collect()}
    want = {}
    for t, text in enumerate(TEXTS, start=4):
        for j, number in enumerate(NUMBERS):
            pairs = [(r[t], r[j]) for r in rows if r[t] is not None and r[j] is not None and r[j] == r[j]]
            if pairs:
                want["correlation_ratio", text, number] = eta(pairs)
    for (i, a), (j, b) in permutations(enumerate(TEXTS, start=4), 2):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        h = entropy([x for x, _ in both])
        want["uncertainty", a, b] = (h + entropy([y for _, y in both]) - entropy(both)) / h if h > 1e-9 else None
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=6e-5)), k


def test_empty_and_narrow_tables(spark):
    _, df = table(spark, 5)
    assert associations(df.limit(0)).count() == 0
    assert associations(df.select(*NUMBERS)).count() == 0
    assert associations(df.select("a")).count() == 0
    assert {r["metric"] for r in associations(df.select("a", "b")).collect()} == {"uncertainty"}


def test_one_scan_and_no_text_in_an_exchange(lineitem):
    found = associations(lineitem, {})
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    assert "l_returnflag" not in "".join(line for line in final.splitlines() if " Exchange" in line)
