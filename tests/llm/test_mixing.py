import itertools
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkeda.llm import mixing
from tests.llm.conftest import make_docs


def words(rng, n):
    return " \t\n".join(str(rng.randint(0, 9)) for _ in range(n))


def aims(sizes):
    """Targets of sources (None: unnamed) in exact fractions, source by source in their order."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, budget, out = set(names), Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        level = budget / (sum(weight[s] for s in left) or 1)
        full = {s for s in left if 2 * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in left}
        for s in full:
            out[s] = Fraction(2 * sizes[s])
            budget -= out[s]
        left -= full


def checked(spark, rows):
    """rows: (doc_id, text, source)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in aims(sizes).items():
        assert target[s] == pytest.approx(float(t), rel=1e-12)
    return got, sizes, taken, target


def test_many_documents(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, min(int(rng.paretovariate(0.9) * 3), 3000)), rng.choice(["a"] * 6 + ["b", "c", "d", None, "", "ö"])) for i in range(3000)]
    got, _, taken, target = checked(spark, rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}


def test_nearest_in_small_sources(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(1, 40)), f"s{i % 40:02}") for i in range(160)]
    got, sizes, taken, target = checked(spark, rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r["size"])
    for s, held in by.items():
        wanted = int(target[s] + 0.5)
        base = wanted // sizes[s] * sizes[s]
        best = min(abs(base + sum(c) - wanted) for k in range(len(held) + 1) for c in itertools.combinations(held, k))
        assert abs(taken[s] - wanted) == best


def test_copies_and_one_length(spark):
    rows = [(i, "a b c", "hot") for i in range(5000)] + [(9, "x y", "hot")] * 700 + [(None, "x y", "hot")] * 30 + [(1, "q", "b"), (1, "q", "b"), (2, None, "c")]
    _, _, taken, target = checked(spark, rows)
    assert abs(taken["hot"] - target["hot"]) <= 1


def test_edges(spark, odd, odd_rows, none):
    assert mixing.mix(none).count() == 0
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(make_docs(spark, [(1, None), (2, " \n")])).agg({"taken": "sum", "target": "max"}).first()[:] == (0.0, 0)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 80))
def test_nearest_sum(stock, wanted):
    lengths, counts = (np.array(x, np.int64) for x in (list(stock), list(stock.values())))
    taken = mixing.nearest_sum(lengths, counts, wanted)
    assert ((0 <= taken) & (taken <= counts)).all()
    sums = {sum(n * x for n, x in zip(ns, stock)) for ns in itertools.product(*(range(c + 1) for c in stock.values()))}
    assert abs(int((taken * lengths).sum()) - wanted) == min(abs(x - wanted) for x in sums)


@pytest.mark.parametrize("top,n", [(300, 5000), (20_000, 4000), (900_000, 300), (5_000_000, 40)])
def test_fitted(top, n):
    rng = np.random.default_rng(top)
    lengths = np.unique(rng.integers(1, top, n))
    counts = rng.integers(1, 50, len(lengths))
    whole = int((lengths * counts).sum())
    for share in (0, 0.1, 0.5, 0.93, 0.9999):
        wanted = int(whole * share)
        taken = mixing.fitted(lengths, counts, wanted)
        assert ((0 <= taken) & (taken <= counts)).all()
        off = abs(int((taken * lengths).sum()) - wanted)
        assert off <= (1 if top < 10 ** 5 else max(top // 1000, wanted // 1000))     # a few long documents are a coarse stock
