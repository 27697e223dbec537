import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkeda.llm import near_dup as n
from tests.llm.conftest import article, make_docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 6))
def test_banded_alignment(a, b, k):
    assert n.within(a, b, k) == (distance(a, b) <= k)


def edited(text, seed, share):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
    return " ".join(words)


def test_sketch_sees_order_and_repeats():
    text = article(1)
    assert (n.sketch(text) == n.sketch(text.upper())).all()
    halves = text.split(" ")
    swapped = " ".join(halves[len(halves) // 2:] + halves[:len(halves) // 2])
    same = (n.sketch(text) == n.sketch(swapped)).mean()
    assert same < 0.8
    assert len(n.sketch("")) == 0 and len(n.sketch("one")) == n.SKETCHES
    assert (n.sketch("a b c d e " * 10) == n.sketch("a b c d e " * 30)).mean() < 1


def test_classes_against_all_pairs(spark):
    texts = [article(i, lines=4) for i in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(12):
        rows += [(100 + 10 * i + j, edited(texts[i], 31 * i + j, 0.05)) for j in range(i % 4)]
    passage = "\n" + article(99, lines=2)
    rows += [(500 + i, article(300 + i, lines=4) + passage) for i in range(30)]
    rows += [(700 + i, texts[3]) for i in range(20)]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if n.near(x, y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    got = {r.doc_id: r.class_id for r in n.classes(make_docs(spark, rows)).collect()}
    assert got == {i: root(i) for i, _ in rows}


def test_long_chains_of_links(spark):
    pairs = [((i, 0), (i + 1, 0)) for i in range(40)] + [((100, 0), (101, 0))]
    df = spark.createDataFrame(pairs, "a struct<d1: long, d2: long>, b struct<d1: long, d2: long>")
    got = {r.node.d1: r.label.d1 for r in n.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_odd_rows(odd, odd_rows):
    rows = n.classes(odd).collect()
    assert len(rows) == len(odd_rows)
    of = {r.doc_id: r.class_id for r in rows}
    assert of[4] == of[5] == 4 and of[1] == of[2] == 1 and of[3] == 3 and of[9] == 9 and of[8] == 8


def test_empty(none):
    assert n.classes(none).count() == 0


@pytest.mark.parametrize("share,least", [(0.02, 0.9), (0.05, 0.5)])
def test_near_copies_share_sketches(share, least):
    hits = [(n.sketch(article(i, lines=20)) == n.sketch(edited(article(i, lines=20), i, share))).any() for i in range(40)]
    assert sum(hits) / len(hits) >= least


def classes_by_all_pairs(rows, linked):
    """Classes by every pair of rows that is near and ``linked``, whatever the size of a key's group."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, (a, x) in enumerate(rows):
        for b, y in rows[:at]:
            if linked(a, b) and n.near(x, y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i, _ in rows}


def letters(pairs):
    """Pairs of form letters of 200 words with 150 common ones; a pair shares some of the rest, too."""
    rng = random.Random(7)
    own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    form = own(150)
    rows = []
    for i in range(pairs):
        common = own(13)
        at = rng.randrange(120)
        rows += [(2 * i + j, " ".join(form[:at] + common + own(37) + form[at:])) for j in range(2)]
    rng.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


def family(size):
    """Variants of one text with 13% of its words changed, each pair at the edge of near."""
    base = " ".join(f"v{i}" for i in range(200))
    return [(i, edited(base, i, 0.13)) for i in range(size)]


@pytest.mark.parametrize("rows", [letters(75), family(200)], ids=["letters", "family"])
def test_hot_keys_lose_no_pair(spark, rows):
    keys = {i: n.sketch(t) for i, t in rows}
    got = {r.doc_id: r.class_id for r in n.classes(make_docs(spark, rows)).collect()}
    least = classes_by_all_pairs(rows, lambda a, b: (keys[a] == keys[b]).any())
    most = classes_by_all_pairs(rows, lambda a, b: True)
    assert all(got[i] == got[least[i]] for i in got)             # no near pair that shares a key is apart
    assert all(most[i] == most[got[i]] for i in got)             # and all are linked by near pairs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 6))
def test_alignment_by_columns(a, b, k):
    assert n._within_by_columns(a, b, k) == (distance(a, b) <= k)


def test_many_edits_are_aligned_by_columns(monkeypatch):
    """The band takes as many steps as the square of the edits, so it is left after as many as there are words."""
    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(300)]
    b = [rng.choice("abcdefgh") if rng.random() < 0.3 else x for x in a]
    calls = []
    by_columns = n._within_by_columns
    monkeypatch.setattr(n, "_within_by_columns", lambda *args: calls.append(1) or by_columns(*args))
    far = distance(a, b)
    assert 20 < far < 100
    assert [n.within(a, b, k) for k in (far - 1, far, far + 1)] == [False, True, True]
    assert len(calls) >= 2


def test_only_rare_runs_become_rows(spark, monkeypatch):
    """Members of large groups have some hundred runs of words each; no table has a row for each of them."""
    rows = letters(75)
    made = []

    def counted(df):
        kept = keep(df)
        made.append(kept.count())
        return kept

    keep = n.keep
    monkeypatch.setattr(n, "keep", counted)
    assert n.classes(make_docs(spark, rows)).count() == len(rows)
    assert max(made) < sum(len(n.grams(t, 2)) for _, t in rows) / 2
