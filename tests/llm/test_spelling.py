import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkeda.llm import spelling
from tests.llm.conftest import article, make_docs


def counted(rows):
    """Words and their occurrences in (doc_id, text) rows, straight from the definition."""
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(words):
    """word: near words, through the words without one letter."""
    by, out = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by[w[:i] + w[i + 1:], len(w), i].add(w)
            if w[:i] + w[i + 1:] in out:
                out[w].add(w[:i] + w[i + 1:])
                out[w[:i] + w[i + 1:]].add(w)
    for group in by.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute(rows):
    n = counted(rows)
    links = near(n)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def variant_text(seed, n, letters="aeinrstéß"):
    """Words with slips and chains of ever rarer spellings."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 14))) for _ in range(60)]
    out = []
    for _ in range(n):
        w = stock[min(int(rng.expovariate(0.15)), 59)]
        while rng.random() < 0.25:
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]))
        out.append(w.title() if rng.random() < 0.1 else w)
    return " ".join(out)


def test_brute_force(spark):
    rows = [(i, variant_text(i % 3, 400) + f" X{i} " + article(i)) for i in range(60)]
    rows += [(None, variant_text(0, 50)), (None, None), (7, ""), (8, "İSTANBULLU " * 3 + "漢字abcdefgh×÷xyz " * 2)]
    got = rows_of(spelling.variants(make_docs(spark, rows)))
    assert got == brute(rows)
    assert any(f is not None and r != f for _, f, r, *_ in got)      # a chain of two steps at least


def test_hot_lists_are_split(spark):
    """Hundreds of words that differ in one or two places only: all lists are long."""
    rng = random.Random(5)
    words = {"".join("abcdefghijklmnopqrstuvwxyz"[rng.randrange(26)] if i in (4, 7) else c for i, c in enumerate("vergleichbarkeiten")) for _ in range(600)}
    words |= {w[:9] + w[10:] for w in list(words)[:80]}
    found = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    grams = spelling.dictionary(found)
    for limit in (4, 64):
        got = {(r["a"]["word"], r["b"]["word"]) for r in spelling.near_pairs(found, grams, limit).collect()}
        assert got == {(a, b) for a, others in near(words).items() for b in others if a < b}


def test_edges(spark, odd, odd_rows, none):
    assert spelling.variants(none).count() == 0
    assert rows_of(spelling.variants(odd)) == brute(odd_rows)
    with pytest.raises(ValueError):
        spelling.variants(odd, least=4)


WORD = st.text("abc", min_size=5, max_size=15)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=30), st.data())
def test_signatures_meet(stock, data):
    """Every edit of a word leaves a list in common, whatever the dictionary."""
    word = data.draw(st.sampled_from(stock))
    i = data.draw(st.integers(0, len(word) - 1))
    c = data.draw(st.sampled_from("abcd"))
    other = data.draw(st.sampled_from([word[:i] + c + word[i + 1:], word[:i] + c + word[i:], word + c]))
    counts = Counter(w[j:j + q] for w in {*stock, word, other} for q in range(2, spelling.LONGEST + 1) for j in range(len(w) - q + 1))
    above = data.draw(st.integers(0, 6))
    frequent = frozenset(g for g, n in counts.items() if n > above and len(g) < spelling.LONGEST)
    kept = {g: n for g, n in counts.items() if len(g) == 2 or g[:-1] in frequent}
    ending = {}
    for g in kept:
        for k in range(1, len(g)):
            ending[g[k:]] = min(len(g), ending.get(g[k:], 99))
    grams = spelling.Grams({g: r for r, g in enumerate(sorted(kept, key=lambda g: (kept[g], g)))}, frequent, ending)
    if len(other) == len(word):
        assert other == word or set(spelling.signature(word, grams, False)) & set(spelling.signature(other, grams, False))
    else:
        short = {(g, p + more) for g, p in spelling.signature(word, grams, True) for more in (0, 1)}
        assert short & set(spelling.signature(other, grams, False))
