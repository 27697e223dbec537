import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkeda.llm import divergence


def brute(rows):
    """rows: (text, lang, source); the result as a set of tuples."""
    groups, by_lang, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: [t for t, n in c.items() if n >= divergence.MIN_DOCS] for lang, c in docs.items()}
    for (lang, _), c in groups.items():
        by_lang[lang].update(c)

    def share(c, lang):
        total = sum(c[t] for t in kept[lang])
        return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    out = set()
    for (lang, source), c in groups.items():
        p, q = share(c, lang), share(by_lang[lang], lang)
        parts = {"pair": [(sum(abs(p[t] - o[t]) for t in kept[lang]), s) for (other, s), d in groups.items()
                          if other == lang and s != source for o in [share(d, lang)]],
                 "term": [(p[t] - q[t], t) for t in kept[lang] if c[t] > 0 and p[t] > q[t]]}
        for part, found in parts.items():
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < divergence.TOP}
    return out


def audited(spark, rows):
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def corpus(seed, n, sources, stock):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiouÄéбT漢") for _ in range(rng.randint(1, 4))) for _ in range(stock)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(("en", "de", None)), rng.choice(sources)
        rows.append((" 1".join(rng.choice(words) for _ in range(rng.randint(0, 60))), lang, source))
    return rows


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)         # several blocks, and tiles
    rows = corpus(1, 900, [*"abcdefghijk", None, "é"], 150)
    rows += [(None, "en", "silent"), ("rare", "fr", "x"), ("", "fr", "y"), ("Rare words", "fr", None), ("\x00 _`{~ 12", "en", "a")]
    assert audited(spark, rows) == brute(rows)


def test_repeats_hot_source_and_handed_on(spark, monkeypatch):
    rows = corpus(2, 300, ["hot", "hot", "hot", "b"], 30) * 2 + [("same words here", "it", "one")] * 40
    assert audited(spark, rows) == brute(rows)
    found = audited(spark, rows)
    assert {r[2] for r in found if r[0] == "it"} <= {"term"}     # a language's only source has no pair


def test_edges(spark, odd, none):
    assert divergence.audit(none).count() == 0
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert {tuple(r) for r in divergence.audit(odd).collect()} == brute(rows)
    many = odd.select("*").crossJoin(odd.sparkSession.range(31).select(F.col("id").alias("term")))     # a column named as in the result
    assert divergence.audit(many).filter("part = 'term'").count() <= divergence.TOP


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=200), st.sets(st.integers(0, 400), max_size=200))
def test_gallop_and_merge(a, b):
    left, right = (np.array(sorted(x), np.int64) for x in (a, b))
    assert divergence.gallop(left, right).tolist() == np.searchsorted(right, left).tolist()
    of_a, of_b = left * 7 + 3, right * 5 + 11
    x, y = dict(zip(left.tolist(), of_a.tolist())), dict(zip(right.tolist(), of_b.tolist()))
    value = sum(abs(x.get(t, 2) - y.get(t, 9)) for t in a | b)
    assert divergence.merged(left, of_a, 2, right, of_b, 9) == (value, len(a | b))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 ** 13), st.integers(0, 10 ** 14), st.integers(1, 10 ** 9))
def test_shares_are_exact(count, more, kept):
    total = count + more
    assert divergence.shares(np.array([count]), total, kept)[0] == 1 + 10 ** 9 * (count + 5) // (total + 5 * kept)


@pytest.mark.parametrize("count,total,kept", [(0, 0, 1), (10 ** 13, 8 * 10 ** 15, 10 ** 6), (7, 7, 1), (0, 0, 0)])
def test_share_column(spark, count, total, kept):
    got = spark.range(1).select(divergence.share(*(F.lit(x).cast("long") for x in (count, total, kept)))).first()[0]
    assert got == (1 + 10 ** 9 * (count + 5) // (total + 5 * kept) if kept else 1)
