import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkeda.llm import lm_score as m
from sparkeda.llm.shared import vocabulary
from tests.llm.conftest import article, make_docs

PATH = vocabulary("piece_bpe_32k.model")
LATTICE = m.Lattice(PATH)


def every_way(codes, logp):
    """Sum over all segmentations, one by one."""
    if not codes:
        return 1.0
    total = 0.0
    for k in range(1, len(codes) + 1):
        piece = None if m.LITERAL in codes[:k] else LATTICE.piece.get("".join(map(chr, codes[:k])))
        if piece is not None:
            total += math.exp(logp[piece]) * every_way(codes[k:], logp)
        elif k == 1:
            total += math.exp(logp[LATTICE._spelt(codes[0])].sum()) * every_way(codes[1:], logp)
    return total


@pytest.mark.parametrize("word", ["the", "a", "nation", "éé日", "🙂x", "▁a", "xyz!"])
def test_marginal_is_the_sum_over_segmentations(word):
    codes = [m.START] + [m.LITERAL if c == "▁" else ord(c) for c in word]
    want = math.log(every_way(codes, LATTICE.first))
    total, long = np.zeros(LATTICE.size), np.zeros(LATTICE.size)
    assert LATTICE.marginals([word.encode()], LATTICE.first, np.array([2.0]), total)[0] == pytest.approx(want)
    assert LATTICE._long(codes, LATTICE.first, 2.0, long) == pytest.approx(want)
    np.testing.assert_allclose(total, long, atol=1e-9)


def test_long_words():
    for n in (47, 48, 49, 300, 5000):
        value = LATTICE.marginals([b"ab" * n], LATTICE.first)[0]
        assert -40 * n < value < 0


def brute(rows):
    learns = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in rows if i is not None}
    c, ends = Counter(), 0
    for i, t, *_ in rows:
        if learns.get(i, zlib.crc32(b"") % 7 != 2):
            c.update(m.words(t or ""))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    return c, ends, n, v


def check(spark, rows):
    c, ends, n, v = brute(rows)
    got = m.score_held_out(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        w = m.words(t or "")
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want[i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(base, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    return got, c, ends, n, v


def test_base_and_known(spark, odd_rows):
    check(spark, odd_rows)


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT", 20)
    rows = [(i, article(i)) for i in range(60)] + [(5, article(5))]
    few, *_ = check(spark, rows)
    monkeypatch.setattr(m, "HOT", 1 << 15)
    many, *_ = check(spark, rows)
    near = {(r.doc_id, round(r.score, 6)) for r in few}
    assert near == {(r.doc_id, round(r.score, 6)) for r in many}


def test_score_is_a_distribution_over_tokens(spark):
    """What single-word texts and the empty text get, less the end, adds up to less than 1."""
    rows = [(i, article(i)) for i in range(40)]
    got, c, ends, n, v = check(spark, [*rows, *((1000 + i, w.decode()) for i, w in enumerate(sorted({w for _, t in rows for w in m.words(t)}))), (999, "")])
    by = {r.doc_id: r.score for r in got}
    mass = sum(10 ** (by[i] - by[999]) for i in by if i >= 1000) + 10 ** by[999]
    assert 0.5 < mass <= 1.0001


def test_whole_word_model_is_beaten_on_unseen_text_without_its_gift(spark):
    """Spelling out unseen words costs more than the base's flat rate, but text like the training text beats scrambled text."""
    rows = [(i, article(i)) for i in range(80)] + [(500, article(700)), (501, "".join(reversed(article(700))))]
    got = {r.doc_id: r.score for r in m.score_held_out(make_docs(spark, rows)).collect()}
    assert got[500] > got[501]


def test_empty_and_nothing_learned(spark, none):
    assert m.score_held_out(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = m.score_held_out(make_docs(spark, [(held, "a word")])).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.n_tokens == 3 and row.score < 0


@pytest.mark.parametrize("least", [1e-250, 1.1])
def test_products_and_sums_of_logarithms_agree(monkeypatch, least):
    """Whether a word's probabilities are multiplied or go through logarithms; words beyond the range of doubles are not lost."""
    found = [b"the", "schön".encode(), "▁x▁".encode(), "\U000e0001漢".encode(), b"ab" * 20, "\U000e0001".encode() * 40, b"q" * 90, b"\xff\xfe"]
    counts = np.arange(1.0, len(found) + 1)
    monkeypatch.setattr(m, "LEAST", least)
    total, want = np.zeros(LATTICE.size), np.zeros(LATTICE.size)
    got = LATTICE.marginals(found, LATTICE.first, counts, total)
    for w, n, value in zip(found, counts, got):
        codes = [m.START, *(m.LITERAL if c == "▁" else ord(c) for c in w.decode("utf-8", "replace"))]
        assert LATTICE._long(codes, LATTICE.first, n, want) == pytest.approx(value)
    assert np.isfinite(got).all() and got.min() < -600 and total == pytest.approx(want)
    assert len(LATTICE.marginals([], LATTICE.first)) == 0
