import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkeda.llm import bpe, tokens
from sparkeda.llm.shared import vocabulary
from tests.llm.conftest import article, make_docs

LIBRARY = tokens.load(vocabulary("byte_bpe_50k.json"))
TABLE = bpe.byte_table(LIBRARY)
PARTS = ["a", "the", " ", "  ", "\n", "'s", "'ll", "1", "23", ".", "!!", "é", "日本", "<|endoftext|>", "<|endo", "\t", "\xa0", "🙂", "'", "\x1c", "\r\n", "word"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join), st.integers(1, 60))
def test_joined_parts_are_the_whole(text, leaf):
    assert bpe.Joiner(LIBRARY, TABLE).tree([ids_of(text[i:i + leaf]) for i in range(0, len(text), leaf)]) == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_stretches(text):
    assert [i for s in tokens.led_stretches(text) for i in ids_of(s)] == ids_of(text)


@pytest.mark.parametrize("letters", ["acgt", "abcdefghijklmnopqrstuvwxyz", "aé日", "0123456789", ".!?"])
def test_text_without_a_blank(letters):
    rng = random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(6000))
    assert bpe.Joiner(LIBRARY, TABLE).tree([ids_of(text[i:i + 900]) for i in range(0, 6000, 900)]) == ids_of(text)


def test_window_stays_small_within_a_run_of_letters():
    rng = random.Random(2)
    seen = []

    class Counted:
        def encode(self, text, **_):
            seen.append(len(text))
            return LIBRARY.encode(text, add_special_tokens=False)

    text = "".join(rng.choice("acgt") for _ in range(20_000))
    halves = [ids_of(text[:10_000]), ids_of(text[10_000:])]
    assert bpe.Joiner(Counted(), TABLE).join(*halves) == ids_of(text)
    assert max(seen) < 2000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decode_any_ids(ids):
    assert b"".join(TABLE[i] for i in ids).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_texts(spark, odd, odd_rows):
    want = sorted((str(d), ids_of(t or "")) for d, t, *_ in odd_rows)
    encoded = bpe.encode(odd, leaf=1000)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded).collect()) == sorted(
        (str(d), LIBRARY.decode(ids_of(t or ""), skip_special_tokens=False)) for d, t, *_ in odd_rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(odd)).collect())
    assert got == sorted((d, len(i), sha(",".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for d, i in want)


def test_repeated_long_rows(spark):
    text = article(3, lines=40)
    rows = bpe.encode(make_docs(spark, [(1, text), (1, text), (1, text + "!"), (2, text)]), leaf=500).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == sorted(
        [(1, len(ids_of(text)))] * 2 + [(1, len(ids_of(text + "!"))), (2, len(ids_of(text)))])


def test_empty(none):
    assert bpe.digests(bpe.encode(none)).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0
