import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkeda.llm import packing as p
from sparkeda.llm import tokens
from sparkeda.llm.shared import vocabulary
from tests.llm.conftest import make_docs


def plain(texts, size=4096, end=1):
    library = tokens.load(vocabulary("word_bpe_49k.json"))
    out = []
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out += [(doc, k, a, len(ids[a:a + size]), zlib.crc32(ids[a:a + size].tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    return out


def check_places(rows, size):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_whole_texts(odd, odd_rows):
    rows = p.pack_documents(odd).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(plain([x[:2] for x in odd_rows]), key=key)
    check_places(rows, 4096)


def test_memory_of_stretches_is_bounded():
    library, memory = tokens.load(vocabulary("word_bpe_49k.json")), {}
    for text in ("a b c d", "d e f a", "a a g"):
        parts = tokens.bare_stretches(text)
        found = tokens.known(parts, library, memory, tokens.encode_joined, room=3)
        assert b"".join(found[s] for s in parts) == tokens.as_bytes(library.encode(text, add_special_tokens=False).ids)
        assert len(memory) <= 3


PARTS = ["a", "The", "ÉÉ", "e\u0301", "\u0301", "İ", "ΑΣ", ".", "'s", "12", "🙂", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "\t", "\xa0", "\x1c", "가", "ﬁ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), min_size=1, max_size=5).map("".join), max_size=30))
def test_joined_stretches(stretches):
    library, *_ = tokens.remembered(vocabulary("word_bpe_49k.json"), tokens.encode_each)
    assert tokens.encode_joined(library, stretches) == tokens.encode_each(library, stretches)
    text = " ".join(stretches)
    assert b"".join(tokens.encode_each(library, tokens.bare_stretches(text))) == tokens.as_bytes(
        library.encode(text, add_special_tokens=False).ids)


def test_as_few_sequences_as_can_be(spark):
    rng = random.Random(3)
    lengths = np.array([rng.choice((rng.randint(1, 40), rng.randint(1, 100))) for _ in range(3000)])
    sequence, offset = p.place(lengths, 100)
    assert len(set(sequence)) <= -(-lengths.sum() // 100) + 2
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "id long, length long")
    rows = p.pack(df, 100, group=500).collect()
    assert sorted((r.id, r.length) for r in rows) == [(i, int(x)) for i, x in enumerate(lengths)]
    assert check_places(rows, 100) <= -(-lengths.sum() // 100) + 12


def test_each_piece_goes_where_the_squares_are_least():
    """Against the sums of squares themselves, all counted anew for every choice."""
    rng = random.Random(9)
    lengths = np.array([rng.randint(1, 12) for _ in range(120)])
    sequence, _ = p.place(lengths, 12)
    room = {}
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])

        def squares(to):
            rooms = [r - s if b == to else r for b, r in room.items()]
            return sum(rooms.count(g) ** 2 for g in range(1, 13))

        fits = [b for b, r in room.items() if r >= s]
        if fits:
            assert squares(sequence[i]) == min(map(squares, fits))
            room[sequence[i]] -= s
        else:
            assert sequence[i] not in room
            room[sequence[i]] = 12 - s


def test_empty(none):
    assert p.pack_documents(none).count() == 0


def test_query_is_the_operator(spark):
    docs = make_docs(spark, [(1, "a b"), (2, "c")])
    assert p.pack_documents(docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_words_are_encoded_once_each_and_as_in_whole_texts():
    path = vocabulary("word_bpe_49k.json")
    texts = [
        "", " \n\t ", "it's 'st x''s ''re IT'S ('S we'llama", "a1b22 3.14, ...!? #*$ÀÉßÿ×÷ ŁÓDŹ ŉ ſ", "“Word” – word… word's", "<|startoftext|>word <|endoftext|>",
        "İstanbul ΑΣ ªµº ¹²³ 日本語 é   x\x1cy z \x00 🙂", "<|startoftext |> word</w> \r\n\fword", "zqxzqx-vwkvwk_ZQXZQX"]
    library = tokens.load(path)
    want = [tokens.as_bytes(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens.encode_bare(path, texts) == want == tokens.encode_bare(path, texts)
    _, _, words = tokens.table_of(path, tokens.word_ends)
    before = set(words)
    tokens.encode_bare(path, ["Qvjxk, qvjxk. (QVJXK) qvjxk; 'qvjxk'"])
    assert {w for w in set(words) - before if w.isalpha()} == {"qvjxk"}
    room, words_before = tokens.WORDS, len(words)
    tokens.WORDS = words_before
    try:
        assert tokens.encode_bare(path, ["qvjxw qvjxw"]) == [tokens.as_bytes(library.encode("qvjxw qvjxw", add_special_tokens=False).ids)]
        assert len(words) == words_before
    finally:
        tokens.WORDS = room
