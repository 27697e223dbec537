import random
import zlib

import numpy as np
import pyarrow as pa

from sparkeda.llm import lang_id as l
from tests.llm.conftest import article, french, make_docs


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(size=(counts.sum(), 3))
        label = l.viterbi(scores, counts, 0.7)
        at = 0
        for n in counts:
            best = max((sum(scores[at + i, p] for i, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:])), path)
                       for path in np.ndindex(*[3] * n)) if n else (0, ())
            assert tuple(label[at:at + n]) == best[1]
            at += n


def corpus(spark):
    rows = []
    for i in range(120):
        rows.append((i, article(i), "en") if i % 2 else (i, french(i), "fr"))
    return rows


def test_held_out_and_spans(spark):
    rows = corpus(spark)
    docs = make_docs(spark, rows)
    got = l.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    lang = {i: x for i, _, x in rows}
    assert all(r.lang_pred == lang[r.doc_id] for r in got)
    model = l.learn_held_out(docs)
    mixed = article(900) + "\n" + french(901)
    (best, share, spans), = l.label_texts([mixed], model)
    assert [s[0] for s in spans] == ["en", "fr"] and 0.3 < share < 0.8
    assert abs(spans[1][1] - len(article(900)) - 1) < 25
    assert l.label_texts([mixed, "", "12 !", mixed], model)[0] == l.label_texts([mixed], model)[0]


def test_labels_of_held_out_rows_play_no_part(spark):
    rows = corpus(spark)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, l.identify(make_docs(spark, rows)).collect())) == sorted(map(key, l.identify(make_docs(spark, other)).collect()))


def test_scripts_narrow(spark):
    greek = ["και το του της που με για από στο δεν"[k:] + " λόγος άνθρωπος θάλασσα" for k in range(10)] * 4
    rows = [*corpus(spark), *((500 + i, t, "el") for i, t in enumerate(greek))]
    model = l.learn(make_docs(spark, rows))
    assert model.langs == ["el", "en", "fr"] and model.open[1].tolist() == [True, False, False]
    assert l.label_texts(["θάλασσα", "the of", "日本"], model)[0][0] == "el"
    assert l.label_texts(["日本"], model)[0][0] in model.langs                  # open to none: all stay equal


def test_blocks_do_not_matter(spark, monkeypatch):
    model = l.learn(make_docs(spark, corpus(spark)))
    rng = random.Random(1)
    texts = [rng.choice((article(i), french(i), "", article(i) + french(i), "x")) for i in range(40)]
    whole = l.label_texts(texts, model)
    monkeypatch.setattr(l, "AT_ONCE", 100)
    assert l.label_texts(texts, model) == whole


def test_odd_rows(spark, odd, odd_rows, none):
    model = l.learn(make_docs(spark, corpus(spark)))
    found = l.predict(odd, model, carry=odd.columns).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.langs) == letters and (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert l.identify(none).count() == 0
    unlabelled = make_docs(spark, [(1, "the of", None), (2, None, "en")])
    assert {r.lang_pred for r in l.identify(unlabelled).collect()} == {"und"}


def test_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = l.identify(docs).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_a_block_of_texts_takes_little_memory():
    import tracemalloc

    l._tables()
    rng = np.random.default_rng(1)
    model = l.Model([f"l{i}" for i in range(10)], rng.random((l.SLOTS, 10), np.float32), np.ones((len(l.SCRIPTS) + 1, 10), bool))
    texts = ["Some words of a text to be labelled. " * 85] * 1000
    part = next(l._blocks(texts, l.AT_ONCE))
    for work in (lambda: l.label_texts(texts, model), lambda: l.letters(texts[part])):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6


def test_only_a_slice_of_a_batch_becomes_python_texts(monkeypatch):
    """Slices hold all rows once, in order, and no more bytes than a block and a row; null and empty texts take none."""
    monkeypatch.setattr(l, "AT_ONCE", 100)
    whole = [None, "", "é" * 30, "a" * 250, "b" * 99, "c", None, *["dd" * 20] * 40, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(whole, pa.string()), pa.array(range(len(whole)))], ["text", "at"])
    parts = [p.to_pydict() for p in l._slices(batch)]
    assert [x for p in parts for x in p["at"]] == list(range(len(whole)))
    size = [[len((t or "").encode()) for t in p["text"]] for p in parts]
    assert all(sum(s) - max(s) <= 100 for s in size) and len(parts) > 10
    assert list(l._slices(batch.slice(0, 0))) == []
