import hashlib

from pyspark.sql import functions as F

from sparkeda.llm import fingerprints as f
from tests.llm.conftest import article, make_docs


def test_edits_and_prints(odd, odd_rows):
    got = f.compare_edits(odd).collect()
    assert len(got) == len(odd_rows)
    ids = sorted({r[0] for r in odd_rows if r[0] is not None}, reverse=True)
    first = {i: min(x[1] or "" for x in odd_rows if x[0] == i) for i in ids}
    follow = {i: first[b] for i, b in zip(ids, ids[1:] + ids[:1])}
    want = sorted(hashlib.sha256(((t or "")[:len(t or "") - len(t or "") // 2] + follow.get(i, "")[:len(t or "") // 2])
                                 .encode()).hexdigest() for i, t, *_ in odd_rows)
    assert sorted(r.edited_sha256 for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r, text in ((r, x[1] or "") for r in got for x in odd_rows if x[0] == r.doc_id and r.doc_id is not None):
        prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert {r.n_chars for r in got} == {len(x[1] or "") for x in odd_rows}


def test_likeness_follows_the_shared_half(spark):
    got = f.compare_edits(make_docs(spark, [(i, article(i)) for i in range(40)])).collect()
    assert sum(r.near_edited > r.near_next for r in got) >= 39


def test_order_and_increments(spark):
    a, b, c = article(1), article(2), article(3)
    df = spark.createDataFrame([(a + "\n" + b, b + "\n" + a, a, b, c)], "ab string, ba string, a string, b string, c string")
    p = {x: f.fingerprint(F.col(x)) for x in df.columns}
    row = df.select(
        (f.as_text(p["ab"]) == f.as_text(p["ba"])).alias("order"), (f.as_text(p["a"]) != f.as_text(p["c"])).alias("other"),
        (f.as_text(f.combine(p["a"], p["b"])) == f.as_text(p["ab"])).alias("plus"),
        (f.as_text(f.combine(p["ab"], p["b"], -1)) == f.as_text(p["a"])).alias("minus"),
        f.likeness(p["ab"], p["ba"]).alias("same"), f.likeness(p["a"], p["c"]).alias("apart")).first()
    assert row.order and row.other and row.plus and row.minus and row.same == 1 and row.apart < 0.4


def test_empty(none):
    assert f.compare_edits(none).count() == 0
