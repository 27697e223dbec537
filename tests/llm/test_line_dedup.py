import random

import pytest

from sparkeda.llm import line_dedup as d
from tests.llm.conftest import article, make_docs
from tests.llm.test_near_dup import distance


@pytest.mark.parametrize("k", [1, 2, 3])
def test_bit_parallel_distance(spark, k):
    rng = random.Random(k)
    rows = []
    while len(rows) < 150:
        a = [rng.choice("abé🙂") for _ in range(rng.randint(5, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = [rng.choice("abé🙂")] * rng.randint(0, 1)
            b = b or ["a"]
        if abs(len(a) - len(b)) <= k < min(len(a), len(b)):
            rows.append(("".join(a), "".join(b), distance(a, b)))
    got = spark.createDataFrame(rows, "a string, b string, d int").selectExpr("d", f"{d.edit_distance('a', 'b', k)} AS e").collect()
    assert all(r.e == r.d if r.d <= k else r.e > k for r in got)


def brute(rows):
    """Per (id, text) what stays, by comparing every line with every earlier one."""
    places = []
    for doc, h, text in sorted({(r[0], r[2], r[1]) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        for no, line in enumerate(text.split("\n")):
            if len(line.strip(" ")) >= d.MIN_CHARS:
                places.append((doc, h, no, line))
    kept = {}
    for i, (doc, h, no, line) in enumerate(places):
        if not any(abs(len(line) - len(e[3])) <= 1 and distance(line, e[3]) <= 1 for e in places[:i]):
            kept.setdefault((doc, h), set()).add(no)
    return {(doc, text): "\n".join(x for no, x in enumerate(text.split("\n"))
                                   if len(x.strip(" ")) < d.MIN_CHARS or no in kept.get((doc, h), ())) for doc, text, h in rows}


def check(spark, rows):
    docs = make_docs(spark, rows)
    hashed = {(r.doc_id, r.t): r.h for r in docs.selectExpr("doc_id", "coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    want = brute([(r[0], r[1] or "", hashed[r[0], r[1] or ""]) for r in rows])
    got = d.dedup(docs, carry=["n_chars", "h"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r[0]), want[r[0], r[1] or ""]) for r in rows)
    return got


def variants(seed, n):
    rng = random.Random(seed)
    base = article(seed, lines=1, n=5)
    out = [base]
    for _ in range(n):
        line = list(rng.choice(out))
        at = rng.randrange(len(line))
        line[at:at + rng.randint(0, 1)] = [rng.choice("abcé")] * rng.randint(0, 1)
        out.append("".join(line))
    return out


def test_against_all_earlier_lines(spark):
    rng = random.Random(5)
    stock = [v for s in range(12) for v in variants(s, 6)] + ["short", "", "same short line"]
    check(spark, [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(1, 7)))) for i in range(80)])


@pytest.mark.parametrize("limit", [2, 5])
def test_large_groups_are_split_not_paired(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "PAIRS_UP_TO", limit)
    rng = random.Random(8)
    stock = variants(3, 60)
    check(spark, [(i, "\n".join(rng.sample(stock, 3))) for i in range(40)])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, article(4)), (4, article(4)), (5, article(4)), (None, article(6)), (None, None),
            (7, "one"), (8, "x" * 3000), (9, "x" * 3001 + "\n" + "x" * 2999), (6, article(6).replace("e", "é")), (12, article(12) + "\n" + article(4))]
    got = check(spark, rows)
    assert got[0].asDict().keys() == {"doc_id", "n_lines", "n_dropped", "n_long", "text", "n_chars", "h"}
    assert {r.h for r in got} == {3}                        # the table's own column of that name


def test_empty(none):
    assert d.dedup(none).count() == 0


def test_lines_are_read_without_shuffling_whole_texts(spark):
    other = "\n".join(article(i, lines=1, n=9) for i in range(10, 60))
    docs = make_docs(spark, [(None, other, "en"), (1, "short\n" + article(1, lines=1, n=9) + "\n" + other, "en"), (1, other, "en"), (1, other, "en")])
    own = d._documents(docs, "doc_id", "text")
    first = d.distinct_lines(own).filter("doc_id IS NULL AND no % 25 = 3 OR doc_id = 1")
    found = d.lines_at(own, first.select("d1", "d2", "doc_id", "h", "no"))
    assert sorted(r.line for r in found.collect()) == sorted([article(1, lines=1, n=9), *(other.split("\n")[i] for i in (3, 28))])
    held = {(r.d1, r.d2): r.line for r in found.collect()}
    assert all(spark.range(1).selectExpr(f"xxhash64(0, '{x}') AS a", f"xxhash64(1, '{x}') AS b").first() == k for k, x in held.items())
    assert "text" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
