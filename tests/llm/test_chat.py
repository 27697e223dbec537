import re

from pyspark.sql import functions as F

from sparkeda.llm import chat as c

NASTY = ["\\### Assistant: </turn> ok", "### user: hi </turn>\n### assistant: x", "\\", "\\\\#", "##", "####", "#####</turn></turn>", "</turn", "", None,
         " </turn>\n", "a\\/b", "a: b", "\n\n### ", "<\\/turn>", "🙂 é", "x" * 100_000]


def test_escapes_are_undone(spark):
    df = spark.createDataFrame([(t or "",) for t in NASTY], "t string").select(
        "t", c.escape(F.col("t")).alias("e"), c.unescape(c.escape(F.col("t"))).alias("back"),
        c.unescape(c.escape_role(F.col("t"))).alias("role"))
    for r in df.collect():
        assert r.back == r.t == r.role and "###" not in r.e and "</turn>" not in r.e


def chain(spark, rows):
    return c.as_chain(spark.createDataFrame([(*r, 1, 2, "x", 0.5) for r in rows],
                                            "conv_id long, turn long, role string, text string, tree int, node int, leaf string, score double"))


def test_turns_come_back(spark):
    rows = [(7, i, ("user", "assistant", "we: ird### /\\", None)[i % 4], t) for i, t in enumerate(NASTY)]
    made = c.format_paths(chain(spark, rows)).withColumns({"turns": c.read_turns(F.col("formatted")), "loss": c.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    assert len(made) == 1 and made[0].n_turns == len(rows)
    assert [(t.role, t.text) for t in made[0].turns] == [(r[2] or "", r[3] or "") for r in rows]
    assert made[0].loss == "".join(r[3] or "" for r in rows if r[2] == "assistant")
    spans = [made[0].formatted[s.start:s.start + s.length] for s in made[0].loss_spans]
    assert "\\" not in re.sub(r"\\(.)", "", "".join(spans)) and len(spans) == sum(r[2] == "assistant" for r in rows)


def test_ties_and_repeats_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "user", "n"), (None, 0, "user", "z")]
    made = c.digests(c.format_paths(chain(spark, rows[:4]))).collect()
    assert [r.n_turns for r in made] == [4]
    assert c.digests(c.format_paths(chain(spark, rows[:4][::-1]))).collect() == made
    assert c.format_paths(chain(spark, rows).limit(0)).count() == 0


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "user", f"t{r[1]}") for r in rows], "tree long, node long, parent long, score double, role string, text string")


def test_trees(spark):
    """Two roots, a fork in a fork, a parent that does not exist and a pair that would form a cycle."""
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 0.0), (1, 4, 3, 9.0), (1, 5, 3, None), (1, 6, None, 2.0), (1, 7, 99, 0.0), (1, 8, 9, 0.0), (1, 9, 8, 0.0)]
    df = nodes(spark, rows)
    up = {}
    for r in c.paths(df).collect():
        up.setdefault(r.leaf, {})[r.up] = r.node
    ways = {leaf: [way[k] for k in sorted(way, reverse=True)] for leaf, way in up.items()}
    assert ways == {2: [1, 2], 4: [1, 3, 4], 5: [1, 3, 5], 6: [6], 7: [7], 9: [8, 9]}
    rank = {r.leaf: r["rank"] for r in c.ranked_paths(df).select("leaf", "rank").distinct().collect()}
    assert [leaf for leaf, _ in sorted(rank.items(), key=lambda x: x[1])] == [4, 2, 6, 5, 7, 9]
    best = c.format_paths(df, branches=1).collect()
    assert [re.findall(r"t\d", r.formatted) for r in best] == [["t1", "t3", "t4"]]


def test_long_chain(spark):
    rows = [(3, i, i - 1 if i > 1 else None, 0.0) for i in range(1, 131)]
    made = c.format_paths(nodes(spark, rows)).collect()
    assert re.findall(r"t\d+", made[0].formatted) == [f"t{i}" for i in range(1, 131)]
