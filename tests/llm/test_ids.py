"""Ids around 2 ** 53 beside null ones, and columns named like every output, through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkeda.llm import bpe, chat, html_main, lang_id, lm_score, mixing, packing
from tests.llm.conftest import article, make_docs

BIG = [9007199254740993, None, 9007199254740995, 9223372036854775807]
NAMES = ["score", "spans", "lang_pred", "n_dropped", "n_long", "n_lines", "kept", "piece", "sequence_id", "offset", "chosen", "class_id", "group", "c0", "lots"]


@pytest.fixture(scope="module")
def docs(spark):
    long = article(8, lines=1500)
    return make_docs(spark, [(i, t) for k, i in enumerate(BIG) for t in (article(k), long, None)])


@pytest.mark.parametrize("work", [packing.pack_documents, bpe.encode, lang_id.identify, lm_score.score_held_out, mixing.mix],
                         ids=["packing", "bpe", "lang_id", "lm_score", "mixing"])
def test_ids_come_back(docs, work):
    assert {r["doc_id"] for r in work(docs).select("doc_id").distinct().collect()} == set(BIG)


def test_page_ids_come_back(spark):
    pages = spark.createDataFrame([(i, f"http://h/{k}", "<p>" + article(k) + "</p>") for k, i in enumerate(BIG)], "page_id long, url string, html string")
    assert {r["page_id"] for r in html_main.extract(pages).collect()} == set(BIG)


def test_conversations_without_an_id(spark):
    rows = [(i, k, ("user", "assistant")[k % 2], f"{i} {k}") for i in BIG for k in range(3)]
    made = chat.format_paths(chat.as_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(made).collect()}
    assert got == {i: 3 for i in BIG}
    assert {r["tree"] for r in made.filter(F.col("formatted").contains("None 2")).collect()} == {None}


def test_equal_pieces_are_dealt_over_all_groups(spark):
    parts = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"))
    made = packing.pack(parts, 64, 100)
    assert made.select(F.shiftright("sequence_id", 32)).distinct().count() > 20 and made.count() == 3000


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_columns_of_any_name(spark, name, stage):
    rows = [(i, article(k, lines=8)) for k, i in enumerate([*BIG, 1, 2, 3])]
    wide = make_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))
    got = stage(spark, wide, "")
    assert got.columns == wide.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in rows}
    assert got.select(*NAMES).distinct().collect()[0][:] == tuple(range(len(NAMES)))
