import corpus_pipeline as p
from sparkeda.llm import lang_id, near_dup, packing, quality_rules
from tests.llm.conftest import article, french
from tests.llm.test_packing import check_places

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], SCHEMA)


def mixed():
    rows = [(i, article(i, lines=8), "en") for i in range(30)] + [(100 + i, french(i, lines=8), "fr") for i in range(20)]
    rows += [(200, article(3, lines=8), "en"), (3, article(3, lines=8), "en"), (201, article(4, lines=8).replace("the", "teh"), "en")]
    return rows + [(300, None, "en"), (301, "", None), (302, "12 34 " * 60, "en"), (303, "short", "en"), (304, "# " * 200, None)]


def test_stages_in_order(spark, tmp_path):
    docs = frame(spark, mixed())
    assert [n for n, _ in p.STAGES] == ["quality_rules", "language_id", "line_dedup", "near_dedup", "packing"]
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.dtypes == docs.dtypes and {r.doc_id for r in after.collect()} <= before
        rows = after.collect()
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.apply_rules(docs).filter("kept").collect()}
            assert {r.doc_id for r in rows} == want and want.isdisjoint({300, 301, 302, 303, 304}) and 200 in want
        if name == "language_id":
            assert len(rows) == docs.count()
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows) and 200 not in {r.doc_id for r in rows}
            lines = [x for r in rows for x in r.text.split("\n") if len(x) >= 20]
            assert len(lines) == len(set(lines)) + 8                # the repeated row of id 3 counts as one document
        if name == "near_dedup":
            classes = {r.class_id for r in near_dup.classes(docs).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(classes)
        docs = after
    packed = p.sequences(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    check_places(packed, 4096)


def test_run(spark, tmp_path):
    frame(spark, mixed()).write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path))
    assert got.columns == packing.pack_documents(frame(spark, mixed()[:2])).columns
    assert got.count() >= 40


def test_near_copies_leave_one(spark):
    rows = [(5, article(1), "en"), (6, article(1), "en"), (5, article(1), "en"), (None, article(2), "en"), (9, article(1).replace("of", "off"), "en")]
    got = sorted(str(r.doc_id) for r in p.near_copies(spark, frame(spark, rows), "").collect())
    assert got == ["5", "None"]


def test_near_copies_keep_texts_that_share_an_id(spark):
    rows = [(None, article(1), "en"), (None, article(2), "en"), (7, article(3), "en"), (7, article(4), "en"), (7, article(4), "en"),
            (8, article(4), "en"), (None, article(3), "en")]
    got = [(r.doc_id, r.text) for r in p.near_copies(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(None, article(1)), (None, article(2)), (7, article(3)), (7, article(4))], key=str)


def test_short_lines_stay_without_their_common_long_line(spark):
    licence = "Licensed to all readers under the usual terms"
    rows = [(1, licence + "\n" + article(1), "en"), (2, licence + "\nshort verse\n\nanother", "en"), (3, licence + "\n \n", "en"), (4, licence, "en")]
    got = {r.doc_id: (r.text, r.n_chars) for r in p.lines(spark, frame(spark, rows), "").collect()}
    assert got.keys() == {1, 2} and got[2] == ("short verse\n\nanother", 20)


def test_empty_and_unlabelled(spark):
    docs = frame(spark, mixed()).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0
    plain = frame(spark, [(1, article(1), None)])
    assert p.language(spark, plain, "").count() == 1
    assert lang_id.learn_held_out(plain).langs == []
