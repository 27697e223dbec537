"""Text files are read in blocks; sizes and beginnings are those of the whole files."""

import pytest

from sparkeda.sources import files

TEXTS = {
    "plain": "one\ntwo\nthree\n", "open": "no line feed at the end", "empty": "", "feeds": "\n" * 300, "windows": "a\r\nb\rc\r\n",
    "wide": "äö漢🙂\n" * 200, "long": "x" * 5000 + "\n" + "y" * 10, "short lines": "\n".join("ab" for _ in range(900)), "exact": "z" * 50, "feed": "\n",
}


@pytest.mark.parametrize("block", ["128m", "97b"])
@pytest.mark.parametrize("n", [1, 50, 1000])
def test_previews(spark, tmp_path, block, n):
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_text_preview(spark, str(tmp_path), n).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["characters"], r["preview"]) for r in rows}
    assert got == {f"{k}.txt": (len(t), t[:n] + ("..." if len(t) > n else "")) for k, t in TEXTS.items() if t}      # Spark's readers pass over empty files


def test_texts_in_parts(spark, tmp_path):
    """The files of a folder are one text, in the order of their names."""
    for folder, parts in {"a": ["one\n", "two\nthree\n"], "b": ["x" * 30 + "\n", "y"], "c": ["no feed", "", " between\n"]}.items():
        (tmp_path / folder).mkdir()
        for i, part in enumerate(parts):
            (tmp_path / folder / f"part-{i:05}.txt").write_text(part)
    got = {r["path"].rsplit("/", 1)[1]: (r["characters"], r["preview"]) for r in files.read_text_preview(spark, f"{tmp_path}/*", 12, folders=True).collect()}
    assert got == {"a": (14, "one\ntwo\nthre..."), "b": (32, "x" * 12 + "..."), "c": (16, "no feed betw...")}
    listed = {tuple(r) for r in files.file_manifest(spark, str(tmp_path), folders=True).collect()}
    assert listed == {("a", "txt", "text", 14), ("b", "txt", "text", 32), ("c", "txt", "text", 16)}


def test_a_language_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from workload import w_files

    rows = [(i, "text %d\nmore" % i, "en" if i % 3 else "de") for i in range(300)] + [(None, None, "en"), (None, "x", "en"), (None, "x", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    few = (w_files.previews(spark, str(tmp_path)).collect(), w_files.manifest(spark, str(tmp_path)).collect())
    monkeypatch.setattr(w_files, "PART_BYTES", 500)
    folder = w_files._by_language(spark, str(tmp_path))
    names = spark.read.text(folder).select("_metadata.file_path").distinct().count()
    assert names >= 7                                    # 3.8 kB in parts of 500 bytes
    many = (w_files.previews(spark, str(tmp_path)).collect(), w_files.manifest(spark, str(tmp_path)).collect())
    assert [sorted(x) for x in many] == [sorted(x) for x in few] and len(few[0]) == 2
