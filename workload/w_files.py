"""Source and sink queries: results go to the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.operators import catalog as cat
from sparkeda.plans import reports
from sparkeda.sources import files
from workload.common import DERIVED, Registry, big, load, rnd
from workload.w_search import hits_sql

R = Registry()
JSON_FRAME = '{"r_regionkey":,"r_name":""}'


def read_back(spark: SparkSession, d: str) -> DataFrame:
    """Orders with gaps written as CSV (gaps as NA texts), then read with inferred types."""
    path = files.new_path(spark, "orders-csv")
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.when(k % 9 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, "null").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("even"), F.lit("NaN").alias("nothing"),
        F.concat((k % 90).cast("string"), F.when(k % 2 == 0, "D").otherwise("F")).alias("code"), F.concat(F.lit("0x1p"), (k % 9).cast("string")).alias("hex"),
        F.concat(F.lit("a\n"), F.col("o_orderpriority")).alias("note"))
    return files.read_table(spark, files.write_csv(rows, path))


R.add("read_table", read_back, """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderkey % 2 = 0 AS even,
      CAST(NULL AS DOUBLE) AS nothing, (o_orderkey % 90) || CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'F' END AS code,
      '0x1p' || (o_orderkey % 9) AS hex, 'a' || chr(10) || o_orderpriority AS note FROM orders""")


def previews(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as texts, one per language, and each text shown."""
    return files.read_text_preview(spark, f"{_by_language(spark, d)}/*", folders=True).select("characters", "preview")


#: Bytes of text that a task sorts and writes.
PART_BYTES = 1 << 27


def _by_language(spark: SparkSession, d: str) -> str:
    """One text per language by document, in a folder each; large ones in several parts, each of a range of the documents."""
    path = files.new_path(spark, "texts")
    docs = load(spark, d, "documents")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = ["lang", "doc_id", F.xxhash64("text")]
    rows = docs.repartitionByRange(size // PART_BYTES + 1, *order).sortWithinPartitions(*order)
    rows.select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    return path


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files of several kinds written from the tables; names are the writer's own, so only the rest is shown."""
    path = _by_language(spark, d)
    rows = load(spark, d, "region").coalesce(1).select("r_regionkey", "r_name")
    rows.write.csv(f"{path}/c")
    rows.select(F.to_json(F.struct("r_name")).alias("value")).write.text(f"{path}/t")
    rows.write.json(f"{path}/j")
    return files.file_manifest(spark, path, folders=True).select("extension", "kind", "bytes")


R.add("read_text_preview", previews, """
    WITH t AS (SELECT string_agg(text || chr(10), '' ORDER BY doc_id) AS whole FROM documents GROUP BY lang)
    SELECT length(whole) AS characters, CASE WHEN length(whole) > 1000 THEN substring(whole, 1, 1000) || '...' ELSE whole END AS preview
    FROM t""")
R.add("file_manifest", manifest, f"""
    SELECT 'txt' AS extension, 'text' AS kind, {big('sum(strlen(text) + 1)')} AS bytes FROM documents GROUP BY lang
    UNION ALL SELECT 'csv', 'csv', {big('sum(strlen(r_regionkey || r_name) + 2)')} FROM region
    UNION ALL SELECT 'txt', 'text', {big("sum(strlen(r_name) + strlen('{}') + strlen('r_name') + 6)")} FROM region
    UNION ALL SELECT 'json', 'other', {big(f"sum(strlen(r_regionkey::VARCHAR) + strlen(r_name) + {len(JSON_FRAME) + 1})")} FROM region""")


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Search hits exported as CSV and read back."""
    hits = cat.search_all(DERIVED["catalog"](spark, d), ["the", "der"], 10)
    path = files.export_hits(hits, files.new_path(spark, "hits"))
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


R.add("write_csv", exported, f"""
    SELECT title AS "Title", description AS "Description", url AS "URL", source AS "Source", type AS "Type"
    FROM ({hits_sql('none')})""")


def search_report(spark: SparkSession, d: str) -> DataFrame:
    hits = cat.search_all(DERIVED["catalog"](spark, d), ["the", "der"], 10)
    lines = files.search_report(cat.rank_results(hits, "the"), cat.source_counts(hits, load(spark, d, "documents")), "the")
    return spark.read.text(files.write_report(lines, files.new_path(spark, "search-report")))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    lines = reports.report_lines(reports.data_report(df), "Automated Data Analysis Report", df.columns)
    return spark.read.text(files.write_report(lines, files.new_path(spark, "data-report")))


def enterprise_markdown(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    results, _ = reports.enterprise_eda(df)
    lines = reports.report_lines(results, "Enterprise EDA Report", df.columns)
    return spark.read.text(files.write_report(lines, files.new_path(spark, "enterprise-report")))


R.add("write_report", markdown)
R.add("write_enterprise_report", enterprise_markdown)
_score = """(CASE WHEN contains(lower(title), 'the') THEN 2.0 ELSE 0 END)
    + (CASE WHEN contains(lower(description), 'the') THEN 1.0 ELSE 0 END)
    + log10(CAST(stars AS DOUBLE) + 1.0) / 10 + (CASE WHEN description <> 'No description' THEN 0.5 ELSE 0 END)"""
R.add("write_search_report", search_report, f"""
    WITH h AS ({hits_sql('none')}),
    f AS (SELECT *, {rnd(_score, 4)} AS score FROM h),
    b AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, position, title, url) AS rank FROM f)
    SELECT '# Dataset Search Report' AS value UNION ALL SELECT '**Query:** the'
    UNION ALL SELECT '**Total Results:** ' || count(*) FROM h
    UNION ALL SELECT '## Sources Searched:' UNION ALL SELECT '## Top Recommendations:'
    UNION ALL SELECT '- ' || d.source || ': ' || count(h.source) || ' results'
    FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN h ON d.source = h.source GROUP BY d.source
    UNION ALL SELECT rank || '. ' || title || ' (' || source || ')' FROM b WHERE rank <= 5""")
