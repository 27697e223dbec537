"""Previews, samples, row filters, overview and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import basics, quality
from workload.common import (
    LINEITEM, LINEITEM_NUMBERS, Registry, big, on, pct, per_column, rnd, source, union,
)

R = Registry()

R.add("preview", on("orders", lambda df: basics.preview(df, ["o_totalprice", "o_orderkey"], 20, desc=True)),
      "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
R.add("context_sample", on("documents", lambda df: basics.context_sample(df, "doc_id")),
      """SELECT doc_id, substring(text, 1, 50) AS text, substring(lang, 1, 50) AS lang,
                substring(source, 1, 50) AS source, n_chars FROM documents ORDER BY doc_id LIMIT 25""")
R.add("drop_columns", on("orders", lambda df: basics.drop_columns(df, "o_orderstatus")),
      "SELECT * EXCLUDE (o_orderstatus) FROM orders")
R.add("dropna_rows", on("lineitem_nulls", lambda df: basics.dropna_rows(df, ["l_tax", "l_returnflag"])),
      f"SELECT * FROM {source('lineitem_nulls')} WHERE l_tax IS NOT NULL AND l_returnflag IS NOT NULL")
R.add("sample_rows", on("orders", lambda df: basics.sample_rows(df, "o_orderkey", 2000)),
      "SELECT * FROM orders ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey LIMIT 2000")

KINDS = {"BIGINT": ("bigint", "numeric", 8), "INTEGER": ("int", "numeric", 4), "DOUBLE": ("double", "numeric", 8),
         "VARCHAR": ("string", "categorical", 0), "TIMESTAMP": ("timestamp_ntz", "datetime", 8)}
LINEITEM_TYPES = ["BIGINT"] * 3 + ["INTEGER"] + ["DOUBLE"] * 4 + ["VARCHAR"] * 2 + ["TIMESTAMP"]
LINEITEM_SCHEMA = list(zip(LINEITEM, LINEITEM_TYPES))
DOCUMENTS_SCHEMA = [("text", "VARCHAR"), ("lang", "VARCHAR"), ("source", "VARCHAR"), ("n_chars", "BIGINT")]


def bytes_sql(table: str, schema: list[tuple[str, str]]) -> str:
    def size(c: str, t: str) -> str:
        return f"coalesce(sum(octet_length(encode({c}))), 0)" if t == "VARCHAR" else f"count({c}) * {KINDS[t][2]}"
    return union([f"SELECT '{c}' AS \"column\", {big(size(c, t))} AS bytes FROM {source(table)}" for c, t in schema])


R.add("column_catalog", on("lineitem_nulls", quality.column_catalog), union([
    f"""SELECT {i} AS position, '{c}' AS "column", '{KINDS[t][0]}' AS dtype, '{KINDS[t][1]}' AS kind,
        count({c}) AS non_null, count(DISTINCT {c}) AS nunique FROM {source('lineitem_nulls')}"""
    for i, (c, t) in enumerate(LINEITEM_SCHEMA)]))
R.add("table_overview", on("documents_nokey", quality.table_overview), f"""
    SELECT (SELECT count(*) FROM documents) AS rows, CAST(4 AS BIGINT) AS cols,
      (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents))
        AS duplicates,
      (SELECT {big('sum(bytes)')} FROM ({bytes_sql('documents_nokey', DOCUMENTS_SCHEMA)})) AS bytes,
      CAST(1 AS BIGINT) AS numeric_cols, CAST(3 AS BIGINT) AS categorical_cols, CAST(0 AS BIGINT) AS datetime_cols,
      CAST(0 AS BIGINT) AS other_cols""")
R.add("table_overview_lineitem", on("lineitem_nulls", quality.table_overview), f"""
    SELECT (SELECT count(*) FROM lineitem) AS rows, CAST(11 AS BIGINT) AS cols,
      (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source('lineitem_nulls')}))
        AS duplicates,
      (SELECT {big('sum(bytes)')} FROM ({bytes_sql('lineitem_nulls', LINEITEM_SCHEMA)})) AS bytes,
      CAST(8 AS BIGINT) AS numeric_cols, CAST(2 AS BIGINT) AS categorical_cols, CAST(1 AS BIGINT) AS datetime_cols,
      CAST(0 AS BIGINT) AS other_cols""")
R.add("estimated_bytes", on("lineitem_nulls", quality.estimated_bytes), bytes_sql("lineitem_nulls", LINEITEM_SCHEMA))
R.add("missing_by_column", on("lineitem_nulls", quality.missing_by_column),
      "SELECT * FROM (" + per_column("lineitem_nulls", LINEITEM, lambda c:
          f"count(*) - count({c}) AS missing, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct")
      + ") WHERE missing > 0")

_cells = " + ".join(f"count(*) - count({c})" for c in LINEITEM)
R.add("missing_totals", on("lineitem_nulls", quality.missing_totals), f"""
    SELECT missing_cells, total_cells, {pct('total_cells - missing_cells', 'total_cells')} AS completeness_pct
    FROM (SELECT {big(_cells)} AS missing_cells, count(*) * {len(LINEITEM)} AS total_cells
          FROM {source('lineitem_nulls')})""")
_whole = " AND ".join(f"{c} IS NOT NULL" for c in LINEITEM)
R.add("complete_rows", on("lineitem_nulls", quality.complete_rows), f"""
    SELECT rows, complete_rows, {pct('complete_rows', 'rows')} AS complete_pct
    FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE {_whole}) AS complete_rows
          FROM {source('lineitem_nulls')})""")
R.add("missing_matrix", on("lineitem_nulls", lambda df: quality.missing_matrix(
          df, "l_orderkey", ["l_tax", "l_discount", "l_returnflag"], 20)), f"""
    WITH t AS (SELECT * FROM {source('lineitem_nulls')}),
    e AS (SELECT CAST(min(l_orderkey) AS DOUBLE) AS lo, CAST(max(l_orderkey) AS DOUBLE) AS hi FROM t),
    b AS (SELECT t.*, CAST(least(floor((CAST(l_orderkey AS DOUBLE) - lo) * 20.0 / (hi - lo)), 19) AS BIGINT) AS block
          FROM t, e)
    """ + union([f"""SELECT block, '{c}' AS "column", count(*) AS rows,
        {rnd(f'CAST(count(*) - count({c}) AS DOUBLE) / count(*)', 4)} AS missing_share FROM b GROUP BY block"""
                 for c in ("l_tax", "l_discount", "l_returnflag")]))
R.add("missing_patterns", on("lineitem_nulls", quality.missing_patterns), f"""
    SELECT concat_ws(',', CASE WHEN l_discount IS NULL THEN 'l_discount' END, CASE WHEN l_tax IS NULL THEN 'l_tax' END,
                     CASE WHEN l_returnflag IS NULL THEN 'l_returnflag' END) AS pattern,
      {big('(l_discount IS NULL)::INT + (l_tax IS NULL)::INT + (l_returnflag IS NULL)::INT')} AS missing_cols,
      count(*) AS rows
    FROM {source('lineitem_nulls')} GROUP BY 1, 2""")
R.add("duplicate_count", on("documents_nokey", quality.duplicate_count), """
    SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents))
      AS duplicates""")
R.add("duplicate_rows", on("documents_nokey", quality.duplicate_rows), """
    SELECT text, lang, source, n_chars, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1""")
R.add("duplicate_rows_by_key", on("documents", lambda df: quality.duplicates_by_key(df, "doc_id")), """
    SELECT doc_id, first_key, copies FROM (
      SELECT doc_id, min(doc_id) OVER w AS first_key, count(*) OVER w AS copies FROM documents
      WINDOW w AS (PARTITION BY text, lang, source, n_chars)) WHERE doc_id > first_key""")
_tokens = quality.PLACEHOLDER_TOKENS
R.add("placeholders", on("orders_tokens", quality.placeholders), "SELECT * FROM (" + union([
    f"""SELECT '{c}' AS "column", '{t}' AS token, count(*) FILTER (WHERE lower(trim({c})) = '{t.lower()}') AS count
        FROM {source('orders_tokens')}""" for c in ("o_orderstatus", "o_orderpriority") for t in _tokens])
    + ") WHERE count > 0")
R.add("invalid_zeros", on("lineitem_nulls", quality.invalid_zeros), per_column(
    "lineitem_nulls", LINEITEM_NUMBERS, lambda c: f"""count(*) FILTER (WHERE {c} = 0) AS zeros,
        {pct(f'count(*) FILTER (WHERE {c} = 0)', 'count(*)')} AS zero_pct"""))


def _filled(how: str):
    def work(df):
        out = quality.impute(df.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], how)
        return out.select("l_orderkey", "l_linenumber", *[
            F.round(c, 8).alias(c) for c in ("l_discount", "l_tax")])
    return work


for _how, _fn in (("mean", "avg"), ("median", "median")):
    R.add(f"impute_{_how}" if _how == "median" else "impute", on("lineitem_nulls", _filled(_how)), f"""
        WITH t AS (SELECT * FROM {source('lineitem_nulls')}),
        f AS (SELECT {_fn}(l_discount) AS d, {_fn}(l_tax) AS x FROM t)
        SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, d), 8) AS l_discount,
               round(coalesce(l_tax, x), 8) AS l_tax FROM t, f""")
R.add("nunique", on("lineitem_nulls", quality.nunique), per_column(
    "lineitem_nulls", LINEITEM, lambda c: f"count(DISTINCT {c}) AS nunique"))

# quality score of documents without key: no missing cells, some duplicates, a skewed length, uneven languages
_doc_facts = """
    n AS (SELECT count(*) AS rows FROM documents),
    dup AS (SELECT (SELECT rows FROM n) - count(*) AS d FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)),
    sk AS (SELECT CASE WHEN abs(round_even(skewness(n_chars) * 1e3, 0) / 1e3) > 1 THEN 1 ELSE 0 END AS s FROM documents),
    bal AS (SELECT 'lang' AS c, count(*) AS classes, min(k) AS lo, max(k) AS hi
            FROM (SELECT lang, count(*) AS k FROM documents GROUP BY lang)
            UNION ALL SELECT 'source', count(*), min(k), max(k)
            FROM (SELECT source, count(*) AS k FROM documents GROUP BY source)
            UNION ALL SELECT 'text', count(*), min(k), max(k)
            FROM (SELECT text, count(*) AS k FROM documents GROUP BY text)),
    imb AS (SELECT count(*) FILTER (WHERE classes BETWEEN 2 AND 20 AND lo / hi < 0.2) AS i,
                   count(*) FILTER (WHERE classes > 50) AS h FROM bal),
    q AS (SELECT """ + rnd("100.0 * (1 - (0.25 * d / rows + 0.15 * s))", 1) + """ AS score, i, h, s, rows
          FROM n, dup, sk, imb)"""
R.add("quality_score", on("documents_nokey", quality.quality_score), f"""WITH {_doc_facts}
    SELECT score, CASE WHEN (i > 0)::INT + (h > 0)::INT + (s > 0)::INT <= 1 THEN 'low' ELSE 'medium' END AS complexity,
      concat_ws(',', CASE WHEN i > 0 THEN 'imbalance' END, CASE WHEN h > 0 THEN 'high_cardinality' END,
                CASE WHEN s > 0 THEN 'skewed_distribution' END) AS risk_flags FROM q""")
R.add("readiness_score", on("documents_nokey", quality.readiness_score), f"""WITH {_doc_facts},
    b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
    o AS (SELECT {pct('count(*) FILTER (WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1))',
                      'count(*)')} AS p FROM documents, b),
    r AS (SELECT (CASE WHEN count(DISTINCT text) > 0.9 * count(*) OR count(DISTINCT text) <= 1 THEN 1 ELSE 0 END)
            + (CASE WHEN count(DISTINCT lang) > 0.9 * count(*) OR count(DISTINCT lang) <= 1 THEN 1 ELSE 0 END)
            + (CASE WHEN count(DISTINCT source) > 0.9 * count(*) OR count(DISTINCT source) <= 1 THEN 1 ELSE 0 END)
            + (CASE WHEN count(DISTINCT n_chars) > 0.9 * count(*) OR count(DISTINCT n_chars) <= 1 THEN 1 ELSE 0 END) AS k
          FROM documents)
    SELECT score, {rnd('greatest(0.0, 0.7 * score + 30.0 * (1 - k / 4.0) - p)', 1)} AS readiness FROM q, o, r""")
