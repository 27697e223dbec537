"""Catalog search and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.operators import catalog as cat
from sparkeda.operators import chatlog
from workload.common import DERIVED, Registry, big, load, on, rnd, source

R = Registry()
C = source("catalog")
Q = "the"
_has = "(contains(lower(title), '{0}') OR contains(lower(coalesce(description, '')), '{0}'))".format
_short = """CASE WHEN description IS NULL OR description = '' THEN 'No description'
    ELSE substring(description, 1, 200) || '...' END"""

R.add("keyword_filter", on("catalog", lambda df: cat.keyword_filter(df, "TION")), f"SELECT * FROM {C} WHERE {_has('tion')}")
R.add("search_source", on("catalog", lambda df: cat.search_source(df, "src0", Q)), f"""
    SELECT * REPLACE ({_short} AS description) FROM {C} WHERE source = 'src0' AND {_has(Q)}
    ORDER BY stars DESC, title, url LIMIT 20""")


def _related(spark: SparkSession, d: str) -> DataFrame:
    """Part names that go with each part type, weighted by how often: a thesaurus out of the parts table."""
    return load(spark, d, "part").groupBy(F.col("p_type").alias("term"), F.col("p_name").alias("related")).agg(
        F.count("*").alias("weight"))


R.add("expand_query", lambda s, d: cat.expand_query(
          load(s, d, "part").select(F.col("p_type").alias("query")), _related(s, d)), """
    WITH q AS (SELECT DISTINCT replace(replace(lower(p_type), ' & ', ' '), '&', '') AS query FROM part),
    t AS (SELECT lower(p_type) AS query, p_name AS related, count(*) AS weight FROM part GROUP BY 1, 2),
    r AS (SELECT q.query, related, row_number() OVER (PARTITION BY q.query ORDER BY weight DESC, related) AS position
          FROM q JOIN t ON q.query = t.query WHERE lower(related) <> q.query)
    SELECT query, CAST(0 AS BIGINT) AS position, query AS term, true AS runs FROM q
    UNION ALL SELECT query, position, related, true FROM r""")
R.add("expand_query_few", lambda s, d: cat.expand_query(
          load(s, d, "part").select(F.col("p_type").alias("query")), _related(s, d), 5, 2), """
    WITH q AS (SELECT DISTINCT replace(replace(lower(p_type), ' & ', ' '), '&', '') AS query FROM part),
    t AS (SELECT lower(p_type) AS query, p_name AS related, count(*) AS weight FROM part GROUP BY 1, 2),
    r AS (SELECT q.query, related, row_number() OVER (PARTITION BY q.query ORDER BY weight DESC, related) AS position
          FROM q JOIN t ON q.query = t.query WHERE lower(related) <> q.query)
    SELECT query, CAST(0 AS BIGINT) AS position, query AS term, true AS runs FROM q
    UNION ALL SELECT query, position, related, position < 2 FROM r WHERE position <= 5""")


def hits_sql(listed: str = "src19", queries: tuple[str, ...] = ("the", "der")) -> str:
    each = " UNION ALL ".join(f"SELECT *, CAST({i} AS BIGINT) AS query_no FROM {C} WHERE {_has(q)}" for i, q in enumerate(queries))
    return f"""
    SELECT h.* EXCLUDE (rank) REPLACE ({_short} AS description),
      row_number() OVER (PARTITION BY source ORDER BY query_no, rank) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY source, query_no ORDER BY stars DESC, title, url) AS rank FROM (
          {each}) WHERE source <> '{listed}') h
    WHERE rank <= 5
    UNION ALL SELECT * REPLACE ({_short} AS description), CAST(0 AS BIGINT) AS query_no, CAST(NULL AS BIGINT) AS position
    FROM {C} WHERE source = '{listed}' AND {_has('the')}"""


def _hits(df: DataFrame) -> DataFrame:
    return cat.search_all(df, ["the", "der", "tion"], 10, ["src19"])


R.add("search_all", on("catalog", _hits), hits_sql("src19", ("the", "der", "tion")))
_score = f"""(CASE WHEN contains(lower(title), 'the') THEN 2.0 ELSE 0 END)
    + (CASE WHEN contains(lower(description), 'the') THEN 1.0 ELSE 0 END)
    + (CASE WHEN contains(lower(title), 'data') THEN 2.0 ELSE 0 END)
    + (CASE WHEN contains(lower(description), 'data') THEN 1.0 ELSE 0 END)
    + log10(CAST(stars AS DOUBLE) + 1.0) / 10 + (CASE WHEN description <> 'No description' THEN 0.5 ELSE 0 END)"""
R.add("rank_results", on("catalog", lambda df: cat.rank_results(
          cat.search_all(df, ["the", "der"], 10), "the data")), f"""
    WITH h AS ({hits_sql('none')}), s AS (SELECT *, {rnd(_score, 4)} AS score FROM h)
    SELECT *, row_number() OVER (ORDER BY score DESC, source, position, title, url) AS rank FROM s
    QUALIFY rank <= 15""")
R.add("source_counts", lambda s, d: cat.source_counts(
          cat.search_all(DERIVED["catalog"](s, d), ["tion"], 10), load(s, d, "documents")), f"""
    WITH h AS (SELECT source, least(count(*), 5) AS hits FROM {C} WHERE {_has('tion')} GROUP BY 1)
    SELECT d.source, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN h ON d.source = h.source
    UNION ALL SELECT 'TOTAL', {big('sum(hits)')} FROM h""")

R.add("session_titles", on("conversations", chatlog.session_titles), """
    SELECT conv_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS title
    FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)""")
R.add("recent_context", on("conversations", chatlog.recent_context), """
    SELECT conv_id, count(*) AS messages,
      string_agg(role || ': ' || substring(text, 1, 200) || '...', chr(10) ORDER BY turn) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    WHERE back <= 6 GROUP BY 1""")
R.add("session_summary", on("conversations", chatlog.session_summary), f"""
    SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, min(turn) AS first_turn,
      max(turn) AS last_turn, {big('sum(length(text))')} AS characters FROM conversations GROUP BY 1""")
R.add("route_requests", on("conversations", chatlog.route_requests), f"""
    SELECT conv_id, turn, regexp_matches(lower(text), '{'|'.join(chatlog.CHART_WORDS)}') AS needs_visualization,
      regexp_matches(lower(text), '{'|'.join(chatlog.CHART_WORDS_SHORT)}') AS needs_visualization_short
    FROM conversations WHERE role = 'user'""")
LOG = source("conversations_code")
_all = lambda p: f"regexp_extract_all(text, '{p}', 1)"
_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
R.add("extract_code_blocks", on("conversations_code", chatlog.extract_code_blocks), f"""
    WITH b AS (SELECT conv_id, turn, CASE WHEN len({_all(chatlog.PYTHON_FENCE)}) > 0 THEN {_all(chatlog.PYTHON_FENCE)}
        ELSE {_all(chatlog.ANY_FENCE)} END AS blocks FROM {LOG} WHERE contains(text, '```'))
    SELECT conv_id, turn, CAST(i AS BIGINT) AS block, {_trim('blocks[i + 1]')} AS code
    FROM (SELECT *, unnest(range(len(blocks))) AS i FROM b)""")
_prose = "(regexp_matches({x}, '^\\p{{Lu}}') AND NOT regexp_matches({x}, '" + "|".join(m.replace(".", "[.]") for m in chatlog.CODE_MARKS) + "'))"
R.add("answer_code", on("conversations_code", chatlog.answer_code), f"""
    WITH t AS (SELECT conv_id, turn, {_trim('text')} AS whole, {_all(chatlog.PYTHON_FENCE)}[1] AS a, {_all(chatlog.ANY_FENCE)}[1] AS b FROM {LOG}),
    l AS (SELECT *, string_split(whole, chr(10)) AS lines FROM t WHERE whole <> ''),
    e AS (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l),
    x AS (SELECT conv_id, turn, whole, coalesce(a, b) AS block, i, lines[i] AS line, {_trim('lines[i]')} AS s FROM e),
    f AS (SELECT *, starts_with(s, '```') AS fence,
            coalesce(sum(starts_with(s, '```')::INT) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM x),
    g AS (SELECT *, min(i) FILTER (WHERE NOT fence AND (before % 2 = 1 OR NOT {_prose.format(x='s')})) OVER (PARTITION BY conv_id, turn) AS first FROM f),
    h AS (SELECT conv_id, turn, any_value(block) AS block, any_value(whole) AS whole,
            string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT fence AND i >= first) AS kept FROM g GROUP BY conv_id, turn)
    SELECT conv_id, turn, CASE WHEN block IS NOT NULL THEN {_trim('block')} WHEN kept IS NOT NULL THEN {_trim('kept')} ELSE whole END AS code FROM h""")
R.add("extract_json_payloads", on("conversations_code", chatlog.extract_json_payloads), f"""
    WITH t AS (SELECT conv_id, turn, list_transform(list_concat([text], {_all(chatlog.JSON_FENCE)}, {_all(chatlog.BRACES)}),
        lambda x: {_trim('x')}) AS tries FROM {LOG}),
    v AS (SELECT conv_id, turn, list_filter(tries, lambda x: x <> '' AND json_valid(x))[1] AS payload FROM t)
    SELECT * FROM v WHERE payload IS NOT NULL""")
