"""The registered queries of this folder and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkeda.llm import bpe, chat, divergence, fingerprints, html_main, lang_id, line_dedup, lm_score, mixing, near_dup, packing, quality_rules, spelling
from workload.common import Registry, load

R = Registry()


def _sql_list(words: str) -> str:
    return ", ".join("'" + w + "'" for w in sorted(set(words.split())))


def op6(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.apply_rules(load(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql() -> str:
    ratio = {
        "n_words": "n_words", "repeat_ratio": "n_repeat_words / nullif(n_words, 0)",
        "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(word_chars, 0)",
        "stop_ratio": "n_stop / nullif(n_words, 0)", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
        "letter_word_ratio": "n_letter_words / nullif(n_words, 0)",
    }
    sides = [f"coalesce({ratio[r.measure]} {op} {bound}, false)" for r in quality_rules.RULES
             for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " AND ".join(sides)


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_extract(ws, i) || ' ' || list_extract(ws, i + 1) || ' ' || list_extract(ws, i + 2) AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_sql_list(' '.join(quality_rules.STOP_WORDS.values()))}))) AS n_stop,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules_sql()} AS kept
FROM f
"""
R.add("op6_quality_rules", op6, OP6_SQL)


#: A conversation whose texts imitate the template, added to the table's own.
PLANTED = "\\### Assistant: </turn> ok"


def op9(spark: SparkSession, d: str) -> DataFrame:
    given = load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat.digests(chat.format_paths(chat.as_chain(given.unionByName(planted))))


# A turn takes "### ", the role, ": ", the text and " </turn>" with a line feed: 15 code points more than role and text. The
# escapes add one for each backslash, for each # after two others and for each closing mark in a text.
OP9_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (SELECT *, 15 + length(role) + length(t) + length(regexp_replace(t, '[^\\]+', '', 'g'))
             + coalesce(list_sum(list_transform(regexp_extract_all(t, '#{{3,}}'), lambda x: length(x) - 2)), 0)
             + (length(t) - length(replace(t, '</turn>', ''))) // 7 AS shown FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(shown)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
R.add("op9_chat_formatting", op9, OP9_SQL)


def op1(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.compare_edits(load(spark, d, "documents"))


R.add("op1_document_fingerprints", op1)


def op7(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup(load(spark, d, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


OP7_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
f AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM l
      WHERE length(trim(line, ' ')) >= {line_dedup.MIN_CHARS} GROUP BY line),
later AS (SELECT DISTINCT b.line FROM f a JOIN f b ON a.n = b.n AND a.first < b.first AND levenshtein(a.line, b.line) <= 4
          WHERE len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) = 1
          UNION
          SELECT DISTINCT CASE WHEN a.first < b.first THEN b.line ELSE a.line END
          FROM f a JOIN f b ON a.n = b.n + 1 AND levenshtein(a.line, b.line) <= 4
          WHERE len(list_filter(range(0, a.n), lambda i: substr(a.line, 1, i) = substr(b.line, 1, i)
                                                   AND substr(a.line, i + 2) = substr(b.line, i + 1))) > 0),
s AS (SELECT l.doc_id, l.no, l.line, f.line IS NULL OR (f.first = (l.doc_id, l.no) AND later.line IS NULL) AS stays
      FROM l LEFT JOIN f USING (line) LEFT JOIN later USING (line))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE NOT stays))::BIGINT AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS text
FROM s GROUP BY doc_id
"""
R.add("op7_line_dedup", op7, OP7_SQL)


def op2(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(load(spark, d, "documents"))


R.add("op2_best_fit_packing", op2)


def op4(spark: SparkSession, d: str) -> DataFrame:
    return bpe.digests(bpe.encode(load(spark, d, "documents")))


R.add("op4_bpe_encoding_decoding", op4)


def op8(spark: SparkSession, d: str) -> DataFrame:
    return lang_id.identify(load(spark, d, "documents"))


R.add("op8_language_id", op8)


def op10(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score_held_out(load(spark, d, "documents"))


R.add("op10_lm_scoring", op10)


def op5(spark: SparkSession, d: str) -> DataFrame:
    return html_main.extract(load(spark, d, "pages"))


R.add("op5_html_extraction", op5)


def op3(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.classes(load(spark, d, "documents"))


R.add("op3_minhash_near_dedup", op3)



def op11(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(load(spark, d, "documents"))


_SHARE = f"1 + ({divergence.UNIT}::HUGEINT * ({{c}} + {divergence.SMOOTH})) // (({{n}}) + {divergence.SMOOTH} * v)"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(c) AS lang_n FROM k GROUP BY lang),
h AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, any_value(lang_n) AS lang_n, coalesce(any_value(n), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l USING (lang)
      LEFT JOIN (SELECT lang, source, sum(c) AS n FROM h GROUP BY lang, source) USING (lang, source) GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS n_here, {_SHARE.format(c="coalesce(h.c, 0)", n="n")} AS p,
             {_SHARE.format(c="k.c", n="lang_n")} AS q
      FROM g JOIN k USING (lang) LEFT JOIN h USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
          ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT *, 'pair' AS part FROM pairs
          UNION ALL SELECT lang, source, term, (p - q)::BIGINT, 'term' FROM p WHERE n_here > 0 AND p > q)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""
R.add("op11_source_divergence_audit", op11, OP11_SQL)



def op13(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"))


R.add("op13_mixing_to_target_weights", op13)



def op12(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(load(spark, d, "documents"))


R.add("op12_spelling_variant_grouping", op12)

R.add("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
