"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import WORD, texts

#: Function words that running text of these languages cannot do without. All are written in Latin letters.
STOP_WORDS = {
    "en": "a and are as at be by for from in is it of on or that the this to was with",
    "fr": "au aux avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une",
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
    "it": "al alla che con da dei del della di gli il in la le nel non per più si sono un una",
    "pt": "ao as com da das de do dos em mais na não no os para por que se um uma",
    "nl": "aan de dat die een en het in is met niet op te van voor zijn",
    "sv": "att av den det en ett för med och om på som till var är",
    "da": "af at de den der det en er et for fra med og på som til",
    "no": "av det en er et for fra har i med og på som til å",
    "fi": "että hän ja joka kun mutta myös ne niin oli olla on ovat se tai",
    "pl": "do i jak jest na nie od po przez się to w z za że",
    "cs": "a ale do i jako je na o po s se to v z za že",
    "hu": "a az egy ez és hogy is meg nem volt",
    "ro": "a care cu de din este în la mai nu o pe pentru și un",
    "tr": "bir bu da daha de için ile olan olarak ve",
    "hr": "a da i iz je na od s se su u za",
    "id": "adalah dan dari dengan di ini itu ke oleh pada untuk yang",
    "vi": "cho có của không là một người những trong và với được",
}


class Rule(NamedTuple):
    """A document passes if low <= measure <= high; None leaves that side open."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: Measures are those of ``measures``. A document stays if it passes every row.
RULES = (
    Rule("long_enough", "n_words", 50, None),
    Rule("few_repeated_windows", "repeat_ratio", None, 0.5),
    Rule("usual_word_length", "mean_word_chars", 2.0, 16.0),
    Rule("few_symbols", "symbol_ratio", None, 0.05),
    Rule("some_stop_words", "stop_ratio", 0.05, None),
    Rule("few_equal_lines", "dup_line_ratio", None, 0.6),
    Rule("mostly_letters", "letter_word_ratio", 0.6, None),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words stand in a window of three words that the text has at least twice.

    Windows are compared by a 64-bit hash. Where all differ the answer is 0; else they are sorted with their places, and a
    repeated window equals a neighbour in that order. The places, sorted again, each add up to three words less the overlap
    with the next place.
    """
    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashed, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def places(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        found = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("bigint"), lambda a, x: a + x)

    return _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
        _let(_let(places(h), again), covered)))


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``, not null) without the text and with the counts."""
    stops = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    long = lambda c: c.cast("bigint")
    return rows.withColumns({"words": words, "lines": lines}).select(
        *(c for c in rows.columns if c != "text"),
        long(F.size("words")).alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        long(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _let(F.col("words"), _repeated).alias("n_repeat_words"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(stops)))).alias("n_stop"),
        long(F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))).alias("n_letter_words"),
        long(F.size(F.filter("words", lambda w: w.rlike(r"\p{IsLatin}")))).alias("n_latin_words"),
    )


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_letter_words, n_latin_words), all long.

    One row per row of ``docs``, repeated ones too; null text counts as empty and gives zeros.
    """
    return _counted(texts(docs, key, text))


def measures() -> dict[str, Column]:
    """Name to expression over the columns of ``counts``; a ratio without a base is null and passes no bound."""
    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    return {
        "n_words": F.col("n_words"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "stop_ratio": over("n_stop", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "letter_word_ratio": over("n_letter_words", "n_words"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the columns of ``counts``.

    A lower bound on stop words says nothing of a text most of whose words are in other letters than the lists; it passes there.
    """
    known = measures()
    passed = F.lit(True)
    for rule in rules:
        value = known[rule.measure]
        if rule.low is not None:
            enough = F.coalesce(value >= rule.low, F.lit(False))
            if rule.measure == "stop_ratio":
                enough = enough | (2 * F.col("n_latin_words") < F.col("n_letter_words"))
            passed = passed & enough
        if rule.high is not None:
            passed = passed & F.coalesce(value <= rule.high, F.lit(False))
    return passed


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``counts`` plus base_failed (too short or too repetitive) and kept.

    Null and empty texts fail, an empty table gives an empty table, and other columns of ``docs`` are not read.
    """
    return counts(docs, key, text).withColumns({"base_failed": _failed(), "kept": ~_failed() & verdict(rules)})


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _counted(rows).filter(~_failed() & verdict(rules)).select("row.*")
