"""Jobs over a table of conversations ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that ask for a chart, and the shorter list used when planning fails.
CHART_WORDS = ["plot", "chart", "graph", "visual", "histogram", "scatter", "heatmap", "bar", "pie",
               "boxplot", "violin", "distribution", "show", "draw", "display"]
CHART_WORDS_SHORT = ["plot", "chart", "graph", "visual", "hist", "scatter", "bar", "heatmap"]
TITLE_CHARS, RECENT, RECENT_CHARS = 50, 6, 200

# Fenced code, fenced JSON and brace patterns.
PYTHON_FENCE = r"(?s)```python\s*\n(.*?)```"
ANY_FENCE = r"(?s)```\s*\n(.*?)```"
# A line that starts with a capital is prose unless it holds one of these.
CODE_MARKS = ["import", "from ", "result", "df", "plt", "sns", "pd.", "np."]
JSON_FENCE = r"(?s)```json\s*\n(.*?)```"
BRACES = r"(\{[\s\S]*?\})"


def session_titles(log: DataFrame) -> DataFrame:
    """``(conv_id, title)``: the first user message, cut to 50 characters."""
    heads = log.where(F.col("role") == "user").select(
        "conv_id", "turn", F.substring("text", 1, TITLE_CHARS + 1).alias("text"))     # all a title can need
    first = heads.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    cut = F.concat(F.substring("text", 1, TITLE_CHARS), F.lit("..."))
    return first.select("conv_id", F.when(F.length("text") > TITLE_CHARS, cut).otherwise(F.col("text")).alias("title"))


def recent_context(log: DataFrame, messages: int = RECENT, chars: int = RECENT_CHARS) -> DataFrame:
    """``(conv_id, messages, context)``: the last messages as ``role: text...`` lines, oldest first.

    Each task keeps its newest ``messages`` rows per conversation before the shuffle.
    """
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars), F.lit("..."))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"])
    return (
        log.select("conv_id", "turn", line.alias("line"))
        .withColumn("back", F.row_number().over(newest)).where(F.col("back") <= messages)
        .groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_join(lines, "\n").alias("context"))
    )


def session_summary(log: DataFrame) -> DataFrame:
    """``(conv_id, messages, user_messages, first_turn, last_turn, characters)``."""
    return log.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.sum(F.length("text").cast("long")).alias("characters"))


def route_requests(log: DataFrame, words: Sequence[str] = CHART_WORDS, short: Sequence[str] = CHART_WORDS_SHORT) -> DataFrame:
    """``(conv_id, turn, needs_visualization, needs_visualization_short)`` of user messages."""
    text = F.lower("text")
    return log.where(F.col("role") == "user").select(
        "conv_id", "turn", text.rlike("|".join(words)).alias("needs_visualization"),
        text.rlike("|".join(short)).alias("needs_visualization_short"))


def extract_code_blocks(log: DataFrame) -> DataFrame:
    """``(conv_id, turn, block, code)``: fenced blocks, those marked python first choice, else unmarked ones."""
    marked = F.regexp_extract_all("text", F.lit(PYTHON_FENCE), F.lit(1))
    blocks = F.when(F.size(marked) > 0, marked).otherwise(F.regexp_extract_all("text", F.lit(ANY_FENCE), F.lit(1)))
    return (
        log.where(F.contains("text", F.lit("```")))
        .select("conv_id", "turn", F.posexplode(blocks).alias("block", "code"))
        .select("conv_id", "turn", F.col("block").cast("long").alias("block"),
                F.regexp_replace("code", r"^\s+|\s+$", "").alias("code"))
    )


def answer_code(log: DataFrame) -> DataFrame:
    """``(conv_id, turn, code)``: the code that each turn answers with; null and blank texts have none.

    That is the first fenced block, marked ones before others. Without a whole block it is what follows the prose at the start:
    fence lines go, and code begins at the first line that no capital opens, that holds one of ``CODE_MARKS``, or that an
    opening fence precedes. If nothing is left, it is the text.
    """
    tidy = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    block = F.coalesce(*(F.get(F.regexp_extract_all("text", F.lit(fence), F.lit(1)), F.lit(0)) for fence in (PYTHON_FENCE, ANY_FENCE)))
    fenced = lambda x: F.startswith(tidy(x), F.lit("```"))
    marked = "|".join(m.replace(".", r"\.") for m in CODE_MARKS)
    prose = lambda x: tidy(x).rlike(r"^\p{Lu}") & ~tidy(x).rlike(marked)
    opened = lambda i: F.size(F.filter(F.slice("lines", F.lit(1), i), fenced)) % 2 == 1
    starts = F.transform("lines", lambda x, i: ~fenced(x) & (opened(i) | ~prose(x)))
    first = F.array_position(starts, True)
    kept = F.filter(F.when(first > 0, F.slice("lines", F.greatest(first, F.lit(1)).cast("int"), F.size("lines"))), lambda x: ~fenced(x))
    left = F.when(first > 0, tidy(F.array_join(kept, "\n"))).otherwise(F.col("whole"))
    return (
        log.select("conv_id", "turn", "text", tidy(F.col("text")).alias("whole")).where("whole <> ''")
        .select("conv_id", "turn", "whole", block.alias("block"), F.split("whole", "\n", -1).alias("lines"))
        .select("conv_id", "turn", F.when(F.col("block").isNotNull(), tidy(F.col("block"))).otherwise(left).alias("code"))
    )


def extract_json_payloads(log: DataFrame) -> DataFrame:
    """``(conv_id, turn, payload)``: the first text that parses as JSON: all of it, a json fence, then braces."""
    tidy = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tries = F.concat(
        F.array(F.col("text")), F.regexp_extract_all("text", F.lit(JSON_FENCE), F.lit(1)),
        F.regexp_extract_all("text", F.lit(BRACES), F.lit(1)))
    valid = F.filter(F.transform(tries, tidy), lambda t: (t != "") & F.try_parse_json(t).isNotNull())
    return log.select("conv_id", "turn", F.get(valid, F.lit(0)).alias("payload")).where("payload IS NOT NULL")
