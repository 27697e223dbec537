"""Source divergence audit: how far the term shares of the sources of a language lie apart, priced by sparse merges of pairs.

Terms are counted within the tasks that read the texts. Each source is then a sorted array of (term id, count), cut into blocks of
a few thousand terms, and every pair of sources of a language is priced block by block from those two arrays alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.llm.shared import keep, ship

#: A term counts for a language if so many of its documents hold it.
MIN_DOCS = 30
#: Added to each count of a kept term, and what all shares of a group add up to (but for 1 a term and rounding).
SMOOTH, UNIT = 5, 1_000_000_000
#: Terms with the most excess that a group reports.
TOP = 50
#: About so many terms make a block; a task holds the blocks of two tiles of sources.
BLOCK_TERMS = 1 << 12
TILE = 8
#: Different (group, term) entries that a task counts before it hands them on.
COUNTED_AT_ONCE = 600_000

#: ASCII letters in lower case and all bytes of other characters stay, everything else parts terms.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GROUP = ["lang", "source"]


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: maximal runs of ASCII letters, lower-cased, and of characters beyond ASCII."""
    return text.translate(_PARTS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows; a row without a term names each group that was seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    fresh = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            found = list(times)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(found) + 1), pa.string()), pa.array([source] * (len(found) + 1), pa.string()),
                pa.array([*found, None], pa.binary()).cast(pa.string()),
                pa.array([*times.values(), 0], pa.int64()), pa.array([*(docs[t] for t in found), 0], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(times)
            words = terms(text.as_py())
            times.update(words)
            docs.update(set(words))
            fresh += len(times) - before
            if fresh > COUNTED_AT_ONCE:
                yield from handed_on()
                fresh = 0
    yield from handed_on()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term for each group.

    Null texts, languages and sources are ''. Every row is a document, repeated ones too.
    """
    read = docs.select(*(F.coalesce(F.col(given).cast("string"), F.lit("")).alias(name)
                         for name, given in (("lang", lang), ("source", source), ("text", text))))
    found = ship(read).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), exact up to totals of 9 * 10 ** 15.

    A long division by three steps of a factor 1000, so that no product leaves 64 bits; 1 where nothing is kept.
    """
    whole = total + SMOOTH * kept
    rest, out = count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = rest * 1000 % whole
    return F.when(kept > 0, out + 1).otherwise(1)


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for an array of counts of one group."""
    whole = np.int64(total + SMOOTH * kept)
    rest, out = counts.astype(np.int64) + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return out + 1


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """First place in ``hay`` not below each needle; both ascending.

    Each needle starts at the place of an anchor some needles before it, strides double until they reach it, halves close in. So
    the work follows the distances between neighbours, not the length of ``hay``.
    """
    step = 64
    low = np.repeat(np.searchsorted(hay, needles[::step]), step)[:len(needles)]
    if not len(hay):
        return low
    last, stride = len(hay) - 1, np.ones(len(needles), np.int64)
    behind = np.nonzero((low <= last) & (hay[np.minimum(low, last)] < needles))[0]
    high = low.copy()
    while len(behind):                                   # low is below the needle, high is not yet known to be
        high[behind] = np.minimum(low[behind] + stride[behind], last + 1)
        reached = hay[np.minimum(high[behind], last)] < needles[behind]
        behind = behind[reached & (high[behind] <= last)]
        low[behind] = high[behind]
        stride[behind] *= 2
    open_ = np.nonzero(low < high)[0]
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = hay[middle] < needles[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def merged(ids_a: np.ndarray, of_a: np.ndarray, none_a: int, ids_b: np.ndarray, of_b: np.ndarray, none_b: int) -> tuple[int, int]:
    """Sum of |share in a - share in b| over the terms that a or b holds, and how many these are.

    ``ids`` are ascending, ``of`` the shares of these terms, ``none`` the share of a term that the group lacks. The shorter array
    gallops through the longer one; terms of one side alone are priced from what the overlap leaves of each side.
    """
    if len(ids_a) > len(ids_b):
        return merged(ids_b, of_b, none_b, ids_a, of_a, none_a)
    at = gallop(ids_a, ids_b)
    hit = at < len(ids_b)
    hit[hit] = ids_b[at[hit]] == ids_a[hit]
    both = np.abs(of_a[hit] - of_b[at[hit]]).sum()
    alone_a = np.abs(of_a[~hit] - none_b).sum()
    alone_b = np.abs(of_b - none_a).sum() - np.abs(of_b[at[hit]] - none_a).sum()
    return int(both + alone_a + alone_b), len(ids_a) + len(ids_b) - int(hit.sum())


_PRICED = "lang string, a string, b string, kept long, apart long, seen long, value long"


def _pair_task(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Prices of one block between the sources of two tiles; ``apart`` is the price of a term that both lack."""
    def ready(rows: pd.DataFrame) -> list:
        return [(no, source, kept, ids, shares(np.asarray(ns), total, kept), int(shares(np.zeros(1), total, kept)[0]))
                for no, source, kept, total, ids, ns in zip(rows["no"], rows["source"], rows["kept"], rows["total"], rows["ids"], rows["ns"])]

    out = []
    others = ready(right)
    for no, a, kept, ids, of, none in ready(left):
        for other, b, _, ids_b, of_b, none_b in others:
            if no < other:
                value, seen = merged(ids, of, none, ids_b, of_b, none_b)
                out.append((key[0], a, b, kept, abs(none - none_b), seen, value))
    return pd.DataFrame(out, columns=["lang", "a", "b", "kept", "apart", "seen", "value"])


def pair_prices(arrays: DataFrame) -> DataFrame:
    """(lang, a, b, value): the distance of every unordered pair of sources of a language.

    ``arrays`` holds (lang, source, no, tile, tiles, total, kept, block, ids, ns). The task of two tiles and a block co-groups the
    arrays of both tiles, at most 2 * ``TILE`` of them; a pair's price is the sum over the blocks, and the terms that both lack
    are priced once, at the end.
    """
    left = arrays.withColumn("other", F.explode(F.sequence("tile", F.col("tiles") - 1)))
    right = arrays.select(*(F.col(c).alias("other" if c == "tile" else c) for c in arrays.columns)).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.col("other"))))
    task = ["lang", "tile", "other", "block"]
    priced = left.filter("kept > 0").groupBy(*task).cogroup(right.filter("kept > 0").groupBy(*task)).applyInPandas(_pair_task, _PRICED)
    return priced.groupBy("lang", "a", "b").agg(
        (F.sum("value") + F.max("apart") * (F.max("kept") - F.sum("seen"))).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language.

    Part ``pair`` has every other source of the language, by the summed distance of the shares of all kept terms (0 if nothing is
    kept). Part ``term`` has the ``TOP`` terms that the source holds with the largest excess over the language as a whole. Ranks go
    by falling value, then by the item's bytes. Null texts, languages and sources are ''; every row is a document; an empty
    table gives no rows, a source without a term its pairs, a language's only source its terms.
    """
    counts = keep(term_counts(docs, text, lang, source))
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= MIN_DOCS)
    blocks = F.greatest(F.ceil(kept.agg(F.count("*")).scalar() / BLOCK_TERMS), F.lit(1)).cast("int")
    inside = W.partitionBy("lang", "block").orderBy("term")          # about BLOCK_TERMS rows
    kept = keep(kept.withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int")).withColumn("id", F.row_number().over(inside)))
    held = keep(counts.join(kept.select("lang", "term", "c", "block", "id"), ["lang", "term"]))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("c").alias("lang_total"))
    of_group = held.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    numbers = ("kept", "lang_total", "total")
    in_lang = W.partitionBy("lang")                                  # a row for each source: their pairs are the result
    groups = keep(
        counts.filter("term IS NULL").select(*_GROUP).join(of_lang, "lang", "left").join(of_group, _GROUP, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers})
        .withColumn("no", F.row_number().over(in_lang.orderBy("source")) - 1)
        .withColumn("tile", F.call_function("div", F.col("no"), F.lit(TILE)).cast("int"))
        .withColumn("tiles", F.max("tile").over(in_lang) + 1))

    sparse = held.groupBy(*_GROUP, "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("of"))
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(kept.agg(F.max("block")).scalar(), F.lit(0)))))
    arrays = every.join(sparse, [*_GROUP, "block"], "left").select(
        *_GROUP, "no", "tile", "tiles", "total", "kept", "block",
        *(F.coalesce(F.col("of")[f], F.array().cast(f"array<{t}>")).alias(n) for n, f, t in (("ids", "id", "int"), ("ns", "n", "long"))))
    prices = pair_prices(arrays)
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                            F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    other = groups.select("lang", F.col("source").alias("item"), F.col("kept").alias("other_kept"))
    bare = groups.filter("kept = 0").select(*_GROUP).join(other.filter("other_kept = 0"), "lang").filter("source <> item").select(
        *_GROUP, "item", F.lit(0).cast("long").alias("value"))
    pairs = prices.select("lang", "value", ways).select(*_GROUP, "item", "value").unionByName(bare)

    excess = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("c"), F.col("lang_total"), F.col("kept"))
    over = held.join(groups.select(*_GROUP, *numbers), _GROUP).select(*_GROUP, F.col("term").alias("item"), excess.alias("value")).filter("value > 0")
    ranked = W.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return (
        pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
        .unionByName(over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP).withColumn("part", F.lit("term")))
        .select(*_GROUP, "part", "item", "value", "rank"))
