"""Mixing sources to target weights: budgets by weight and stock, filled with whole documents by counts of exact lengths.

A source's target is met by full passes over it and a rest. The rest is fitted on the counts of documents by length: a share of
each length near the source's own, then a bounded knapsack over the budget that this leaves. Which documents of a length go is
settled by a seeded order of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.functions.ordering import running_totals
from sparkeda.llm.shared import WORD, keep, ship

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix is so many percent of all words; a document is taken so many times at most.
PERCENT, MOST = 150, 2
#: Budget left to the knapsack, so that it has room to fit; the largest sum that it looks for.
RESERVE, CELLS = 1 << 16, 1 << 20
#: Parts of the seeded order of the documents of one length; only one part of a length is ordered row by row.
PARTS = 1 << 12
SEED = 13

_SOURCE = ["unnamed", "source"]
_LENGTH = [*_SOURCE, "size"]


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(unnamed, source, size, doc_id, lot, copies): documents with their number of words and seeded place.

    Rows equal in key, source and text are one entry with ``copies``. A null text has no word; a null source is ``unnamed``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(source).isNull().alias("unnamed"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.col(key).alias("doc_id"),
        F.xxhash64(F.lit(SEED), F.col(key).cast("string"), body).alias("lot"),
    ).groupBy(*_LENGTH, "doc_id", "lot").agg(F.count("*").alias("copies"))


def weighted(sources: DataFrame) -> DataFrame:
    """Add ``weight``: ``WEIGHTS`` in turn, sources by code point, the unnamed one last. Ranks are taken by ranges of names."""
    named = sources.filter("NOT unnamed").select(F.lit("source").alias("column"), F.col("source").alias("value"), F.lit(1).alias("one"))
    before = running_totals(named, ["one"]).select(F.lit(False).alias("unnamed"), F.col("value").alias("source"), "one_before")
    last = sources.filter("NOT unnamed").agg(F.count("*")).scalar()
    rank = F.when(F.col("unnamed"), last).otherwise(F.col("one_before"))
    turn = F.pmod(rank, F.lit(len(WEIGHTS))).cast("int")
    return sources.join(before, _SOURCE, "left").withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), turn).cast("long")).drop("one_before")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def targets(sources: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source_size, weight): ``percent`` of all sizes dealt by weight, none above ``most`` times its source's size.

    Words per unit of weight rise round by round: what the sources at their limit leave goes to the others, until no other is
    above its limit. A source once at its limit stays there, so rounds end; each brings a row of three sums to the driver, and
    limits are compared in whole numbers.
    """
    limit = _exact(F.col("source_size")) * most
    words, per, known = 0, 1, -1
    while True:
        full = limit * F.lit(100 * per) <= _exact(F.col("weight")) * F.lit(words)
        row = sources.agg(
            F.count_if(full).alias("full"), F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.sum(_exact(F.col("source_size"))).alias("all")).first()
        if row["full"] == known or not row["open"]:
            share = F.col("weight") * F.lit(words / (100 * per))
            return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(share))
        known = row["full"]
        words, per = percent * int(row["all"]) - 100 * int(row["held"] or 0), int(row["open"])


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """How many of each length to take, up to ``counts``, so that their sum is as near to ``wanted`` as any (the lower at a tie).

    A bounded knapsack over the sums up to twice ``wanted``; each reachable sum keeps the item that first reached it. Earlier
    lengths are preferred, and it ends where ``wanted`` is reached.
    """
    taken = np.zeros(len(lengths), np.int64)
    if wanted <= 0:
        return taken
    reached = np.zeros(2 * wanted + 1, bool)
    reached[0] = True
    through = np.zeros(len(reached), np.int32)
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        left, part = min(count, 2 * wanted // length), 1
        while left > 0 and not reached[wanted]:
            copies = min(part, left)
            step = copies * length
            fresh = np.nonzero(reached[:-step] & ~reached[step:])[0] + step
            reached[fresh] = True
            through[fresh] = len(items)
            items.append((i, copies))
            left, part = left - copies, part * 2
        if reached[wanted]:
            break
    sums = np.nonzero(reached)[0]
    at = int(sums[np.argmin(np.abs(sums - wanted))])
    while at > 0:
        i, copies = items[through[at]]
        taken[i] += copies
        at -= copies * int(lengths[i])
    return taken


def fitted(lengths: np.ndarray, counts: np.ndarray, wanted: int, seed: int = SEED) -> np.ndarray:
    """How many of each length to take, up to ``counts``, for a sum near ``wanted``; lengths ascend, none is 0.

    What exceeds ``RESERVE`` is dealt over the lengths in proportion to their counts, rounded down, then by one more document of
    lengths in seeded order. The rest, under ``RESERVE`` and one document, goes to the knapsack, which sees the lengths in the same
    order. Only where a rest beyond ``CELLS`` is left, as with documents of a million words, long ones are taken first.
    """
    whole = int((lengths * counts).sum())
    reserve = min(wanted, RESERVE)
    taken = np.minimum(np.floor(counts * ((wanted - reserve) / max(whole, 1))).astype(np.int64), counts)
    rest = wanted - int((taken * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order.tolist() if rest > reserve else ():
        if taken[i] < counts[i] and rest - lengths[i] >= reserve:
            taken[i] += 1
            rest -= int(lengths[i])
    if rest > CELLS:
        for i in range(len(lengths) - 1, -1, -1):
            more = min(int(counts[i] - taken[i]), (rest - reserve) // int(lengths[i])) if rest > reserve else 0
            taken[i] += more
            rest -= more * int(lengths[i])
    if rest > CELLS:                                     # every document left is longer than the rest less the reserve
        left = np.nonzero(taken < counts)[0]
        if len(left) and lengths[left[0]] < 2 * rest:
            taken[left[0]] += 1
        return taken
    taken[order] += nearest_sum(lengths[order], (counts - taken)[order], rest)
    return taken


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram of lengths: passes over all of it, and documents of each length that go once more."""
    group = group.sort_values("size", ignore_index=True)
    lengths, counts = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64)
    wanted = int(np.floor(group["target"].iloc[0] + 0.5))
    passes, rest = divmod(wanted, int(group["source_size"].iloc[0]))
    return group.assign(passes=passes, extra=fitted(lengths, counts, rest))[["unnamed", "source", "size", "passes", "extra"]]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each document with what the mix takes of it: (doc_id, size, source_size, target, taken, source, times).

    ``taken`` is ``times`` (0 to ``MOST``) the document's number of words; a source's sum is the nearest to its ``target`` that the
    fit finds. Documents without a word are taken 0 times, as is everything of a table without words. Every row gives one row,
    rows equal in key, source and text may differ in ``times``. The same rows give the same mix in any order and partitioning.

    A source's histogram goes to one task; n different lengths need n * n / 2 words, so a source of 10 ** 13 words has 4.5 million
    at most. Documents of one length are ranked in ``PARTS`` parts of their seeded order: whole parts go by their counts.
    """
    entries = keep(sized(docs, key, text, source))
    sources = keep(weighted(entries.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))))
    aims = keep(targets(sources).select(*_SOURCE, "source_size", "target"))
    lengths = ship(entries).groupBy(*_LENGTH).agg(F.sum("copies").alias("docs"))
    plan = lengths.filter("size > 0").join(aims, _SOURCE).groupBy(*_SOURCE).applyInPandas(
        _fit, "unnamed boolean, source string, size long, passes long, extra long")

    dealt = entries.withColumn("part", F.shiftrightunsigned("lot", 64 - (PARTS.bit_length() - 1)))
    whole_parts = W.partitionBy(*_LENGTH).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy(*_LENGTH, "part").agg(F.sum("copies").alias("held")).withColumn(
        "ahead", F.coalesce(F.sum("held").over(whole_parts), F.lit(0)))
    parts = parts.join(plan, _LENGTH, "left").join(aims, _SOURCE).select(
        *_LENGTH, "part", "ahead", "source_size", "target", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("passes", "extra")))
    in_part = W.partitionBy(*_LENGTH, "part").orderBy("lot", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("copies").over(in_part), F.lit(0))).join(parts, [*_LENGTH, "part"])
    again = F.greatest(F.lit(0), F.least(F.col("copies"), F.col("extra") - F.col("ahead") - F.col("inside")))
    rows = ranked.withColumn("again", again).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    times = F.col("passes") + F.when(F.col("copy") <= F.col("again"), 1).otherwise(0)
    return rows.withColumn("times", times.cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"),
        F.when(~F.col("unnamed"), F.col("source")).alias("source"), "times")
