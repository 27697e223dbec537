"""Spelling variant grouping: words one edit apart are found by an index of variable-length grams.

A dictionary of grams is grown from the words: every pair of letters, and a longer gram where the one without its last letter is
frequent. A word is cut into the longest grams of the dictionary. One edit leaves some of them as they are, however it falls, and
that number is known from the word alone; so of two near words each has the other in one of the lists of its few rarest grams, and
no other list is read. Lists that are still long are split by what an edit leaves of the word. Candidates are verified.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkeda.llm.shared import keep, ship

#: Words have so many letters and occur so often at least.
MIN_LETTERS, MIN_TIMES = 7, 2
#: A word is a variant of a near word that is so many times as frequent.
RATIO = 10
#: One in so many occurrences, by document and run, loses a letter.
SLIPS = 31
#: Grams have 2 to so many letters.
LONGEST = 6
#: A gram is frequent above one in so many of all pairs of letters. Fewer than this many grams of each length are, and with
#: ``LETTERS`` letters the dictionary holds at most LETTERS * LETTERS + (LONGEST - 2) * LETTERS * FREQUENT grams.
FREQUENT = 1 << 12
LETTERS = 90
#: Lists up to this long are compared pair by pair.
PAIRS_UP_TO = 64
#: Different words or grams that a task counts before it hands them on.
COUNTED_AT_ONCE = 300_000

#: In Latin-1, ASCII letters in lower case and the letters from 0xC0 on stay, all else parts runs.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, one byte a letter, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_PARTS).split()


def slipped(run: bytes, of_key: int, slips: int = SLIPS) -> bytes:
    """The run without one letter if ``slips`` divides the CRC-32 of key, colon and run; ``of_key`` is that of key and colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), of_key)
    if h % slips:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _handed_on(counts: Counter, name: str) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays(
        [pa.array([w.decode("latin-1") if isinstance(w, bytes) else w for w in counts], pa.string()), pa.array(counts.values(), pa.int64())],
        names=[name, "n"])
    counts.clear()
    return out


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, times: int = MIN_TIMES) -> DataFrame:
    """(word, n): runs of letters after the slips, with at least ``least`` letters and ``times`` occurrences over all documents.

    Null texts have no word, a null key reads as an empty one.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, body in zip(batch["doc"].to_pylist(), batch["text"]):
                of_key = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(r for r in runs(body.as_py()) if len(r) >= least).items():
                    word = slipped(run, of_key)
                    if len(word) >= least:
                        total[word] += n
                if len(total) > COUNTED_AT_ONCE:
                    yield _handed_on(total, "word")
        yield _handed_on(total, "word")

    read = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return ship(read).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


class Grams(NamedTuple):
    """The dictionary: each gram's rank by rarity, the frequent grams, and the least length of a gram with a given proper ending."""

    rank: dict[str, int]
    frequent: frozenset[str]
    ending: dict[str, int]


def dictionary(found: DataFrame, frequent: int = FREQUENT) -> Grams:
    """Variable-length grams of the words: those of two letters, and longer ones whose gram without the last letter is frequent."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch["word"].to_pylist():
                for q in range(2, LONGEST + 1):
                    total.update([word[i:i + q] for i in range(len(word) - q + 1)])
                if len(total) > COUNTED_AT_ONCE:
                    yield _handed_on(total, "gram")
        yield _handed_on(total, "gram")

    counts = keep(ship(found.select("word")).mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    above = counts.filter(F.length("gram") == 2).agg(F.coalesce(F.sum("n"), F.lit(0)) / frequent).scalar()
    often = counts.filter((F.length("gram") < LONGEST) & (F.col("n") > above)).select(F.col("gram").alias("stem"))
    longer = counts.filter(F.length("gram") > 2).join(often, F.expr("left(gram, length(gram) - 1) = stem"), "left_semi")
    grams = {r["gram"]: r["n"] for r in counts.filter(F.length("gram") == 2).unionByName(longer).collect()}
    ending: dict[str, int] = {}
    for gram in grams:
        for k in range(1, len(gram)):
            ending[gram[k:]] = min(len(gram), ending.get(gram[k:], len(gram)))
    return Grams({g: i for i, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}, frozenset(r["stem"] for r in often.collect()), ending)


def decompose(word: str, grams: Grams, longest: int) -> list[tuple[int, int]]:
    """(start, end) of the word's grams: the longest of the dictionary at each place, unless an earlier one covers it."""
    out, end, n = [], 0, len(word)
    frequent, rank = grams.frequent, grams.rank
    for start in range(n - 1):
        stop = start + 2
        while stop < min(start + longest, n) and word[start:stop] in frequent and word[start:stop + 1] in rank:
            stop += 1
        if stop > end:
            out.append((start, stop))
            end = stop
    return out


def reach(word: str, grams: Grams, longest: int) -> tuple[list[int], list[int]]:
    """How far an edit reaches in the worst case, from what it leaves of the word.

    First list, by the length of the kept beginning: grams that start before this place stay as they are, since none that starts
    there can be extended over the end of the beginning. Second list, by the start of the kept ending: grams that end after this
    place stay, since no gram from before the ending can cover them.
    """
    n = len(word)
    left, right = [0], []
    for i in range(1, n + 1):
        at = max(0, i - longest + 1)
        while i - at > 1 and word[at:i] not in grams.frequent:
            at += 1
        left.append(at)
    for j in range(n + 1):
        at = min(n, j + longest - 1)
        while at - j > 1 and grams.ending.get(word[j:at], longest + 1) > longest:
            at -= 1
        right.append(at)
    return left, right


def signature(word: str, grams: Grams, longer: bool) -> list[tuple[str, int]]:
    """(gram, place) of the lists that hold every word one edit away, one letter longer (``longer``) or else not longer.

    Grams are ordered by rarity over all words. If any edit leaves at least ``kept`` of the word's grams, then so many are common
    to both words, and their rarest common gram is among the len - kept + 1 rarest of each. ``longest`` is under half of the longer
    word, so that an edit leaves the first or the last gram and ``kept`` is 1 at least.
    """
    form = len(word) + longer
    longest = min(LONGEST, (form - 1) // 2)
    cut = decompose(word, grams, longest)
    left, right = reach(word, grams, longest)
    starts, ends = [s for s, _ in cut], [e for _, e in cut]
    before = [bisect_left(starts, at) for at in left]
    after = [len(cut) - max(bisect_left(starts, j), bisect_right(ends, at)) for j, at in enumerate(right)]
    lost = 0 if longer else 1                            # letters of the word that the edit takes away
    kept = min(before[i] + after[i + lost] for i in range(len(word) + 1 - lost))
    rarest = sorted((grams.rank[word[s:e]], s, word[s:e]) for s, e in cut)
    return [(gram, s) for _, s, gram in rarest[:len(cut) - kept + 1]]


def _list(gram: str, form: int, place: int) -> int:
    """The list of a gram at a place of words of ``form`` letters, in 64 bits; lists that fall together only add candidates."""
    return ((form * 0x9E3779B1 + place * 0x85EBCA77) % (1 << 31) << 32 | zlib.crc32(gram.encode())) - (1 << 62)


def _lists(found: DataFrame, grams: Grams) -> DataFrame:
    """(key, form, own, word, n): the lists of each word; ``own`` ones are of its own length, others of the next."""
    shared = found.sparkSession.sparkContext.broadcast(grams)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, forms, owns, at = [], [], [], []
            for row, word in enumerate(batch["word"].to_pylist()):
                n = len(word)
                mine = [(_list(g, n, p), n, True) for g, p in signature(word, shared.value, False)]
                # a letter put in before a gram moves it one place on
                mine += [(_list(g, n + 1, p + more), n + 1, False) for g, p in signature(word, shared.value, True) for more in (0, 1)]
                for key, form, own in set(mine):
                    keys.append(key)
                    forms.append(form)
                    owns.append(own)
                    at.append(row)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(forms, pa.int32()), pa.array(owns, pa.bool_()), batch["word"].take(place), batch["n"].take(place)],
                names=["key", "form", "own", "word", "n"])

    return ship(found).mapInArrow(listed, "key long, form int, own boolean, word string, n long")


def near_pairs(found: DataFrame, grams: Grams, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(a, b) of (word, n): every pair of words exactly one edit apart, once.

    A list of up to ``pairs_up_to`` words gives its pairs, verified by edit distance. The words of a longer one meet again in
    lists of those that also agree outside one half of the word, then outside one quarter, and so on; where the part is one
    letter, a list holds at most one word for each of the ``LETTERS`` letters and one without. So no list is paired that grows
    with the corpus, and no pair is lost.
    """
    rows = _lists(found, grams).withColumns({"windows": F.lit(1), "j": F.lit(0)})
    of_list = W.partitionBy("key")
    out = None
    while True:
        shared = keep(rows.withColumns({"members": F.count("*").over(of_list), "met": F.bool_or("own").over(of_list)}).filter(
            "members > 1 AND met").drop("met"))
        small = shared.filter((F.col("members") <= pairs_up_to) | (F.col("windows") >= F.col("form")))
        one = F.struct("word", "n")
        lists = small.groupBy("key").agg(F.collect_list(F.when(F.col("own"), one)).alias("own"), F.collect_list(F.when(~F.col("own"), one)).alias("other"))
        # a list holds its own words in any order: each pairs with those after it and with all shorter words
        pairs = lists.select(F.posexplode("own").alias("at", "a"), "own", "other").select(
            "a", F.explode(F.expr("concat(slice(own, at + 2, size(own)), other)")).alias("b"))
        near = pairs.filter(F.levenshtein("a.word", "b.word", 1) == 1).select(
            F.when(F.expr("a.word < b.word"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.expr("a.word < b.word"), F.col("b")).otherwise(F.col("a")).alias("b"))
        out = near if out is None else out.unionByName(near)
        hot = shared.filter((F.col("members") > pairs_up_to) & (F.col("windows") < F.col("form")))
        if hot.isEmpty():
            return out.distinct()
        halves = hot.withColumns({"windows": F.col("windows") * 2, "j": F.explode(F.expr("array(j * 2, j * 2 + 1)"))})
        before, after = "cast((j * form) div windows as int)", "cast(form - ((j + 1) * form) div windows as int)"
        agreed = F.expr(
            f"if({before} + {after} <= length(word), xxhash64(key, windows, j, left(word, {before}), right(word, {after})), NULL)")
        rows = halves.withColumn("key", agreed).drop("members").filter("key IS NOT NULL")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of the chain. Known steps double; a form is ``RATIO`` times as frequent, so chains end."""
    known = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = known.select(F.col("word").alias("via"), F.col("root").alias("further"))
        known = keep(known.join(step, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if known.filter("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the far more frequent spelling that it is a variant of.

    Words are near if one inserted, deleted or replaced letter parts them. ``form`` is the most frequent near word (the first in
    code-point order of equals) if it has at least ``ratio`` times the word's occurrences, else null; ``root`` follows the forms to
    the last, the word itself without one. Repeated rows count as often as they stand; an empty table gives no rows.
    ``least`` must be 5 or more, as shorter words need not keep a gram.
    """
    if least < 5:
        raise ValueError("least must be 5 or more")
    found = keep(words(docs, key, text, least))
    pairs = near_pairs(found, dictionary(found))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("a.word").alias("word"), F.col("b").alias("other")), F.struct(F.col("b.word").alias("word"), F.col("a").alias("other")))))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other.n")).alias("less"), F.col("other.word").alias("form"))).alias("best"))
    stands = -F.col("best.less") >= ratio * F.col("n")
    named = keep(found.join(best, "word", "left").select(
        "word", F.when(stands, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, -F.col("best.less")).alias("form_n")))
    last = roots(named.filter("form IS NOT NULL").select("word", "form"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
