"""Line dedup: a segment-partition edit join finds lines that repeat an earlier line, up to one edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import keep

#: Lines within this many edits (insert, delete or replace a code point) are the same line. Its value fixes the segments: two.
THRESHOLD = 1
#: Shorter lines are left alone: headings, list items and the like repeat for good reason.
MIN_CHARS = 20
#: Groups of up to this many lines are compared pair by pair; larger ones are first split by finer segments.
PAIRS_UP_TO = 32
#: Places in the filter that thins a table before a join; its broadcast holds 64 of them as one number.
PLACES = 1 << 26

_DOC, _LINE = ["doc_id", "h"], ["d1", "d2"]


def edit_distance(a: str, b: str, k: int) -> str:
    """SQL for the edit distance of two text columns if it is at most ``k``, else more than ``k``.

    Banded and bit-parallel: one BIGINT holds the vertical differences of the 2k + 2 cells around the diagonal, each code point
    of ``b`` takes a handful of bit operations. Both texts need more than k code points and lengths at most k apart.
    """
    top = 2 * k + 1
    ones = (1 << (top + 1)) - 1
    same = " | ".join(f"if(get(a, i + {k - top + q}) <=> get(b, i), {1 << q}L, 0L)" for q in range(top + 1))
    mask = f"shiftleft(1L, greatest({top - 1} - (i - (size(a) - {k})), 0))"
    step = (
        "element_at(transform(array(named_struct('x', x, 'd0', d0, 'hp', (s.vn | ~(d0 | s.vp)) & {ones}L, 'hn', d0 & s.vp)), "
        "t -> named_struct('vp', (t.hn | ~(shiftright(t.d0, 1) | t.hp)) & {ones}L, 'vn', shiftright(t.d0, 1) & t.hp, 'dist', s.dist + "
        "if(i < size(a) - {k}, if((t.d0 & {diagonal}L) = 0, 1, 0), if((t.hp & {mask}) != 0, 1, 0) - if((t.hn & {mask}) != 0, 1, 0)))), 1)"
    ).format(ones=ones, k=k, diagonal=1 << top, mask=mask)
    body = (
        f"element_at(transform(array({same}), x -> element_at(transform(array(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {ones}L), "
        f"d0 -> {step}), 1)), 1)")
    start = f"named_struct('vp', {ones & ~((1 << (top - k)) - 1)}L, 'vn', 0L, 'dist', {k})"
    return (
        f"element_at(transform(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), p -> element_at(transform(array(p.a), a -> "
        f"element_at(transform(array(p.b), b -> aggregate(sequence(0, size(b) - 1), {start}, (s, i) -> {body}).dist), 1)), 1)), 1)")


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))


def _long(line: Column) -> Column:
    return F.length(F.trim(line)) >= MIN_CHARS


def _key(line: str, form: str, windows: str, j: str) -> Column:
    """Hash of all of a line but its window ``j``: the segments outside it, for lines of length ``form`` or one less."""
    before = f"cast(({j} * {form}) div {windows} as int)"
    after = f"cast({form} - (({j} + 1) * {form}) div {windows} as int)"
    return F.expr(
        f"if({before} + {after} <= length({line}), xxhash64({form}, {windows}, {j}, left({line}, {before}), right({line}, {after})), NULL)")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, h, no, n, keys): each different long line once, by a 128-bit digest, with its first place.

    ``keys`` are the hashes of its two segments, as a line of its length n and as one to meet lines of length n + 1. Lines
    themselves are not shuffled, and copies of a line are merged before the shuffle.
    """
    lines = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).filter(_long(F.col("line")))
    keyed = lines.select(
        F.xxhash64(F.lit(0), "line").alias("d1"), F.xxhash64(F.lit(1), "line").alias("d2"),
        F.struct("doc_id", "h", "no", F.length("line").cast("bigint").alias("n"), F.col("line").alias("line")).alias("first"))
    halves = [(f"(first.n + {more})", str(j)) for more in range(THRESHOLD + 1) for j in range(THRESHOLD + 1)]
    keys = F.array(*(_key("first.line", form, str(THRESHOLD + 1), j) for form, j in halves))
    narrow = keyed.select(*_LINE, F.struct("first.doc_id", "first.h", "first.no", "first.n", keys.alias("keys")).alias("first"))
    return narrow.groupBy(*_LINE).agg(F.min("first").alias("first")).select(*_LINE, "first.*")


def _thinned(table: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """``table`` without most rows whose key is not in ``wanted``: a semi-join on a bounded number of places."""
    place = F.pmod(F.xxhash64(*by), F.lit(PLACES))
    slot, bit = F.shiftrightunsigned(place, 6), F.pmod(place, F.lit(64)).cast("int")
    taken = wanted.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("at"))
    bits = taken.groupBy("slot").agg(F.bit_or("at").alias("bits"))
    return table.withColumns({"slot": slot, "bit": bit}).join(F.broadcast(bits), "slot").filter(
        F.getbit("bits", "bit") == 1).drop("slot", "bit", "bits")


def lines_at(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(d1, d2, line) for some of the distinct lines: their texts, read at their first places.

    Lines are thinned where they stand, and copies of a row merged, before the shuffle: whole texts stay where they are.
    """
    at = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    some = _thinned(at, [*_DOC, "no"], lines).select(
        F.xxhash64(F.lit(0), "line").alias("d1"), F.xxhash64(F.lit(1), "line").alias("d2"), "line").dropDuplicates(_LINE)
    return some.join(lines.select(*_LINE), _LINE, "left_semi")


def candidates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of places of different lines that agree outside one window, a before b.

    Lines that share a segment key and form a small group give their pairs. The lines of a larger group are cut into twice as
    many windows and meet again only where all but one half of the old window agrees; a group whose window is one code point
    wide holds lines of which any two are within one edit, and needs its first line only. So no group is paired in full,
    whatever its size, and no pair within one edit is lost.
    """
    half = THRESHOLD + 1
    rows = lines.select(*_LINE, "doc_id", "h", "no", "n", F.posexplode("keys").alias("k", "key")).select(
        *_LINE, "doc_id", "h", "no", (F.col("n") + F.floor(F.col("k") / half)).alias("form"), F.lit(half).cast("bigint").alias("windows"),
        (F.col("k") % half).cast("bigint").alias("j"), "key").filter("key IS NOT NULL")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        shared = keep(rows.join(sizes, "key"))
        small = shared.filter(F.col("members") <= PAIRS_UP_TO)
        place = F.struct("doc_id", "h", "no", *_LINE).alias("place")
        groups = small.groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("all"))
        pairs = groups.select(F.posexplode("all").alias("at", "a"), "all").select(
            "a", F.explode(F.slice("all", F.col("at") + 2, PAIRS_UP_TO)).alias("b"))
        large = shared.filter((F.col("members") > PAIRS_UP_TO))
        done = large.filter("windows >= form")
        first = done.groupBy("key").agg(F.min(place).alias("a"))
        stars = done.select("key", place.alias("b")).join(first, "key").filter("a < b").select("a", "b")
        pairs = pairs.unionByName(stars)
        found = pairs if found is None else found.unionByName(pairs)
        hot = large.filter("windows < form")
        if hot.isEmpty():
            return found.distinct()
        hot = hot.drop("key", "members")
        texts = lines_at(docs, hot.select(*_LINE, "doc_id", "h", "no").distinct())
        rows = hot.join(texts, _LINE).select(
            *_LINE, "doc_id", "h", "no", "form", (F.col("windows") * 2).alias("windows"), F.explode(F.expr("array(j * 2, j * 2 + 1)")).alias("j"),
            "line").withColumn("key", _key("line", "form", "windows", "j")).drop("line").filter("key IS NOT NULL").distinct()


def links(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The candidate pairs that are within ``THRESHOLD`` edits."""
    pairs = keep(candidates(docs, lines))
    ends = pairs.select("a.*").unionByName(pairs.select("b.*")).distinct()
    line = lines_at(docs, ends)
    named = pairs.join(line.select(F.struct(*_LINE).alias("la"), F.col("line").alias("left")), F.expr("struct(a.d1, a.d2) = la")).join(
        line.select(F.struct(*_LINE).alias("lb"), F.col("line").alias("right")), F.expr("struct(b.d1, b.d2) = lb"))
    return named.filter(F.expr(edit_distance("left", "right", THRESHOLD)) <= THRESHOLD).select("a", "b")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with its text less the lines that repeat: (doc_id, n_lines, n_dropped, n_long, text, then ``carry``).

    A line of at least ``MIN_CHARS`` code points, blanks at its ends aside, goes if an earlier line is equal or one edit away;
    earlier goes by (doc_id, hash of the text, place in the text). All others stay in order, joined by a line feed; ``n_long``
    counts the long ones among them. Rows equal in id and text count as one document, null texts are empty and have one empty line, a null id sorts first. What stays of a
    document is found by its id, so a line that stands in a third of all documents never meets in one task.
    """
    carry = carry or []
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*carry, F.lit(0)).alias("rest"))
    base = base.withColumn("h", F.xxhash64("text"))
    own = _documents(docs, key, text)
    lines = keep(distinct_lines(own))
    later = links(own, lines).select("b.d1", "b.d2").distinct()
    kept = lines.join(later, _LINE, "left_anti").groupBy(*_DOC).agg(F.collect_list("no").alias("kept"))
    joined = base.alias("t").join(kept.alias("k"), F.expr("t.doc_id <=> k.doc_id AND t.h = k.h"), "left").select(
        "t.doc_id", "t.rest", F.split("t.text", "\n", -1).alias("all"), F.coalesce("k.kept", F.array().cast("array<int>")).alias("kept"))
    short = F.filter(F.transform("all", lambda x, i: F.when(~_long(x), i)), lambda i: i.isNotNull())
    left = joined.withColumn("at", F.sort_array(F.concat("kept", short))).withColumn(
        "left", F.transform("at", lambda i: F.get("all", i)))
    return left.select(
        "doc_id", F.size("all").cast("bigint").alias("n_lines"), (F.size("all") - F.size("left")).cast("bigint").alias("n_dropped"),
        F.size("kept").cast("bigint").alias("n_long"),
        F.array_join("left", "\n").alias("text"), *(F.col("rest")[c].alias(c) for c in carry))
