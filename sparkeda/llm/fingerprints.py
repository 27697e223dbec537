"""Document fingerprints: a homomorphic multiset hash, the sum of wide vectors hashed from the pieces of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkeda.llm.shared import keep, texts

#: A piece: at most 64 characters of a sentence in a paragraph, with the marks that end it. Pieces restart at every sentence,
#: so an edit changes the pieces of its own sentence only.
PIECE = r"[^\n.!?]{1,64}+[.!?]*|[.!?]+"
#: Sums are taken modulo 2 ** 60. A sum is one wide number (equality) or three counters of 20 bits (likeness).
MODULO = (1 << 60) - 1
COUNTER = (1 << 20) - 1
COUNTERS = 1 | 1 << 20 | 1 << 40
WIDE, COUNTED = 4, 2          # hashes of a piece that are summed whole; of these, hashes whose 60 bits are counted one by one


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _hashes(pieces: Column, seed: int) -> Column:
    return F.transform(pieces, lambda x: F.xxhash64(F.lit(seed), x))


def _sum(hashes: Column, shift: int, mask: int) -> Column:
    """Sum of the masked bits above ``shift``, modulo."""
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: (
        a + F.shiftrightunsigned(x, shift).bitwiseAND(mask)).bitwiseAND(MODULO))


def fingerprint(text: Column) -> Column:
    """struct(n, wide, counts) of a text (null: empty), computed within the row.

    ``n`` is the number of pieces, ``wide`` four sums of 60-bit hashes, ``counts`` 40 sums that each hold three counters: how
    many pieces have that bit of their hash set. All are sums over pieces modulo a power of two. Order plays no part, and
    ``combine`` adds or removes paragraphs without the rest of the text.
    """
    pieces = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: F.trim(p) != "")

    def sums(p: Column) -> Column:
        hashes = [_hashes(p, seed) for seed in range(WIDE)]

        def build(h: Column) -> Column:
            whole = [_sum(h[i], 0, MODULO) for i in range(WIDE)]
            bits = [_sum(h[i], shift, COUNTERS) for i in range(COUNTED) for shift in range(20)]
            return F.struct(F.size(p).cast("bigint").alias("n"), F.array(*whole).alias("wide"), F.array(*bits).alias("counts"))

        return _let(F.array(*hashes), build)

    return _let(pieces, sums)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union (1) or difference (-1) of two multisets of pieces."""
    both = lambda x, y: (x + sign * y).bitwiseAND(MODULO)
    return F.struct((a["n"] + sign * b["n"]).alias("n"), F.zip_with(a["wide"], b["wide"], both).alias("wide"),
                    F.zip_with(a["counts"], b["counts"], both).alias("counts"))


def as_text(print_: Column) -> Column:
    """Hex digits of all sums; equal multisets of pieces give equal digits."""
    sums = F.concat(F.array(print_["n"]), print_["wide"], print_["counts"])
    return F.array_join(F.transform(sums, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal prints, near 0 for texts without a common piece.

    Each bit of a hash deals every piece a random sign, so the square of the signed count estimates the sum of squared piece
    counts; applied to the difference of two prints, the sum over pieces of the squared difference. The likeness is one less
    the mean square of the difference over the sum of the two mean squares, cut to 0..1. Two empty texts are alike.
    """
    def square(counts: Column, n: Column) -> Column:
        signed = lambda x, shift: (2 * F.shiftrightunsigned(x, shift).bitwiseAND(COUNTER) - n).cast("double")
        return F.aggregate(counts, F.lit(0.0), lambda s, x: s + sum(signed(x, k) * signed(x, k) for k in (0, 20, 40)))

    apart = F.aggregate(
        F.zip_with(a["counts"], b["counts"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.lit(0.0),
        lambda s, p: s + sum(F.pow((2 * (F.shiftrightunsigned(p["x"], k).bitwiseAND(COUNTER)
                                         - F.shiftrightunsigned(p["y"], k).bitwiseAND(COUNTER)) - (a["n"] - b["n"])).cast("double"), F.lit(2.0))
                             for k in (0, 20, 40)))
    total = square(a["counts"], a["n"]) + square(b["counts"], b["n"])
    return F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / total))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): for each distinct id the next smaller one, for the smallest the largest.

    Ids are dealt by range, the next one is found within a range, and the first id of each range (one row a range) closes the
    gaps. Only ids move.
    """
    own = keep(ids.select("doc_id").distinct().repartitionByRange(F.desc("doc_id")).select(
        "doc_id", F.spark_partition_id().alias("part")))
    firsts = own.groupBy("part").agg(F.max("doc_id").alias("first"))
    after = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("after"))
    largest = own.agg(F.max("doc_id").alias("largest"))
    near = own.withColumn("near", F.lead("doc_id").over(W.partitionBy("part").orderBy(F.desc("doc_id"))))
    return near.join(F.broadcast(after), "part").select(
        "doc_id", F.coalesce("near", "after", largest.scalar()).alias("next_id"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_chars, print, edited, next_print): every text and the one made of its first part and the next text.

    The last floor(n_chars / 2) code points give way to as many from the start of the next document, or to all of it if it is
    shorter. Next is the document with the next smaller id; if several rows share that id, the one whose start sorts first.
    Repeated rows stay. A row without an id has no next one and only loses its end. Texts are shuffled once by id, and the
    starts of the next ones once more.
    """
    # Renamed, so that both joins see one and the same exchange of the texts: an alias that changes nothing is dropped on one
    # side only, and the plans would differ.
    whole = texts(docs, key, text).select(F.col("doc_id").alias("own"), "text")
    n_chars = F.length("text").cast("bigint")
    sizes = whole.groupBy("own").agg(F.floor(F.max(n_chars) / 2).cast("int").alias("need"))
    wanted = successors(whole.filter("own IS NOT NULL").withColumnRenamed("own", "doc_id")).join(
        sizes, F.col("doc_id") == F.col("own")).select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("own"), "need")
    placed = whole.filter("own IS NOT NULL").repartition("own")
    starts = placed.join(wanted, "own").select(
        "for_id", F.struct(F.expr("left(text, need)").alias("start"), fingerprint(F.col("text")).alias("print")).alias("next"))
    nexts = starts.groupBy("for_id").agg(F.min("next").alias("next")).select(F.col("for_id").alias("own"), "next.*")
    none = whole.filter("own IS NULL").select("*", F.lit("").alias("start"), fingerprint(F.lit("")).alias("print"))
    paired = placed.join(nexts, "own").unionByName(none).withColumn("n_chars", n_chars)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return paired.select(
        F.col("own").alias("doc_id"), "text", "n_chars", fingerprint(F.col("text")).alias("print"),
        F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.left("start", half)).alias("edited"),
        F.col("print").alias("next_print"))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs``."""
    pairs = edited(docs, key, text).withColumn("edited_print", fingerprint(F.col("edited")))
    own, other = F.col("print"), F.col("edited_print")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"),
        likeness(own, F.col("next_print")).alias("near_next"))
