"""MinHash near-dedup by Order MinHash: sketches keep the text order of sampled shingles, alignment verifies candidates."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkeda.llm.shared import keep, ship, texts

#: Words of a shingle, and the share of words that an alignment of near copies must keep.
SHINGLE, SIMILAR = 5, 0.8
#: Sketches of a text, and shingles that each samples.
SKETCHES, SAMPLED = 40, 2
#: Places in the filter that thins a table before a join; its broadcast holds that many numbers at most.
PLACES = 1 << 20
#: Groups of up to this many texts are compared pair by pair; larger ones are first split by rare words.
PAIRS_UP_TO = 32
#: Runs of words are counted in this many slots; the counts are collected and broadcast.
SLOTS = 1 << 22

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.array([(i * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64 for i in range(1, SKETCHES + 1)], np.uint64)
_ODD = np.array([(i * 0x8CB92BA72F3D8DD7 * 2 + 0x2545F4914F6CDD1D) % 2**64 | 1 for i in range(1, SKETCHES + 1)], np.uint64)
_NODE = ["d1", "d2"]


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, split at ASCII white space."""
    return text.encode("utf-8", "replace").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def sketch(text: str) -> np.ndarray:
    """One key per sketch; none for a text without words.

    Each shingle is labelled with the number of its earlier occurrences, so that repeats count. For each of ``SKETCHES`` hash
    functions the ``SAMPLED`` labelled shingles of least hash are taken and hashed in the order in which they stand in the text.
    A text of fewer than five words is one shingle.
    """
    coded = np.fromiter(map(zlib.crc32, words(text)), np.uint64)
    if not len(coded):
        return np.zeros(0, np.int64)
    wide = min(SHINGLE, len(coded))
    n = len(coded) - wide + 1
    shingle = np.full(n, wide, np.uint64)
    for j in range(wide):
        shingle = shingle * _A + coded[j:j + n]
    order = np.argsort(shingle, kind="stable")
    equal = np.append(False, shingle[order][1:] == shingle[order][:-1])
    if equal.any():
        at = np.arange(n)
        run = np.maximum.accumulate(np.where(equal, 0, at))
        label = np.zeros(n, np.uint64)
        label[order] = (at - run).astype(np.uint64)
        shingle = shingle + label * _B
    shingle = _mix(shingle)
    keys = np.zeros(SKETCHES, np.uint64)
    step = max(1, 1_000_000 // n)
    for a in range(0, SKETCHES, step):
        hashed = (shingle[None, :] ^ _SEEDS[a:a + step, None]) * _ODD[a:a + step, None]
        if n > SAMPLED:
            least = np.sort(np.argpartition(hashed, SAMPLED - 1, axis=1)[:, :SAMPLED], axis=1)
        else:
            least = np.broadcast_to(np.arange(n), (len(hashed), n))
        key = _SEEDS[a:a + step]
        for j in range(least.shape[1]):
            key = _mix(key * _A + shingle[least[:, j]])
        keys[a:a + step] = key
    return keys.view(np.int64)


def _unlike(a: list, b: list, k: int) -> bool:
    """Whether the words, or runs of two words, that the texts share in any order rule out ``k`` edits; an edit changes one or two of them."""
    longer = max(len(a), len(b))
    if longer - sum((Counter(a) & Counter(b)).values()) > k:
        return True
    return longer - 1 - sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values()) > 2 * k


def _within_by_columns(a: list, b: list, k: int) -> bool:
    """Whether the edit distance is at most ``k``: a column of the table of distances a step, as bits of two whole numbers (Hyyro 2003)."""
    n, m = len(a), len(b)
    at: dict = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    every, last = (1 << n) - 1, n - 1
    up, down, distance = every, 0, n
    for j, word in enumerate(b):
        same = at.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        right, left = down | (every & ~(across | up)), up & across
        distance += (right >> last & 1) - (left >> last & 1)
        if distance - (m - 1 - j) > k:
            return False
        right = (right << 1 | 1) & every
        up, down = (left << 1 & every) | (every & ~(same | down | right)), right & (same | down)
    return distance <= k


def within(a: list, b: list, k: int) -> bool:
    """Whether at most ``k`` words inserted, deleted or replaced turn ``a`` into ``b``.

    First what both share at their ends is cut, and the words they share in any order bound the distance from below. Then a
    band of diagonals grows by one on either side with each edit, and only the furthest place on each is kept. That is fast where
    few edits do; after as many steps as the texts have words, whole columns take over.
    """
    start = 0
    short = min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < short - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start:len(a) - stop], b[start:len(b) - stop]
    n, m = len(a), len(b)
    if abs(n - m) > k or _unlike(a, b, k):
        return False
    far = {0: -1}
    for edits in range(k + 1):
        if edits * edits > n and n:
            return _within_by_columns(a, b, k)
        now = {}
        for d in range(-min(edits, m), min(edits, n) + 1):
            x = max(far.get(d, -2) + 1, far.get(d - 1, -2) + 1, far.get(d + 1, -2)) if edits else 0
            if x < max(0, d):
                x = max(0, d) if edits >= abs(d) else -2
            if x < 0 or x > n or x - d > m:
                x = min(x, n, m + d)
            while x < n and x - d < m and a[x] == b[x - d]:
                x += 1
            if x >= n and x - d >= m:
                return True
            now[d] = x
        far = now
    return False


def near(a: str, b: str) -> bool:
    """Whether an alignment keeps at least ``SIMILAR`` of the words of the longer text."""
    left, right = words(a), words(b)
    return within(left, right, int((1 - SIMILAR) * max(len(left), len(right)) + 1e-9))


def sketches(docs: DataFrame) -> DataFrame:
    """(d1, d2, rep, n, keys) for each different text of (doc_id, text): its least id, its words, its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("text").to_pylist()
            keys = [sketch(t) for t in whole]
            n = pa.array([len(words(t)) for t in whole], pa.int64())
            ends = np.cumsum([0] + [len(k) for k in keys], dtype=np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d1"), batch.column("d2"), batch.column("doc_id"), n, pa.ListArray.from_arrays(ends, values)],
                ["d1", "d2", "rep", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = ship(docs).select(*_NODE, "doc_id", "text").mapInArrow(run, f"d1 long, d2 long, rep {kind}, n long, keys array<long>")
    return found.groupBy(*_NODE).agg(F.min("rep").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(node, j, key, first, last, members): the keys of nodes that others have too, with the ends of their group by id."""
    node = F.struct("rep", *_NODE, "n").alias("node")
    rows = nodes.select(node, F.posexplode("keys").alias("j", "key"))
    ends = rows.groupBy("j", "key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("members"))
    return rows.join(ends.filter("members > 1"), ["j", "key"])


def _pairs(pairs: DataFrame) -> DataFrame:
    """(a, b), each pair of (node, to) once, less those that lengths alone rule out."""
    fits = F.abs(F.col("node.n") - F.col("to.n")) <= (1 - SIMILAR) * F.greatest("node.n", "to.n") + 1e-9
    return pairs.filter(fits).select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct().select(
        F.struct("a.d1", "a.d2").alias("a"), F.struct("b.d1", "b.d2").alias("b"))


def candidates(shared: DataFrame) -> DataFrame:
    """(a, b): the first pairs to verify, each once, as (d1, d2) of either.

    Texts that share a key are tied to the first and to the last of them by id, so a key shared by many gives two pairs a text.
    What these pairs leave apart is the work of ``remaining``.
    """
    return _pairs(shared.select("node", F.explode(F.array("first", "last")).alias("to")).filter("node <> to"))


def _within_groups(rows: DataFrame, by: list[str], skip: int = 0) -> DataFrame:
    """(node, to): pairs of different components in each group of (node, comp), the first and last ``skip`` by id left out."""
    groups = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("node", "comp"))).alias("all"))
    inner = groups.select(F.slice("all", skip + 1, F.greatest(F.size("all") - 2 * skip, F.lit(0))).alias("all"))
    return inner.select(F.posexplode("all").alias("at", "x"), "all").select(
        "x", F.explode(F.slice("all", F.col("at") + 2, PAIRS_UP_TO)).alias("y")).filter("x.comp <> y.comp").select(
        F.col("x.node").alias("node"), F.col("y.node").alias("to"))


def grams(text: str, q: int) -> np.ndarray:
    """Hashes of the runs of ``q`` words, each with the number of its earlier occurrences; of a shorter text one."""
    coded = words(text)
    wide = min(q, len(coded))
    seen: Counter = Counter()
    out = np.zeros(len(coded) - wide + 1 if coded else 0, np.uint64)
    for i in range(len(out)):
        gram = b" ".join(coded[i:i + wide])
        out[i] = zlib.crc32(gram) << 32 | zlib.crc32(b"%d %s" % (seen[gram], gram))
        seen[gram] += 1
    return out.view(np.int64)


def _counted(own: DataFrame) -> np.ndarray:
    """Per slot the runs in ``grams`` that fall into it, at most 65,535. A task hands on a row for each block of slots, not for each slot."""
    of_block = 1 << 16
    kinds = "block int, slots array<int>, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            slot, n = np.unique(batch.column("grams").flatten().to_numpy(zero_copy_only=False) % SLOTS, return_counts=True)
            total[slot] += n
        slot = np.flatnonzero(total)
        ends = pa.array(np.searchsorted(slot, np.arange(0, SLOTS + 1, of_block)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(ends) - 1), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())),
             pa.ListArray.from_arrays(ends, pa.array(total[slot], pa.int64()))], ["block", "slots", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, slots, n in zip(batch.column("block").to_pylist(), batch.column("slots"), batch.column("n")):
                own = total.setdefault(block, np.zeros(of_block, np.int64))
                own[slots.values.to_numpy() - block * of_block] += n.values.to_numpy()
        for block, own in total.items():
            slot = np.flatnonzero(own > 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([slot + block * of_block], pa.list_(pa.int32())),
                 pa.array([np.minimum(own[slot], 65535)], pa.list_(pa.int64()))], ["block", "slots", "n"])

    counts = ship(own).select("grams").mapInArrow(run, kinds).repartition("block").mapInArrow(add, kinds).toArrow()
    out = np.ones(SLOTS, np.uint16)
    for slots, n in zip(counts["slots"], counts["n"]):
        out[slots.values.to_numpy()] = n.values.to_numpy()
    return out


def _rare(docs: DataFrame, members: DataFrame, q: int) -> DataFrame:
    """(token, node, comp, size): per member its rarest runs of ``q`` words, one of which every near text has too.

    An edit changes at most q runs, so near texts of n words share at least n (1 - 0.2 q) - q + 1 of them. In any common order, here
    from rare to frequent by the counts of their slots, a text then meets a near one in all but that many of its runs plus one. A run
    that is alone in its slot is in one text only and left out. A member's runs are put in order where it stands, only those it has
    to meet by become rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t, q) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(g) for g in found], dtype=np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), pa.ListArray.from_arrays(ends, values)], ["d1", "d2", "grams"])

    place = (F.xxhash64(*_NODE) % PLACES).alias("place")
    some = docs.select(*_NODE, "text").withColumn("place", place).join(
        F.broadcast(members.select("node.d1", "node.d2").select(place).distinct()), "place", "left_semi").drop("place")
    read = ship(some).dropDuplicates(_NODE).select(*_NODE, "text").mapInArrow(run, "d1 long, d2 long, grams array<long>")
    own = keep(read.join(members.select("node.d1", "node.d2", "node", "comp"), _NODE).select("node", "comp", "grams"))
    counts = own.sparkSession.sparkContext.broadcast(_counted(own))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("grams")
            token, text = of.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(of)), pa.compute.list_value_length(of))
            size = counts.value[token % SLOTS]
            token, text, size = (x[size > 1] for x in (token, text, size))
            order = np.lexsort((token, size, text))
            token, text = token[order], text[order]
            held = np.bincount(text, minlength=len(of))
            least = np.ceil(batch.column("n").to_numpy() * (1 - (1 - SIMILAR) * q) - q + 1 - 1e-6).astype(np.int64)
            wanted = np.maximum(0, np.minimum(held, held - np.maximum(least, 1) + 1))
            kept = np.flatnonzero(np.arange(len(text)) - (np.cumsum(held) - held)[text] < wanted[text])
            rows = batch.select(["node", "comp"]).take(pa.array(text[kept]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(token[kept], pa.int64())], ["node", "comp", "token"])

    kinds = StructType([own.schema["node"], own.schema["comp"], StructField("token", LongType())])
    cut = keep(ship(own).select("node", "comp", "node.n", "grams").mapInArrow(first, kinds))
    return keep(cut.join(cut.groupBy("token").agg(
        F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high"), "token")).drop("low", "high")


def remaining(docs: DataFrame, shared: DataFrame, label: DataFrame) -> DataFrame | None:
    """(a, b): all further pairs that share a key, lie in different components of ``label`` and can be near; None if no key has any.

    Groups of a few texts give their pairs. Members of larger ones meet by their rarest pairs of words, those of pairs that many
    have by their rarest words; neither loses a near pair, and both may add pairs of members that share no key. Where many still share the rarest ones, texts outside the largest
    component of such a group are paired with the whole group, which grows with the square of texts that are alike yet not near.
    """
    some = shared.filter("members > 3").select("node", "j", "key", "members")      # up to three, the ends meet all
    comp = F.coalesce("label", F.struct("node.d1", "node.d2")).alias("comp")
    of = label.select(F.col("node").alias("own"), "label")
    rows = some.join(of, F.expr("struct(node.d1, node.d2) = own"), "left").select("node", "j", "key", "members", comp)
    mixed = rows.groupBy("j", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    rows = keep(rows.join(mixed.select("j", "key"), ["j", "key"]))
    if rows.isEmpty():
        return None
    found = _within_groups(rows.filter(F.col("members") <= PAIRS_UP_TO), ["j", "key"], skip=1)
    members = keep(rows.filter(F.col("members") > PAIRS_UP_TO).select("node", "comp").distinct())
    for q in (2, 1):
        if members.isEmpty():
            return _pairs(found)
        tokens = _rare(docs, members, q)
        found = found.unionByName(_within_groups(tokens.filter(F.col("size") <= PAIRS_UP_TO), ["token"]))
        hot = tokens.filter(F.col("size") > PAIRS_UP_TO)
        members = keep(hot.select("node", "comp").distinct())
    top = hot.groupBy("token", "comp").agg(F.count("*").alias("held")).groupBy("token").agg(F.max(F.struct("held", "comp")).alias("top"))
    minor = hot.join(top, "token").filter("comp <> top.comp").select("token", "node", "comp")
    cross = minor.join(hot.select("token", F.col("node").alias("to"), F.col("comp").alias("other")), "token").filter("comp <> other")
    return _pairs(found.unionByName(cross.select("node", "to")))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are ``near``. Only texts in some pair are shuffled, once for either side."""
    ends = pairs.select("a.*").unionByName(pairs.select("b.*")).distinct()
    place = lambda: (F.xxhash64(*_NODE) % PLACES).alias("place")
    some = docs.select(*_NODE, "text").withColumn("place", place()).join(
        F.broadcast(ends.select(place()).distinct()), "place", "left_semi").drop("place")
    text = some.join(ends, _NODE, "left_semi").dropDuplicates(_NODE).select(F.struct(*_NODE).alias("node"), "text")
    left = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(text.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [near(x, y) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
            kept = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    node = "struct<d1: long, d2: long>"
    return ship(both).select("a", "b", "ta", "tb").mapInArrow(run, f"a {node}, b {node}")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of (a, b) with the least node they are connected to.

    Each round every node takes the least label around it and then the label of that label, so long chains shrink by halves. A
    round is one shuffled table, written out, so a lost executor costs part of a round.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        around = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        lower = label.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        over = label.select(F.col("node").alias("label"), F.col("label").alias("top"))
        next_ = keep(lower.join(over, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        if next_.filter("old <> label").isEmpty():
            return next_.select("node", "label")
        label = next_.select("node", "label")


def digests(text: str = "text") -> dict[str, Column]:
    """The 128-bit digest of a text (null: empty) that stands for it as a node."""
    body = F.coalesce(F.col(text), F.lit(""))
    return {"d1": F.xxhash64(F.lit(0), body), "d2": F.xxhash64(F.lit(1), body)}


def _named(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text, d1, d2), and per node (d1, d2, rep, l1, l2) with the least node of its class."""
    own = texts(docs, key, text).withColumns(digests())
    nodes = keep(sketches(own))
    shared = keep(shared_keys(nodes))
    links = keep(verified(own, keep(candidates(shared))))
    joined = components(links)
    rest = remaining(own, shared, joined)
    if rest is not None:
        more = keep(verified(own, keep(rest)))
        if not more.isEmpty():
            joined = components(links.unionByName(more))
    label = joined.select("node.*", F.col("label.d1").alias("l1"), F.col("label.d2").alias("l2"))
    return own, nodes.select(*_NODE, "rep").join(label, _NODE, "left").select(
        *_NODE, "rep", F.coalesce("l1", "d1").alias("l1"), F.coalesce("l2", "d2").alias("l2"))


def firsts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d1, d2): of each of the ``classes`` the text that has its least id, with that id and its digest."""
    _, named = _named(docs, key, text)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", *_NODE)).alias("first")
    return named.groupBy("l1", "l2").agg(first).select(F.col("first.rep").alias("doc_id"), "first.d1", "first.d2")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs`` with the least id of its class.

    Equal texts are one class (null and empty ones too), found by a 128-bit digest before anything else, so copies are not
    compared. Different texts are linked if they share a key and their alignment keeps ``SIMILAR`` of the words; classes are the
    connected ones, however many texts have that key. A null id counts as larger than all others. Other columns are not read.
    """
    own, named = _named(docs, key, text)
    least = named.groupBy("l1", "l2").agg(F.min("rep").alias("class_id"))
    of = named.join(least, ["l1", "l2"]).select(*_NODE, "class_id")
    return own.select("doc_id", *_NODE).join(of, _NODE).select("doc_id", "class_id")
