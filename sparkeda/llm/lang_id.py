"""Language ID: script ranges narrow the candidates, Viterbi over word scores labels spans of mixed-language text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkeda.llm.shared import lot, ship

#: Letter triples are hashed into this many slots, so a model holds that many numbers per language whatever it is learned from.
SLOTS = 1 << 16
#: Ranges of code points by script; letters elsewhere count as one further script.
SCRIPTS = (
    ("latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F),)),
    ("armenian", ((0x0530, 0x058F),)),
    ("hebrew", ((0x0590, 0x05FF),)),
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x0900, 0x097F),)),
    ("bengali", ((0x0980, 0x09FF),)),
    ("tamil", ((0x0B80, 0x0BFF),)),
    ("telugu", ((0x0C00, 0x0C7F),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)
#: A script is open to a language that writes at least this share of its letters in it.
OPEN_FROM = 0.01
#: Cost, in nats, of changing the language between two words.
SWITCH = 12.0
SMOOTH = 0.5
UNKNOWN = "und"
#: Code points scored at a time by one task, each of which takes some 50 bytes meanwhile.
AT_ONCE = 1_000_000

_TABLES: list[np.ndarray] = []


class Model(NamedTuple):
    """Languages in order, log-probabilities of the slots (slots x languages), open scripts (scripts x languages)."""

    langs: list[str]
    scores: np.ndarray
    open: np.ndarray


def _tables() -> list[np.ndarray]:
    """Lower-case letter (0 for all else) and script of every code point."""
    if not _TABLES:
        lower = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        script = np.full(0x110000, len(SCRIPTS), np.uint8)
        for i, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                script[a:b + 1] = i
        _TABLES.extend((lower, script))
    return _TABLES


class Letters(NamedTuple):
    """The letters of some texts one after the other: place among all code points, slot, script, text, start of a word."""

    at: np.ndarray
    slot: np.ndarray
    script: np.ndarray
    text: np.ndarray
    begins: np.ndarray


def letters(texts: list[str]) -> Letters:
    """Words are runs of letters; a letter's slot hashes it with its two neighbours in the word, none at the edges."""
    lower, script = _tables()
    whole = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = lower[whole]
    at = np.flatnonzero(low)
    mixed = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Letters(at - 1, (mixed >> np.uint32(16)).astype(np.int64), script[whole[at]],
                   np.searchsorted(ends, at - 1, side="right"), low[at - 1] == 0)


def _blocks(texts: list[str], size: int) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch a few at a time, of about ``AT_ONCE`` bytes of text: only so many are Python texts at once."""
    size = np.nan_to_num(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(float))
    start = 0
    for stop in np.append(np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1, batch.num_rows):
        if stop > start:
            yield batch.slice(start, stop - start)
            start = stop


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts letter triples and scripts of every row with a language and a text; all rows, in one pass.

    Each task sends one count per language and slot it has met, so what is shuffled does not follow the size of a language. The
    result that comes to the driver has at most (SLOTS + scripts) rows a language.
    """
    wide = SLOTS + len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _slices(batch):
                by: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, whole in by.items():
                    own = total.setdefault(lang, np.zeros(wide, np.int64))
                    for block in _blocks(whole, AT_ONCE):
                        found = letters(whole[block])
                        own += np.bincount(found.slot, minlength=wide)
                        own += np.bincount(found.script.astype(np.int64) + SLOTS, minlength=wide)
        for lang, own in total.items():
            slot = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int64()), pa.array(own[slot], pa.int64())], ["lang", "slot", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = ship(rows).mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((wide, len(langs)))
    table[counts["slot"].to_numpy(np.int64), [langs.index(x) for x in counts["lang"]]] = counts["n"]
    slots, scripts = table[:SLOTS], table[SLOTS:]
    scores = np.log((slots + SMOOTH) / (slots.sum(0) + SMOOTH * SLOTS)).astype(np.float32)
    return Model(langs, scores, scripts >= OPEN_FROM * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word: the words of all texts stand one after the other, ``counts`` has the words of each text.

    All texts advance together, one word a step, those that have ended drop out.
    """
    offset = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    offset, counts = offset[order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    live = np.searchsorted(-counts, -np.arange(steps), side="left")
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    state = np.zeros((len(counts), scores.shape[1]), np.float64)
    for t in range(steps):
        a = live[t]
        at, now = offset[:a] + t, state[:a]
        best = now.argmax(1)
        jump = now[np.arange(a), best] - switch
        stays = now >= jump[:, None]
        back[at] = np.where(stays, own, best[:, None])
        state[:a] = np.where(stays, now, jump[:, None]) + scores[at]
    label = np.zeros(len(scores), np.int16)
    here = state.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = live[t]
        at = offset[:a] + t
        label[at] = here[:a]
        here[:a] = back[at, here[:a]]
    return label


def label_texts(texts: list[str], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, share of letters, spans) of each text; a span is (language, start, length) in code points.

    The language is the one with most letters in the spans, ties to the first by name. A word whose script is open to no learned
    language, or to all alike, adds nothing to any.
    """
    out: list[tuple[str, float, list[tuple[str, int, int]]]] = []
    k = len(model.langs)
    for part in _blocks(texts, max(1, AT_ONCE * 4 // max(4, k))):
        block = texts[part]
        found = letters(block)
        if not len(found.at) or not k:
            out += [(UNKNOWN, 0.0, [])] * len(block)
            continue
        begin = np.flatnonzero(found.begins)
        score = np.add.reduceat(model.scores[found.slot], begin, axis=0)
        open_ = model.open[found.script[begin]]
        some = open_.any(1, keepdims=True)
        score = np.where(some, np.where(open_, score, -1e4), 0.0)
        text = found.text[begin]
        label = viterbi(score, np.bincount(text, minlength=len(block)), switch)
        size = np.diff(np.append(begin, len(found.at)))
        share = np.zeros((len(block), k))
        np.add.at(share, (text, label), size)
        total = share.sum(1)
        best = share.argmax(1)
        new = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (text[1:] != text[:-1])))
        start = found.at[begin]
        stop = found.at[np.append(begin[1:], len(found.at)) - 1] + 1
        first = np.cumsum([0] + [len(t) + 1 for t in block])
        spans: list[list[tuple[str, int, int]]] = [[] for _ in block]
        last = np.append(new[1:], len(begin)) - 1
        for i, a, b, lang in zip(text[new], start[new], stop[last], label[new]):
            spans[i].append((model.langs[lang], int(a - first[i]), int(b - a)))
        out += [(model.langs[best[i]], float(share[i, best[i]] / total[i]), spans[i]) if total[i] else (UNKNOWN, 0.0, [])
                for i in range(len(block))]
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, switch: float = SWITCH) -> DataFrame:
    """(``carry`` columns, lang_pred, score, spans): one row per row of ``docs``, in place, without a shuffle.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or has no letter; ``score`` is the share
    of letters in spans of that language. Only the text is looked at.
    """
    carry = carry or []
    # the text goes to Python and back once, also where it is carried
    given = docs.select(F.col(text).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if c != text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                made = label_texts([t or "" for t in part.column("text").to_pylist()], shared.value, switch)
                found = [[dict(zip(("lang", "start", "length"), s)) for s in m[2]] for m in made]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()),
                     pa.array(found, spans)], [*part.schema.names, "lang_pred", "score", "spans"])

    made = "lang_pred string, score double, spans array<struct<lang: string, start: long, length: long>>"
    out = ship(given).mapInArrow(run, StructType([*given.schema.fields, *StructType.fromDDL(made).fields]))
    back = [F.col("text" if c == text else f"c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(*back, "lang_pred", "score", "spans")


def held_out(key: Column) -> Column:
    """One row in five, by the key alone, is not learned from."""
    return lot(key, 5) == 0


def learn_held_out(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> Model:
    return learn(docs.filter(~held_out(F.col(key))), lang, text)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents by a model of those that are not held out."""
    found = predict(docs, learn_held_out(docs), carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
