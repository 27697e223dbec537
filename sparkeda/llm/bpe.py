"""BPE encoding and decoding: long texts are encoded in parts and the parts joined as a tree."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.llm import tokens
from sparkeda.llm.shared import ship, through_python, vocabulary

#: Texts of more code points are encoded in parts of this size, in parallel.
LEAF = 16_384
#: Bytes on either side of a join that are encoded again at first; doubled until both sides agree. More than any special token.
WINDOW = 64


def byte_table(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, whose characters each stand for one byte.

    Printable Latin-1 bytes stand for themselves, the others follow from code point 256 on in their order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    table: list[bytes] = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return table


def _kind(c: str) -> str:
    """L letter, N number, S white space, P anything else that is assigned, ? not certain."""
    group = unicodedata.category(c)
    if group[0] in "LN":
        return group[0]
    if c.isspace():
        return "?" if "\x1c" <= c <= "\x1f" else "S"
    return "?" if group == "Cn" else "P"


def _parts(x: str, y: str) -> bool:
    """Whether words always part between these two characters, whatever surrounds them."""
    a, b = _kind(x), _kind(y)
    return b == "S" and a in "LNP" or a in "LN" and b in "LNP" and a != b or a == "P" and b == "N"


class Joiner:
    """Joins the ids of two neighbouring texts into those of the whole."""

    def __init__(self, tokenizer, table: list[bytes], window: int = WINDOW):
        self.tokenizer, self.table, self.window = tokenizer, table, window

    def _back(self, ids: list[int], size: int) -> int:
        """Index from which the ids hold at least ``size`` bytes and begin with a whole character; 0 if there is none."""
        i, held = len(ids), 0
        while i > 0 and (held < size or 0x80 <= self.table[ids[i]][0] < 0xC0):
            i -= 1
            held += len(self.table[ids[i]])
        return i

    def _ahead(self, ids: list[int], size: int) -> int:
        j, held = 0, 0
        while j < len(ids) and (held < size or 0x80 <= self.table[ids[j]][0] < 0xC0):
            held += len(self.table[ids[j]])
            j += 1
        return j

    def _text(self, ids: list[int]) -> str:
        return b"".join([self.table[i] for i in ids]).decode("utf-8", "replace")

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encodes a window around the join again, a larger one each time, until it agrees with both sides.

        A side agrees if the window ends where words always part, for then nothing beyond can change it; or if the window ends
        inside one run of letters and the outermost id is the same as before. Then each two neighbouring ids of the result
        stand next to each other in a proper encoding of that run, which makes the whole a proper one. At the latest the
        window covers both texts.
        """
        size = self.window
        while True:
            i, j = self._back(left, size), self._ahead(right, size)
            inner = left[i:] + right[:j]
            text = self._text(inner)
            made = self.tokenizer.encode(text, add_special_tokens=False).ids
            if self._agrees(left[:i], text, made[:1] == inner[:1], before=True) and \
                    self._agrees(right[j:], text, made[-1:] == inner[-1:], before=False):
                return left[:i] + made + right[j:]
            size *= 2

    def _agrees(self, outside: list[int], text: str, same: bool, before: bool) -> bool:
        if not outside:
            return True
        if before:
            near = self._text(outside[-8:])[-4:]
            x, y, run = near[-1:], text[:1], near + text[:self.window // 4]
        else:
            near = self._text(outside[:8])[:4]
            x, y, run = text[-1:], near[:1], text[-(self.window // 4):] + near
        return bool(x) and bool(y) and (_parts(x, y) or same and len(near) == 4 and all(_kind(c) == "L" for c in run))

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours, then neighbours of these, up to the whole."""
        while len(parts) > 1:
            parts = [self.join(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(f) // 4 for f in found], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(found), np.int32))


def _encoded(df: DataFrame, path: str) -> DataFrame:
    """``df`` with its column ``text`` replaced by ``ids``; texts are encoded as they are."""
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = tokens.remembered(path, tokens.encode_each)
        for batch in batches:
            whole = batch.column("text").to_pylist()
            for a, b in tokens.blocks(whole):
                parts = [tokens.led_stretches(t) for t in whole[a:b]]
                found = tokens.known((s for p in parts for s in p), *state)
                ids = _lists([b"".join([found[s] for s in p]) for p in parts])
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), ids], [*names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return ship(df).mapInArrow(run, f"{schema}, ids array<int>")


def encode(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, window: int = WINDOW,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the library gives them without added special tokens; null is empty.

    Texts of at most ``leaf`` code points are encoded where they are read. Longer ones are cut into parts of that size, the
    parts dealt over all tasks and encoded, and the ids of a text brought together and joined as a tree. Only those ids are
    shuffled. Repeated rows of one id and text are encoded once and returned as often as they came; texts of one id that
    differ are told apart by a hash.
    """
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = _encoded(whole.filter(F.length("text") <= leaf), path)
    kind = whole.schema["doc_id"].dataType.simpleString()
    long = through_python(whole.filter(F.length("text") > leaf).withColumn("h", F.xxhash64("text")), "doc_id")
    sent = long.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, h, t in zip(batch["doc_id"], batch["h"], batch["text"]):
                at = range(0, len(t), leaf)
                yield pd.DataFrame({"doc_id": pd.Series([doc] * len(at), dtype=batch["doc_id"].dtype), "h": h, "part": list(at),
                                    "text": [t[k:k + leaf] for k in at]})

    parts = ship(long).mapInPandas(cut, f"doc_id {sent}, h long, part long, text string")
    dealt = _encoded(parts.repartition("doc_id", "h", "part"), path)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        library, *_ = tokens.remembered(path, tokens.encode_each)
        table = tokens.table_of(path, byte_table)
        copies = int((rows["part"] == 0).sum())
        ordered = rows.drop_duplicates("part").sort_values("part")
        ids = Joiner(library, table, window).tree([p.tolist() for p in ordered["ids"]])
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].repeat(copies), "ids": [ids] * copies})

    joined = dealt.groupBy("doc_id", "h").applyInPandas(join, f"doc_id {sent}, ids array<int>")
    return short.unionByName(joined.withColumn("doc_id", F.col("doc_id").cast(kind)))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text): the text of ``ids``, special tokens included; bytes that are no UTF-8 become replacement characters."""
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.table_of(path, byte_table)
        for batch in batches:
            made = [b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return ship(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows of (doc_id, ids), which are decoded for the last one."""
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.table_of(path, byte_table)
        names, sha = [str(i) for i in range(len(table))], lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            column = batch.column("ids")
            counts, idss, texts = [], [], []
            for k in range(len(column)):
                ids = column[k].values.to_numpy().tolist()
                counts.append(len(ids))
                idss.append(sha(",".join([names[i] for i in ids]).encode()))
                texts.append(sha(b"".join([table[i] for i in ids]).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(idss, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ship(encoded).select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
