"""Best-fit packing by sums of squares: documents as token pieces, placed into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeda.llm import tokens
from sparkeda.llm.shared import keep, ship, texts, through_python, vocabulary

#: Pieces packed together in one task. The number of groups grows with the input, a group's work does not.
GROUP = 16_384


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and its end id, cut only where it exceeds ``size``."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        close = tokens.as_bytes([end])
        for batch in batches:
            ids, whole = batch["doc_id"].tolist(), batch["text"].tolist()
            out = []
            for a, b in tokens.blocks(whole):
                for doc, data in zip(ids[a:b], tokens.encode_bare(tokenizer, whole[a:b])):
                    data += close
                    for piece, at in enumerate(range(0, len(data), 4 * size)):
                        run = data[at:at + 4 * size]
                        out.append((doc, piece, at // 4, len(run) // 4, zlib.crc32(run)))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = pd.array(made["doc_id"], dtype="object")
            yield made

    plain = ship(texts(docs, key, text))
    kind, sent = plain.schema["doc_id"].dataType.simpleString(), through_python(plain, "doc_id")
    made = sent.mapInPandas(cut, f"doc_id {sent.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, pieces taken from the longest to the shortest.

    ``open_[g]`` counts the sequences with room for g more tokens. A piece of length s in a sequence with room g turns the
    squares of open_[g] and open_[g - s]; it goes where the sum of all squares becomes smallest, ties to the least room. A
    full sequence counts no more. A new sequence is begun where no open one has room.
    """
    open_ = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    begun = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        rooms = open_[s:size]
        where = np.flatnonzero(rooms)
        if len(where):
            left = open_[where]
            change = 2 * left + 1 - 2 * rooms[where]
            if where[0] == 0:
                change[0] -= 1                                  # nothing is left open
            g = s + int(where[np.argmin(change)])
            to = stacks[g].pop()
            open_[g] -= 1
        else:
            g, to, begun = size, begun, begun + 1
        sequence[i], offset[i] = to, size - g
        if g > s:
            open_[g - s] += 1
            stacks[g - s].append(to)
    return sequence, offset


def pack(parts: DataFrame, size: int = 4096, group: int = GROUP) -> DataFrame:
    """``parts`` (with ``length``) plus sequence_id and offset; every length is 1 to ``size``.

    Pieces are dealt at random into groups of about ``group`` and each group is packed in one task, so copies or sources of any
    size spread evenly. An empty table gives an empty table; repeated rows are pieces of their own.
    """
    held = keep(ship(parts))
    groups = max(1, -(-held.count() // group))
    names = parts.columns
    # the place in the checkpoint parts equal rows and is the same if a task runs again
    dealt = held.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *names), F.lit(groups)).cast("long"))
    sent = through_python(dealt, *(n for n in names if n != "length"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *names], ascending=False, ignore_index=True)
        sequence, offset = place(rows["length"].to_numpy(), size)
        return rows.assign(sequence_id=rows["group"] * (1 << 32) + sequence, offset=offset).drop(columns="group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name != "group")
    filled = sent.groupBy("group").applyInPandas(fill, f"{schema}, sequence_id long, offset long")
    return filled.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in parts.schema), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end: int = 1,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every row of ``docs``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are the end id alone. Only documents longer than ``size`` are cut.
    """
    return pack(pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), size, end, key, text), size)
