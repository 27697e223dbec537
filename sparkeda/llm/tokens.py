"""Token ids of whole texts by the tokenizers library, one call per distinct stretch between blanks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import compress

import numpy as np

#: Stretches remembered by a Python worker, at about 200 bytes each. The bound keeps memory flat; a stretch beyond it is
#: encoded again when met again.
REMEMBERED = 300_000
#: Code points taken at a time, so that lists of stretches stay small whatever the batch.
AT_ONCE = 2_000_000
#: Stretches that are encoded as one text.
JOINED = 500
#: Words of plain texts remembered beside the stretches; most of the work is encoding those that are not.
WORDS = 500_000

_LOADED: dict[tuple, object] = {}


def load(path: str):
    """The library's tokenizer without truncation and padding. Spark runs the tasks, so the library runs one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def remembered(path: str, encode: Callable) -> tuple:
    """(tokenizer, memory, encode) of this worker process, shared by its tasks. ``encode`` gives each of many stretches its ids."""
    if (path, encode.__name__) not in _LOADED:
        _LOADED[path, encode.__name__] = (load(path), {}, encode)
    return _LOADED[path, encode.__name__]


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode_each(tokenizer, stretches: list[str]) -> list[bytes]:
    """Ids of each stretch, as bytes of four each."""
    return [as_bytes(e.ids) for e in tokenizer.encode_batch(stretches, add_special_tokens=False)]


def encode_joined(tokenizer, stretches: list[str]) -> list[bytes]:
    """The same for a tokenizer that drops white space: many stretches as one text, cut where the next one starts."""
    out: list[bytes] = []
    for a in range(0, len(stretches), JOINED):
        part = stretches[a:a + JOINED]
        made = tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = as_bytes(made.ids)
        begins = np.fromiter((o[0] for o in made.offsets), np.int64, len(made.ids))
        ends = np.searchsorted(begins, np.cumsum([len(s) + 1 for s in part]), side="left") * 4
        out += [ids[b:e] for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return out


def table_of(path: str, build: Callable) -> list:
    """What ``build`` makes of the tokenizer, once in a worker process."""
    if (path, build.__name__) not in _LOADED:
        _LOADED[path, build.__name__] = build(load(path))
    return _LOADED[path, build.__name__]


def known(stretches: Iterable[str], tokenizer, memory: dict, encode: Callable, room: int | None = None) -> dict:
    """Ids of all the stretches; new ones are encoded together and remembered while there is room."""
    distinct = set(stretches)
    fresh = [s for s in distinct if s not in memory]
    made = dict(zip(fresh, encode(tokenizer, fresh)))
    room = REMEMBERED if room is None else room
    if len(memory) + len(made) <= room:
        memory.update(made)
        return memory
    for s in fresh[:max(0, room - len(memory))]:
        memory[s] = made[s]
    made.update((s, memory[s]) for s in distinct if s in memory)
    return made


#: How a tokenizer whose words ``encode_bare`` knows normalizes and splits its text.
_NORMAL = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Texts of characters that NFC keeps and of which lower case is one character, and the same split for them.
_PLAIN = re.compile("[ \\t\\n\\r!-~À-ÖØ-öø-įı-ſ\u2010-\u2027]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")


def word_ends(tokenizer) -> list:
    """[whether an id ends a word, texts that are ids of their own, ids of words]; empty if the tokenizer splits in another way."""
    made = json.loads(tokenizer.to_str())
    end = made["model"].get("end_of_word_suffix")
    if made["normalizer"] != _NORMAL or made["pre_tokenizer"] != _SPLIT or not end:
        return []
    ids = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(ids.values()) + 1, bool)
    ends[[i for t, i in ids.items() if t.endswith(end)]] = True
    return [ends, [t["content"] for t in made["added_tokens"]], {}]


def _encode_plain(tokenizer, words: Sequence[str], ends: np.ndarray) -> list[bytes]:
    """Ids of each word: many as one text, cut after the ids that end a word, which spares the offsets."""
    out: list[bytes] = []
    for a in range(0, len(words), JOINED):
        part = words[a:a + JOINED]
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        stops = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(stops) != len(part) or stops[-1] != 4 * len(ids):
            out += encode_each(tokenizer, list(part))
            continue
        data = ids.tobytes()
        out += [data[b:e] for b, e in zip([0, *stops[:-1]], stops)]
    return out


def joined(parts: Iterable[list[str]], tokenizer, memory: dict, encode: Callable, room: int) -> list[bytes]:
    """The ids of each list of stretches, one after the other; new ones are encoded together and remembered while there is room."""
    parts = list(parts)
    found = [list(map(memory.get, p)) for p in parts]
    fresh = list(dict.fromkeys(s for p, f in zip(parts, found) for s, ids in zip(p, f) if ids is None))
    made = dict(zip(fresh, encode(tokenizer, fresh)))
    for s in fresh[:max(0, room - len(memory))]:
        memory[s] = made[s]
    return [b"".join([made[s] if ids is None else ids for s, ids in zip(p, f)]) for p, f in zip(parts, found)]


def encode_bare(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each whole text by a tokenizer that drops white space, which is encoded once for each distinct word or stretch.

    Texts of plain characters are cut into the tokenizer's own words if it is known how it splits them, others between blanks.
    """
    tokenizer, memory, encode = remembered(path, encode_joined)
    ends, own, words = table_of(path, word_ends) or (None, [], {})
    plain = [ends is not None and _PLAIN.fullmatch(t) is not None and not any(o in t for o in own) for t in texts]
    cut = joined((_WORD.findall(t.lower()) for t in compress(texts, plain)), tokenizer, words, lambda t, new: _encode_plain(t, new, ends), WORDS)
    rest = joined((bare_stretches(t) for t, p in zip(texts, plain) if not p), tokenizer, memory, encode, REMEMBERED)
    one, other = iter(cut), iter(rest)
    return [next(one) if p else next(other) for p in plain]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``AT_ONCE`` code points together, at least one text each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


_STRETCH = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def bare_stretches(text: str) -> list[str]:
    """What lies between blanks and line feeds: enough where the tokenizer drops white space before it splits words."""
    return [s for s in text.replace("\n", " ").split(" ") if s]


def led_stretches(text: str) -> list[str]:
    """The text cut before each run of blanks and line feeds: enough where a word keeps the blank before it.

    A byte-level tokenizer never joins a character with white space after it, and looks past a run of white space only to see
    where it ends. Other white space could make such a run with a blank, so a text that has any stays whole.
    """
    return [text] if _OTHER_SPACE.search(text) else _STRETCH.findall(text)
