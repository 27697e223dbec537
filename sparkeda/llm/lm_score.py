"""LM scoring: the marginal probability of a text over all ways to cut its words into pieces of a vocabulary.

A word that was learned is a piece of its own in its lattice, beside the pieces of the vocabulary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import keep, lot, ship, vocabulary

#: Mark of a word's start in the vocabulary; a literal one in a text is spelt in bytes.
START, LITERAL = 0x2581, 0x110000
#: Rounds of re-estimating the piece probabilities, from the vocabulary's own scores on.
ROUNDS = 3
#: Expected count that every piece has beforehand, so that no text is impossible.
PRIOR = 0.01
#: Words with at least one in so many of all training tokens are hot: there can be no more of them than this.
HOT = 1 << 15
HOT_BYTES = 64
#: Longer words are scored one by one.
BATCH_CHARS = 48
#: Products of probabilities below this are formed in log space, where nothing becomes 0.
LEAST = 1e-250
#: Words counted by a task before it hands them on.
COUNTED_AT_ONCE = 300_000
_NONE = -math.inf
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case. Bytes lower and split by ASCII alone, which is what is asked for."""
    return text.encode("utf-8", "replace").lower().split()


class Lattice:
    """All segmentations of words into pieces: marginal log-probabilities and expected piece counts.

    Pieces hold the start mark in front or not at all. A character without a piece of its own may be spelt in byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size = size
        self.bytes = np.zeros(256, np.int64)
        self.piece: dict[str, int] = {}
        scores = np.full(size, -float(size))
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(text[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)) and chr(START) not in text[1:]:
                self.piece[text] = i
                scores[i] = model.get_score(i)
        #: The vocabulary's scores are ranks; as weights they follow Zipf's law.
        used = np.zeros(size, bool)
        used[list(self.piece.values())] = True
        used[self.bytes] = True
        self.used = used
        first = np.where(used, 1.0 / (10.0 - scores), 0.0)
        self.first = np.log(first / first.sum() / 2, where=used, out=np.full(size, _NONE))
        self.longest = max(map(len, self.piece), default=1)
        self.tables = []
        for k in range(1, self.longest + 1):
            own = [(p, i) for p, i in self.piece.items() if len(p) == k]
            codes = np.array([[ord(c) for c in p] for p, _ in own], np.uint64).reshape(len(own), k)
            key = np.zeros(len(own), np.uint64)
            for j in range(k):
                key = key * _MIX + codes[:, j]
            order = np.argsort(key)
            maybe = np.zeros(1 << 16, bool)
            maybe[(key >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((key[order], np.array([i for _, i in own], np.int64)[order], maybe))

    def _ids(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per piece length: the piece that starts at each place (rows) of each word (columns), or -1."""
        out = []
        key = np.zeros(codes.shape, np.uint64)
        width = len(codes)
        for k in range(1, min(self.longest, width) + 1):
            key = key[:width - k + 1] * _MIX + codes[k - 1:]
            known, ids, maybe = self.tables[k - 1]
            found = np.full(key.shape, -1, np.int64)
            if len(known):
                where = np.nonzero(maybe[(key >> np.uint64(48)).astype(np.int64)])
                sought = key[where]
                at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
                found[where] = np.where(known[at] == sought, ids[at], -1)
            out.append(found)
        return out

    def _spelt(self, code: int) -> np.ndarray:
        return self.bytes[list((chr(START) if code == LITERAL else chr(code)).encode("utf-8", "replace"))]

    def _edges(self, codes: np.ndarray, logp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per piece length its ids and probabilities, 0 where there is no piece."""
        ids = self._ids(codes)
        chance = np.append(np.exp(logp), 0.0)                # -1 finds the last
        weights = [chance[i] for i in ids]
        bare = ids[0] < 0
        if bare.any():
            missing, back = np.unique(codes[bare], return_inverse=True)
            spelt = np.array([np.exp(logp[self._spelt(int(c))].sum()) for c in missing])
            weights[0][bare] = spelt[back]
        return ids, weights

    def _batch(self, codes: np.ndarray, logp: np.ndarray, weight: np.ndarray | None, total: np.ndarray | None) -> np.ndarray:
        """Marginals of words (columns) of one length, by forward recursion; with weights also adds expected counts.

        Probabilities are multiplied as they are. Words that come below ``LEAST`` are gone through again one by one, in log space.
        """
        width, n = codes.shape
        ids, edge = self._edges(codes, logp)
        ahead = np.zeros((width + 1, n))
        ahead[0] = 1.0
        for j in range(1, width + 1):
            for k in range(1, min(len(edge), j) + 1):
                ahead[j] += ahead[j - k] * edge[k - 1][j - k]
        low = ahead[width] < LEAST
        if total is not None:
            behind = np.zeros((width + 1, n))
            behind[width] = np.where(low, 0.0, weight / np.where(low, 1.0, ahead[width]))
            for j in range(width - 1, -1, -1):
                for k in range(1, min(len(edge), width - j) + 1):
                    behind[j] += behind[j + k] * edge[k - 1][j]
            for k in range(1, len(edge) + 1):
                share = ahead[:width - k + 1] * edge[k - 1] * behind[k:]
                own = ids[k - 1] >= 0
                total += np.bincount(ids[k - 1][own], weights=share[own], minlength=self.size)
                if k == 1 and not own.all():
                    for code, x in zip(codes[~own], share[~own]):
                        np.add.at(total, self._spelt(int(code)), x)
        with np.errstate(divide="ignore"):
            found = np.log(ahead[width])
        for r in np.flatnonzero(low):
            found[r] = self._long(codes[:, r].tolist(), logp, 0.0 if weight is None else float(weight[r]), total)
        return found

    def _long(self, codes: list[int], logp: np.ndarray, weight: float, total: np.ndarray | None) -> float:
        """The same for one word of any length, place by place."""
        text = "".join("\0" if c == LITERAL else chr(c) for c in codes)
        n = len(codes)
        edges: list[list[tuple[int, float, np.ndarray]]] = []
        for i in range(n):
            here = []
            for k in range(1, min(self.longest, n - i) + 1):
                p = self.piece.get(text[i:i + k])
                if p is not None:
                    here.append((k, float(logp[p]), np.array([p])))
            if not here or here[0][0] > 1:
                spelt = self._spelt(codes[i])
                here.append((1, float(logp[spelt].sum()), spelt))
            edges.append(here)

        def add(a: float, b: float) -> float:
            low, high = min(a, b), max(a, b)
            return high if low == _NONE else high + math.log1p(math.exp(low - high))

        ahead = [0.0] + [_NONE] * n
        for i, here in enumerate(edges):
            for k, w, _ in here:
                ahead[i + k] = add(ahead[i + k], ahead[i] + w)
        if total is not None:
            behind = [_NONE] * n + [0.0]
            for i in range(n - 1, -1, -1):
                for k, w, spelt in edges[i]:
                    behind[i] = add(behind[i], behind[i + k] + w)
                    np.add.at(total, spelt, weight * math.exp(ahead[i] + w + behind[i + k] - ahead[n]))
        return ahead[n]

    def marginals(self, found: list[bytes], logp: np.ndarray, weight: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each word; ``total`` gathers expected piece counts under ``weight`` copies of each."""
        if not found:
            return np.zeros(0)
        flat = np.frombuffer(b"\n".join(found).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)    # words hold no line feed
        flat = np.where(flat == START, LITERAL, flat).astype(np.uint64)
        ends = np.append(np.flatnonzero(flat == 10), len(flat))
        starts = np.append(0, ends[:-1] + 1)
        sizes = ends - starts
        out = np.zeros(len(found))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size > BATCH_CHARS:
                for r in rows:
                    out[r] = self._long([START, *flat[starts[r]:ends[r]].tolist()], logp, 0.0 if weight is None else float(weight[r]), total)
                continue
            step = max(1, 400_000 // int(size + 1))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                codes = np.full((size + 1, len(part)), START, np.uint64)
                codes[1:] = flat[starts[part] + np.arange(size)[:, None]]
                out[part] = self._batch(codes, logp, None if weight is None else weight[part], total)
        return out


_LOADED: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of (text, learns) with its count in the texts that are learned from, 0 if in none of them.

    Each task counts its words before they are shuffled, so a word in every text is one row a task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text, learns in zip(batch.column("text"), batch.column("learns")):
                own = words(text.as_py())
                if learns.as_py():
                    seen.update(own)
                else:
                    for w in own:
                        if w not in seen:
                            seen[w] = 0
                if len(seen) > COUNTED_AT_ONCE:
                    yield out()
                    seen = Counter()
        yield out()

    return ship(docs).select("text", "learns").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn_pieces(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(natural log-probability of each piece, of the end where a new token begins) from words with their counts.

    Each round weighs all segmentations of each word by the present probabilities, the first by the vocabulary's own scores,
    and counts what is expected. Tasks send one row per piece, so a round shuffles the vocabulary, not the words.
    """
    lat = lattice(path)
    logp = lat.first
    spark = counts.sparkSession
    starts = np.array([i for p, i in lat.piece.items() if p[0] == chr(START)], np.int64)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = lattice(path)
            total = np.zeros(own.size)
            for batch in batches:
                own.marginals(batch.column("word").to_pylist(), held.value, batch.column("c").to_numpy().astype(float), total)
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], ["piece", "n"])

        seen = counts.filter("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.where(lat.used, PRIOR, 0.0)
        n[seen["piece"].to_numpy(np.int64)] += seen["n"].to_numpy()
        whole = n.sum() + ends + PRIOR
        logp = np.log(n / whole, where=n > 0, out=np.full(lat.size, _NONE))
    begin = np.exp(logp[starts]).sum()
    stop = 1.0 - np.exp(logp[np.isfinite(logp)]).sum()
    return logp, math.log(stop / (begin + stop))


def score(docs: DataFrame, learns: Column, vocabulary_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``; null text is empty.

    ``learns`` marks the rows that counts and piece probabilities come from. ``score`` is the log10 probability of the whole text:
    its words one after the other, each marginal over all its segmentations, then an end. With N tokens of K kinds learned, the
    arc of the whole word weighs count / (N + K), the segmentations into pieces together K / (N + K) of their share among all
    words; the end likewise. So the probabilities of all tokens add up to 1, those of unseen words included. ``base_score`` is the
    add-one word model, which gives every unseen word the same.

    Hot words, whose number has a bound, go to every task; the other words of a text are one row each, meet their count and
    probability in a join and are summed up by text. Rows equal in id and text are scored once and returned as often.
    """
    path = vocabulary_path or vocabulary("piece_bpe_32k.model")
    rows = ship(docs).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                             F.coalesce(learns, F.lit(False)).alias("learns"))
    counts = keep(word_counts(rows))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = rows.agg(F.count_if("learns").alias("n")).first()["n"]
    tokens, distinct = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    logp, stop = learn_pieces(counts, ends, path)
    kinds = distinct or 1
    spread, every = math.log(kinds), math.log(tokens + kinds)
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    scale = math.log10(math.e)
    last = math.log10((ends + kinds * math.exp(stop)) / (tokens + kinds))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = lattice(path).marginals(batch.column("word").to_pylist(), shared.value)
            with np.errstate(divide="ignore"):
                arc = np.log(batch.column("c").to_numpy().astype(float))
            found = (np.logaddexp(arc, pieces + spread) - every) * scale
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(found)], ["word", "c", "lp"])

    known = keep(counts.select("word", "c").mapInArrow(marginal, "word binary, c long, lp double"))
    bound = max(1, -(-tokens // HOT))
    hot = {bytes(r["word"]): (r["c"], r["lp"]) for r in
           known.filter((F.col("c") >= bound) & (F.length("word") <= HOT_BYTES)).collect()}
    frequent = docs.sparkSession.sparkContext.broadcast(hot)
    below = math.log10(tokens + distinct + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = frequent.value
        base = {w: math.log10(c + 1) - below for w, (c, _) in own.items()}
        for batch in batches:
            at, word, n, n_tokens, n_known, base_sum, score_sum, sums_ = [], [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                mine = Counter(words(text.as_py()))
                total, sure, b, s = 1, int(ends > 0), math.log10(ends + 1) - below, last
                rare = []
                for w, k in mine.items():
                    total += k
                    got = own.get(w)
                    if got is None:
                        rare.append((w, k))
                    else:
                        sure += k
                        b += k * base[w]
                        s += k * got[1]
                at += [i] * (len(rare) + 1)
                word.append(b" %d" % (i * 1_000_003 + total))    # holds a blank, so it is no word and meets nothing
                n.append(0)
                n_tokens.append(total)
                n_known.append(sure)
                base_sum.append(b)
                score_sum.append(s)
                sums_.append(1)
                for w, k in rare:
                    word.append(w)
                    n.append(k)
                zeros = len(rare)
                n_tokens += [0] * zeros
                n_known += [0] * zeros
                base_sum += [0.0] * zeros
                score_sum += [0.0] * zeros
                sums_ += [0] * zeros
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(word, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base_sum, pa.float64()),
                 pa.array(score_sum, pa.float64()), pa.array(sums_, pa.int64())],
                ["doc_id", "h", "word", "n", "n_tokens", "n_known", "base", "score", "whole"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(
        cut, f"doc_id {kind}, h long, word binary, n long, n_tokens long, n_known long, base double, score double, whole long")
    met = parts.join(known, "word", "left")
    c, lp = F.coalesce("c", F.lit(0)), F.coalesce("lp", F.lit(0.0))
    summed = met.groupBy("doc_id", "h").agg(
        F.sum("whole").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * (F.log10(c + 1) - below)).alias("base_score"),
        F.sum(F.col("score") + F.col("n") * lp).alias("score"))
    one = summed.select(
        "doc_id", *(F.expr(f"cast({x} div copies as bigint)").alias(x) for x in ("n_tokens", "n_known")),
        F.lit(tokens).cast("bigint").alias("train_tokens"), *((F.col(x) / F.col("copies")).alias(x) for x in ("base_score", "score")), "copies")
    return one.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies")


def score_held_out(docs: DataFrame) -> DataFrame:
    """``score`` of documents by a model of those whose CRC-32 of the id, modulo 7, is not 2, with that mark."""
    out = lot(F.col("doc_id"), 7) == 2
    return score(docs, ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
