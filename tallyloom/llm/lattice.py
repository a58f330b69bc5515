"""Language-model scores by a subword lattice.

A text is a sequence of words, each written with the vocabulary's word mark in
front, then one end. Its probability is the sum over every way to cut it into
pieces of an existing vocabulary, found by a forward recursion in log space.
No piece crosses a word mark, so the sum factors into words, and each different
word of the corpus is scored once.

The vocabulary's own scores give the first piece weights. Expected piece counts
under the lattice over all training words, each as often as it occurs, then
re-estimate them (expectation maximisation), and the ends of texts are counted
with them. Characters outside the vocabulary, and bytes that are no valid
UTF-8, are spelled with its byte pieces, so no text has probability zero.

``score`` is this lattice alone. ``word_score`` stands apart from it: there each
training word is one more edge, from its mark to its end, which weighs its
count, and the pieces together weigh as much as the words seen once.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 40  # characters; longer words take the scalar path
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Pieces and weights. A merge vocabulary scores a piece by minus its rank, so the weight is 1 / (rank + 10).

    The last 256 pieces are the bytes; they share one part in a thousand.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
            pieces.append(model.id_to_piece(i))
            weights.append(1.0 / (10.0 - model.get_score(i)))
    w = np.asarray(weights)
    return pieces, np.concatenate([w / w.sum() * 0.999, np.full(256, 0.001 / 256)])


class Lattice:
    """Piece log probabilities (natural) and the two passes over words."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        self.pieces, self.log = pieces, np.log(weights)
        self.n = len(pieces)
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        # Open addressing with a load of about 1/32; `reach` is the longest probe.
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 32))))
        self.slots, self.ids, self.reach = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 1
        for i, k in enumerate(keys):
            at, probes = int(self._slot(k)), 1
            while self.ids[at] >= 0:
                at, probes = (at + 1) & ((1 << self.bits) - 1), probes + 1
            self.slots[at], self.ids[at], self.reach = k, i, max(self.reach, probes)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return (np.uint64(h) if np.isscalar(h) else h) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``h`` that are pieces, and their ids."""
        at = self._slot(h).astype(np.int64)
        here = self.slots[at]
        hit = here == h
        rows, ids = np.flatnonzero(hit), self.ids[at[hit]]
        left = np.flatnonzero(~hit & (here != 0))
        for _ in range(self.reach - 1):
            if not len(left):
                break
            at_left = (at[left] + 1) & ((1 << self.bits) - 1)
            at[left] = at_left
            here = self.slots[at_left]
            hit = here == h[left]
            rows, ids = np.concatenate([rows, left[hit]]), np.concatenate([ids, self.ids[at_left[hit]]])
            left = left[~hit & (here != 0)]
        return rows, ids

    def _spelled(self, points: np.ndarray) -> np.ndarray:
        """Log probability of spelling each character with byte pieces."""
        values, inverse = np.unique(points, return_inverse=True)
        cost = np.array([sum(self.log[self.n + b] for b in chr(v).encode("utf-8", "surrogateescape")) for v in values])
        return cost[inverse].reshape(points.shape)

    def _edges(self, points: np.ndarray):
        """points: words x length code points. Rows and piece ids by (end, length), and the cost of spelling."""
        n, length = points.shape
        sums = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            sums[j + 1] = sums[j] * _BASE + points[:, j].astype(np.uint64) + np.uint64(1)
        power = [np.uint64(1)]
        for _ in range(self.longest):
            power.append(np.uint64(int(power[-1]) * int(_BASE) & (2**64 - 1)))
        edges = [[] for _ in range(length + 1)]
        for j in range(1, length + 1):
            for k in range(1, min(j, self.longest) + 1):
                rows, ids = self._find(sums[j] - sums[j - k] * power[k])
                if len(rows):
                    edges[j].append((j - k, rows, ids, self.log[ids]))
        return edges, self._spelled(points)

    def _forward(self, points, edges, spelled):
        n, length = points.shape
        alpha = np.zeros((length + 1, n))
        for j in range(1, length + 1):
            alpha[j] = alpha[j - 1] + spelled[:, j - 1]
            for i, rows, _, log in edges[j]:
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + log)
        return alpha

    def _batches(self, words: list[str]):
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                text = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
                yield np.asarray(part), np.frombuffer(text, np.uint32).reshape(len(part), length)

    def _scalar(self, word: str, count: float | None = None, expected: np.ndarray | None = None) -> float:
        """One word of any length; adds ``count`` times its expected piece counts to ``expected``."""
        length = len(word)
        spelled = [sum(self.log[self.n + b] for b in c.encode("utf-8", "surrogateescape")) for c in word]
        edges = [[] for _ in range(length + 1)]
        alpha = np.full(length + 1, -np.inf)
        alpha[0] = 0.0
        for j in range(1, length + 1):
            edges[j] = [(j - 1, -1, spelled[j - 1])]
            for k in range(1, min(j, self.longest) + 1):
                i = self.index.get(word[j - k : j])
                if i is not None:
                    edges[j].append((j - k, i, self.log[i]))
            x = np.array([alpha[a] + l for a, _, l in edges[j]])
            alpha[j] = x.max() + np.log(np.exp(x - x.max()).sum())
        if expected is not None:
            beta = np.full(length + 1, -np.inf)
            beta[length] = 0.0
            for j in range(length, 0, -1):
                for a, i, l in edges[j]:
                    beta[a] = np.logaddexp(beta[a], l + beta[j])
                    g = count * np.exp(alpha[a] + l + beta[j] - alpha[length])
                    if i >= 0:
                        expected[i] += g
                    else:
                        for b in word[a].encode("utf-8", "surrogateescape"):
                            expected[self.n + b] += g
        return float(alpha[length])

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, all segmentations summed. ``words`` carry the mark."""
        out = np.zeros(len(words))
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
        for rows, points in self._batches([w for w in words if len(w) <= LONG]):
            edges, spelled = self._edges(points)
            out[short[rows]] = self._forward(points, edges, spelled)[-1]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._scalar(w)
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts over ``words``, each seen ``counts`` times."""
        total = np.zeros(self.n + 256)
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
        for rows, points in self._batches([w for w in words if len(w) <= LONG]):
            c = counts[short[rows]]
            edges, spelled = self._edges(points)
            alpha = self._forward(points, edges, spelled)
            length = points.shape[1]
            beta = np.full(alpha.shape, -np.inf)
            beta[length] = 0.0
            used, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
            letters, spelling = [], []
            for j in range(length, 0, -1):
                step = spelled[:, j - 1] + beta[j]
                beta[j - 1] = np.logaddexp(beta[j - 1], step)
                letters.append(points[:, j - 1])
                spelling.append(c * np.exp(alpha[j - 1] + step - alpha[length]))
                for i, at, ids, log in edges[j]:
                    step = log + beta[j, at]
                    beta[i, at] = np.logaddexp(beta[i, at], step)
                    used.append(ids)
                    shares.append(c[at] * np.exp(alpha[i, at] + step - alpha[length, at]))
            total[: self.n] += np.bincount(np.concatenate(used), np.concatenate(shares), self.n)
            values, inverse = np.unique(np.concatenate(letters), return_inverse=True)
            for v, x in zip(values, np.bincount(inverse, np.concatenate(spelling))):
                for b in chr(v).encode("utf-8", "surrogateescape"):
                    total[self.n + b] += x
        for i, w in enumerate(words):
            if len(w) > LONG:
                self._scalar(w, counts[i], total)
        return total


def _marked(words) -> list[str]:
    return [MARK + w.decode("utf-8", "surrogateescape") for w in words]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long): training count of every word of ``docs`` (doc_id, text binary, held_out), 0 if only held out."""

    def run(batches):
        learned, other = Counter(), set()
        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").lower().split()
                if held:
                    other.update(words)
                else:
                    learned.update(words)
                if len(learned) + len(other) > 300_000:
                    yield pack(learned, other)
                    learned, other = Counter(), set()
        yield pack(learned, other)

    def pack(learned, other):
        only = [w for w in other if w not in learned]
        return pa.RecordBatch.from_arrays([pa.array([*learned, *only], pa.binary()), pa.array([*learned.values(), *[0] * len(only)], pa.int64())], names=["word", "c"])

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _expectation(counts: DataFrame, lattice: Lattice, size: int) -> np.ndarray:
    """Expected counts of all pieces over the training words, each as often as it occurs."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += lattice.expect(_marked(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype(float))
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(total[where])], names=["piece", "n"])

    out = np.zeros(size)
    # At most one row per piece of the vocabulary reaches the driver.
    for r in counts.where("c > 0").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


def estimate(counts: DataFrame, ends: int, vocabulary: str = VOCABULARY, rounds: int = 2) -> tuple[Lattice, float]:
    """The lattice of re-estimated weights and the end's natural log probability, from word ``counts`` (word, c) and ``ends`` of texts.

    Every piece and the end start each round at 0.01. Without a training word the
    weights are the vocabulary's, and the end has one part in a hundred.
    """
    pieces, weights = read_vocabulary(vocabulary)
    weights, end = weights * 0.99, 0.01
    if counts.where("c > 0").isEmpty():
        rounds = 0
    for _ in range(rounds):
        expected = _expectation(counts, Lattice(pieces, weights), len(weights)) + 0.01
        total = expected.sum() + ends + 0.01
        weights, end = expected / total, (ends + 0.01) / total
    return Lattice(pieces, weights), float(np.log(end))


def _word_id(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def score_texts(docs: DataFrame, held_out, vocabulary: str = VOCABULARY, rounds: int = 2, common: int = 200_000, share: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score: one row per row of ``docs``.

    ``held_out`` is a boolean column; the other rows are learned from. Tokens
    are the words, A-Z lower-cased, and one end. base_score is the add-0.1
    unigram, score the log10 lattice probability of the whole text, word_score
    that with training words as edges. A null or empty text is its end alone.
    Repeated rows count and come out each; a null doc_id counts as the empty
    text where rows are dealt by id. Other columns are ignored.

    Words seen in more than one of ``common`` training tokens, so fewer than
    ``common`` of them at any input size, are looked up in a broadcast table;
    all others go through a join on a 64-bit hash. ``share`` is about the number
    of different words in one task.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    numbered = d.withColumn("row", F.monotonically_increasing_id())
    merged = keep(word_counts(d))
    # Scoring words is the costly part, so a task gets a bounded share of them at any input size.
    counts = keep(merged.repartition(1 + merged.count() // share, "word"))
    drop(merged)
    facts = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = d.where(~F.col("held_out")).count()
    n_train, distinct = (facts.n or 0) + ends, (facts.v or 0) + (ends > 0)
    fresh = max(1, facts.once or 0)
    total = float(np.log(n_train + fresh + 0.5))
    lattice, end = estimate(counts, ends, vocabulary, rounds)
    ten = float(np.log(10))

    def scored(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            with np.errstate(divide="ignore"):
                whole = np.log(batch.column(1).to_numpy().astype(float))
            log = lattice.score(_marked(words))
            memory = np.logaddexp(whole, np.log(fresh) + log) - total
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_word_id(words)), batch.column(1), pa.array(log / ten), pa.array(memory / ten)], names=["word", "id", "c", "score", "word_score"])

    known = keep(counts.mapInArrow(scored, "word binary, id long, c long, score double, word_score double"))
    drop(counts)
    often = known.where(F.col("c") * common > F.lit(n_train)).select("word", "c", "score", "word_score").collect()
    base = lambda c: np.log10((c + 0.1) / (n_train + 0.1 * (distinct + 1)))
    places = {bytes(r.word): i for i, r in enumerate(often)}
    # Rows: known, base, score, word score; the last column is for rare words, which the join adds.
    values = np.array([*([1.0, base(r.c), r.score, r.word_score] for r in often), [0.0] * 4]).T.copy()
    tables = docs.sparkSession.sparkContext.broadcast((places, values))

    def sums(batches):
        places, values = tables.value
        get = places.get
        for batch in batches:
            heads, rare, size = [], [], 0
            ids, held, at_row = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, text in enumerate(batch.column(1)):
                times = Counter((text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split())
                n = np.fromiter(times.values(), np.int64, len(times))
                at = np.fromiter(map(get, times, repeat(-1)), np.int64, len(times))
                heads.append((at_row[k], ids[k], held[k], int(n.sum()), *(values[:, at] @ n).tolist()))
                left = np.flatnonzero(at < 0)
                if len(left):
                    words = list(times)
                    rare.append((np.full(len(left), at_row[k]), _word_id([words[i] for i in left.tolist()]), n[left]))
                    size += len(left)
                if size > 200_000:
                    yield pack(heads, rare)
                    heads, rare, size = [], [], 0
            yield pack(heads, rare)

    def pack(heads, rare):
        """Rows of two kinds: texts (times null) and their rare words."""
        h = list(zip(*heads)) or [()] * 8
        kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("k", pa.float64()), ("b", pa.float64()), ("s", pa.float64()), ("w", pa.float64()), ("id", pa.int64()), ("times", pa.int64())]
        r = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in rare)])) for k in range(3)]
        columns = [pa.array(h[k], kind) if k < 8 else pa.nulls(len(heads), kind) for k, (_, kind) in enumerate(kinds)]
        added = [r[0], *(pa.nulls(len(r[0]), kind) for _, kind in kinds[1:8]), r[1], r[2]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(columns, added)], names=[name for name, _ in kinds])

    mixed = keep(numbered.select("doc_id", "text", "held_out", "row").mapInArrow(sums, "row long, doc_id long, held_out boolean, n long, k double, b double, s double, w double, id long, times long"))
    heads = mixed.where("times IS NULL").select("row", "doc_id", "held_out", "n", "k", "b", "s", "w")
    rare = mixed.where("times IS NOT NULL").select("row", "id", "times")
    facts_of = known.select("id", (F.col("c") > 0).cast("double").alias("k"), F.log10((F.col("c") + 0.1) / F.lit(n_train + 0.1 * (distinct + 1))).alias("b"), F.col("score").alias("s"), F.col("word_score").alias("w"))
    t = F.col("times")
    added = rare.join(facts_of, "id").groupBy("row").agg(*(F.sum(F.col(c) * t).alias(f"{c}_rare") for c in "kbsw"))
    both = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_rare"), F.lit(0.0))
    return heads.join(added, "row", "left").select(
        "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"), (both("k").cast("long") + int(ends > 0)).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (both("b") + float(base(float(ends)))).alias("base_score"), (both("s") + end / ten).alias("score"), (both("w") + float((np.log(ends + 0.5) - total) / ten)).alias("word_score"),
    )
