"""Toxicity by a convolutional text classifier, trained in NumPy.

Words are hashed into buckets; every bucket that enough training texts share has
an embedding, all others share one. Filters of several widths slide over the
whole text, each keeps its maximum, and a logistic layer weighs the maxima.

Because an embedding times one row of a filter depends on the bucket alone,
scoring first multiplies the two tables and then only adds rows, so a text costs
a few additions a word whatever its length. Texts are read in pieces whose
overlap is the widest filter less one, so memory does not grow with a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, spread

#: Edge marks are dropped from words, so "word," and "word%%%" are one feature.
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Model:
    embeddings: np.ndarray  # rows x dims; row 0 is shared by all other words
    buckets: np.ndarray  # sorted hashes that have a row of their own, rows 1..
    filters: list[np.ndarray]  # width x dims x maps
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    trained: bool = True

    def tables(self) -> list[np.ndarray]:
        """Embeddings times each row of each filter: width x rows x maps."""
        return [np.einsum("rd,wdm->wrm", self.embeddings, f).astype(np.float32) for f in self.filters]


def hashes(text: bytes | None, bits: int = 24) -> np.ndarray:
    """Buckets of the words of a whole text, lower-cased, edge marks dropped."""
    words = [w.strip(_EDGES) for w in (text or b"").decode("utf-8", "replace").lower().encode().split()]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - bits)


def _rows(model: Model, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(model.buckets, h)
    at[at == len(model.buckets)] = 0
    return np.where(model.buckets[at] == h, at + 1, 0) if len(model.buckets) else np.zeros(len(h), np.int64)


def features(model: Model, tables: list[np.ndarray], rows: np.ndarray, piece: int = 1 << 14) -> np.ndarray:
    """Maximum of each filter over the text; places before and after the text count as absent (zero)."""
    out = []
    for table, bias in zip(tables, model.biases):
        width = len(table)
        padded = np.concatenate([np.full(width - 1, -1), rows, np.full(width - 1, -1)])
        best = np.zeros(table.shape[2], np.float32)
        for at in range(0, max(1, len(padded) - width + 1), piece):
            part = padded[at : at + piece + width - 1]
            n = len(part) - width + 1
            if n <= 0:
                break
            total = np.zeros((n, table.shape[2]), np.float32)
            for k in range(width):
                r = part[k : k + n]
                total += np.where((r >= 0)[:, None], table[k][r], 0)
            best = np.maximum(best, (total + bias).max(0))
        out.append(best)  # starts from zero, so this is max pooling after a rectifier
    return np.concatenate(out)


def fit(texts: list[bytes], labels: np.ndarray, dims: int = 8, widths: tuple[int, ...] = (1, 2, 3), maps: int = 8, shared_by: int = 5, epochs: int = 8, seed: int = 5) -> Model:
    """Train on labelled texts by Adam; a bucket needs ``shared_by`` texts to get an embedding.

    Texts without a word teach nothing. Without a text of each label nothing is
    learned, and every score is 0.
    """
    rng = np.random.default_rng(seed)
    hashed = [hashes(t) for t in texts]
    taught = [k for k, h in enumerate(hashed) if len(h)]
    hashed, labels = [hashed[k] for k in taught], np.asarray(labels)[taught]
    seen: dict[int, int] = {}
    for h in hashed:
        for b in np.unique(h).tolist():
            seen[b] = seen.get(b, 0) + 1
    buckets = np.array(sorted(b for b, n in seen.items() if n >= shared_by), np.uint64)
    model = Model(
        rng.normal(0, 0.1, (len(buckets) + 1, dims)), buckets,
        [rng.normal(0, 0.3, (w, dims, maps)) for w in widths], [np.zeros(maps) for _ in widths],
        rng.normal(0, 0.3, maps * len(widths)), 0.0, 0 < labels.sum() < len(labels),
    )
    rows = [_rows(model, h) for h in hashed]
    positive = max(1.0, labels.sum())
    weight = np.where(labels > 0, len(labels) / (2 * positive), len(labels) / (2 * max(1.0, len(labels) - positive)))
    params = [model.embeddings, *model.filters, *model.biases, model.weights, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rate, batch = 0.02, 16
    for epoch in range(epochs if model.trained else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            chosen = order[at : at + batch]
            _gradient(model, params[-1][0], [rows[k] for k in chosen], labels[chosen], weight[chosen], grads)
            t += 1
            step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            for p, g, mi, vi in zip(params, grads, m, v):
                g = g / batch + 1e-4 * p
                mi *= 0.9
                mi += 0.1 * g
                vi *= 0.999
                vi += 0.001 * g * g
                p -= step * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
    model.bias = float(params[-1][0])
    return model


def _gradient(model: Model, bias: float, rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, grads: list[np.ndarray]) -> None:
    """Add to ``grads`` the gradient of the weighted log loss, summed over a batch of texts that have words."""
    sizes, n_w = np.array([len(r) for r in rows]), len(model.filters)
    pooled, where = [], []
    for f, b in zip(model.filters, model.biases):
        width, gap = len(f), np.full(len(f) - 1, -1)
        # All texts in one line, with marks around each; a text of n words has n + width - 1 places.
        line = np.concatenate([x for r in rows for x in (gap, r, gap)])
        places = sizes + width - 1
        first = np.cumsum(sizes + 2 * (width - 1)) - (sizes + 2 * (width - 1))
        begin = np.cumsum(places) - places
        starts = np.arange(places.sum()) + np.repeat(first - begin, places)
        total = np.zeros((len(starts), f.shape[2]))
        for k in range(width):
            r = line[starts + k]
            total += np.where((r >= 0)[:, None], model.embeddings[r] @ f[k], 0)
        total += b
        value = np.maximum.reduceat(total, begin)
        at = np.where(total == np.repeat(value, places, axis=0), starts[:, None], len(line))
        pooled.append(np.maximum(value, 0))
        where.append((line, np.minimum.reduceat(at, begin), value > 0))
    x = np.concatenate(pooled, axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ model.weights + bias, -30, 30)))
    d = weight * (p - labels)
    grads[-1] += d.sum()
    grads[-2] += d @ x
    at = 0
    for i, (f, (line, top, on)) in enumerate(zip(model.filters, where)):
        g = d[:, None] * model.weights[at : at + f.shape[2]] * on
        at += f.shape[2]
        grads[1 + n_w + i] += g.sum(0)
        for k in range(len(f)):
            r = line[top + k]
            inside = np.where(r >= 0, g, 0.0)
            e = model.embeddings[np.maximum(r, 0)]
            grads[1 + i][k] += np.einsum("tmd,tm->dm", e, inside)
            np.add.at(grads[0], np.maximum(r, 0), inside[:, :, None] * f[k].T[None])


def labelled(docs: DataFrame, labels: DataFrame, target: str, keep_row, limit: int, longest: int = 200_000) -> DataFrame:
    """(doc_id, text, y): a bounded training sample, at most ``limit`` rows of each class, by hash order.

    The bound on rows keeps training on one machine; it is a parameter. Of a text
    of more than ``longest`` characters, pieces from all over it teach as much as
    one of that length. Rows with a null id, text or label teach nothing. A document with several labels counts once, by the largest.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & keep_row).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.where(F.col("text").isNotNull()).select("doc_id", spread(F.col("text"), longest).alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learn_from, limit: int = 3000, **how) -> Model:
    """A model learned from the rows of ``labels`` where ``learn_from`` holds."""
    rows = sorted(labelled(docs, labels, "toxic", learn_from, limit).select("doc_id", F.col("text").cast("binary").alias("text"), "y").toLocalIterator(), key=lambda r: r.doc_id)
    return fit([bytes(r.text) for r in rows], np.array([float(r.y) for r in rows]), **how)


def score_one(model: Model, tables, text: bytes | None) -> float:
    if not model.trained:
        return 0.0
    x = features(model, tables, _rows(model, hashes(text))) @ model.weights + model.bias
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` that are needed later (doc_id, lang) and ``score`` for each whole text.

    A null or empty text is scored like a text without words. Lang never enters a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        tables = m.tables()
        for batch in batches:
            scores = [score_one(m, tables, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang string, score double")


def thresholds(scored: DataFrame, labels: DataFrame, learn_from, least: int = 20) -> dict[str | None, float]:
    """Per language the score that splits the labelled rows best (balanced accuracy).

    From a histogram of 1000 score steps by language and label, so what reaches
    the driver is bounded by the number of languages. Languages with fewer than
    ``least`` rows of either label, and any language not seen, use 0.5.
    """
    known = labels.where(F.col("toxic").isNotNull() & learn_from).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts: dict = {}
    steps = scored.join(known, "doc_id").groupBy("lang", "y", F.floor(F.col("score") * 1000).cast("int").alias("step")).count().collect()
    for r in steps:
        counts.setdefault(r.lang, np.zeros((2, 1001)))[int(r.y > 0), r.step] += r["count"]
    out = {}
    for lang, c in counts.items():
        n = c.sum(1)
        if n.min() >= least:
            below = np.concatenate([np.zeros((2, 1)), np.cumsum(c, 1)], 1)
            good = below[0] / n[0] + 1 - below[1] / n[1]
            best = np.flatnonzero(good == good.max())
            out[lang] = float(best[len(best) // 2] / 1000)
    return out


def classify(docs: DataFrame, labels: DataFrame, learn_from, limit: int = 3000, part: int = 5) -> DataFrame:
    """doc_id, lang, score, threshold, toxic: the score against its language's threshold.

    One labelled row in ``part`` by hash, of those where ``learn_from`` holds,
    never trains the network; these rows calibrate the thresholds. Texts are scored once.
    """
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0
    scored = keep(score(docs, train(docs, labels, learn_from & ~aside, limit)))
    cut = thresholds(scored, labels, learn_from & aside)
    pairs = [x for k, t in cut.items() if k is not None for x in (F.lit(k), F.lit(t))]
    own = F.coalesce(F.create_map(*pairs)[F.col("lang")], F.lit(0.5)) if pairs else F.lit(0.5)
    return scored.withColumn("threshold", own).withColumn("toxic", F.col("score") >= F.col("threshold"))
