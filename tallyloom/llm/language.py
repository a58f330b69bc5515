"""Language identification by a bidirectional gated recurrent network over bytes, in NumPy.

A text's bytes are cut into segments of a fixed length. Over each segment one
network runs forwards and one backwards; both states at a byte give that byte's
language distribution, and the mean over all bytes of the text is the text's.
Every byte of every text is read once in each direction.

Segments of many texts run side by side, so each step is a few array operations
on a whole block; a text of any length costs memory for one block only. Gates
use clipped lines and states x / (1 + |x|) in place of the exponentials, which
train as well here and cost a third.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

SEGMENT = 64
PAD = 256  # a byte value of its own after the end of a text
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Weights of both directions (index 0 forwards, 1 backwards).

    inputs: 2 x 257 x 3h, the gates' input for each byte (update, reset, state);
    state: 2 x h x 3h; output: 2 x h x languages.
    """

    languages: list[str]
    inputs: np.ndarray
    state: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.state.shape[1]


def _gate(x):
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


def segments(texts: list[bytes], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as rows of ``length``, padded, and the text of each row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // length)
    out = np.full(int(rows.sum()) * length, PAD, np.int16)
    starts = np.concatenate([[0], np.cumsum(rows)[:-1]]) * length
    joined = np.frombuffer(b"".join(texts), np.uint8)
    out[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(joined))] = joined
    return out.reshape(-1, length), np.repeat(np.arange(len(texts)), rows)


def _step(inputs, gates, new, s, column, x, g, out):
    """One byte of every row; arrays are features x rows, so each operation runs along the rows."""
    h = len(s)
    np.take(inputs, column, axis=1, out=x, mode="clip")
    np.matmul(gates, s, out=g)
    g += x[: 2 * h]
    np.clip(g, 0.0, 1.0, out=g)
    g[h:] *= s
    c = new @ g[h:]
    c += x[2 * h :]
    scale = np.abs(c)
    scale += 1.0
    c /= scale
    c -= s
    c *= g[:h]
    return np.add(s, c, out=out)


def position_sums(model: Model, texts: list[bytes], block_rows: int = 4096) -> np.ndarray:
    """Sum over a text's bytes of each byte's language distribution: texts x languages."""
    h, langs, kind = model.hidden, len(model.languages), np.float32
    total = np.zeros((len(texts), langs))
    # The gates' 0.25 x + 0.5 goes into their weights.
    inputs = model.inputs.transpose(0, 2, 1).copy()
    inputs[:, : 2 * h] = inputs[:, : 2 * h] * 0.25 + 0.5
    inputs = np.ascontiguousarray(inputs, kind)
    gates = np.ascontiguousarray(0.25 * model.state[:, :, : 2 * h].transpose(0, 2, 1), kind)
    new = np.ascontiguousarray(model.state[:, :, 2 * h :].transpose(0, 2, 1), kind)
    output = np.ascontiguousarray(model.output.transpose(0, 2, 1), kind)
    bias = model.bias.astype(kind)[:, None]
    blocks, owner = segments(texts)
    length = blocks.shape[1]
    for at in range(0, len(blocks), block_rows):
        columns = np.ascontiguousarray(blocks[at : at + block_rows].T).astype(np.intp)
        n = columns.shape[1]
        x, g = np.empty((3 * h, n), kind), np.empty((2 * h, n), kind)
        ahead = np.zeros((length + 1, h, n), kind)  # ahead[t + 1]: forward state after byte t
        for t in range(length):
            _step(inputs[0], gates[0], new[0], ahead[t], columns[t], x, g, ahead[t + 1])
        s, summed = np.zeros((h, n), kind), np.zeros((langs, n), kind)
        for t in range(length - 1, -1, -1):
            s = _step(inputs[1], gates[1], new[1], s, columns[t], x, g, np.empty_like(s))
            logits = output[0] @ ahead[t + 1]
            logits += output[1] @ s
            logits += bias
            logits -= logits.max(0)
            np.exp(logits, out=logits)
            logits *= (columns[t] != PAD) / logits.sum(0)
            summed += logits
        for k in range(langs):
            total[:, k] += np.bincount(owner[at : at + block_rows], summed[k].astype(np.float64), len(texts))
    return total


def loss_and_gradient(model: Model, block: np.ndarray, labels: np.ndarray):
    """Mean cross entropy over all bytes, and its gradient through time, for rows of one label each."""
    h, length = model.hidden, block.shape[1]
    mask = block != PAD
    count = max(1, mask.sum())
    states = []
    for d in (0, 1):
        s = np.zeros((len(block), h))
        steps = {}
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            x = model.inputs[d][block[:, t]]
            a = x[:, : 2 * h] + s @ model.state[d][:, : 2 * h]
            g = _gate(a)
            c = x[:, 2 * h :] + (s * g[:, h:]) @ model.state[d][:, 2 * h :]
            n = c / (1 + np.abs(c))
            after = s + g[:, :h] * (n - s)
            steps[t] = (s, a, g, c, n, after)
            s = after
        states.append(steps)
    both = [np.stack([states[d][t][5] for t in range(length)], 1) for d in (0, 1)]
    logits = both[0] @ model.output[0] + both[1] @ model.output[1] + model.bias
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    picked = np.take_along_axis(p, np.broadcast_to(labels[:, None, None], (*block.shape, 1)), 2)[:, :, 0]
    loss = -(np.log(picked + 1e-30) * mask).sum() / count
    d_logits = p.copy()
    np.put_along_axis(d_logits, np.broadcast_to(labels[:, None, None], (*block.shape, 1)), picked[:, :, None] - 1, 2)
    d_logits *= mask[:, :, None] / count
    grads = Model(model.languages, np.zeros_like(model.inputs), np.zeros_like(model.state), np.zeros_like(model.output), d_logits.sum((0, 1)))
    for d in (0, 1):
        grads.output[d] = np.einsum("nth,ntl->hl", both[d], d_logits)
        d_states = d_logits @ model.output[d].T
        back = np.zeros((len(block), h))
        w = model.state[d]
        for t in range(length - 1, -1, -1) if d == 0 else range(length):
            s, a, g, c, n, _ = states[d][t]
            back = back + d_states[:, t]
            z, r = g[:, :h], g[:, h:]
            d_c = back * z / (1 + np.abs(c)) ** 2
            d_sr = d_c @ w[:, 2 * h :].T
            d_g = np.concatenate([back * (n - s), d_sr * s], 1)
            d_a = d_g * 0.25 * (np.abs(a) < 2)
            grads.state[d][:, 2 * h :] += (s * r).T @ d_c
            grads.state[d][:, : 2 * h] += s.T @ d_a
            np.add.at(grads.inputs[d], block[:, t], np.concatenate([d_a, d_c], 1))
            back = back * (1 - z) + d_sr * r + d_a @ w[:, : 2 * h].T
    return loss, grads


def fit(texts: list[bytes], languages: list[str], hidden: int = 8, steps: int = 400, rows: int = 96, seed: int = 11) -> Model:
    """Train by backpropagation through time and Adam on segments of labelled texts, languages drawn evenly."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    model = Model(names, rng.normal(0, 0.4, (2, 257, 3 * hidden)), rng.normal(0, 0.4, (2, hidden, 3 * hidden)), rng.normal(0, 0.4, (2, hidden, max(1, len(names)))), np.zeros(max(1, len(names))))
    texts = [t or b" " for t in texts]
    if len(names) < 2:
        return model
    blocks, owner = segments(texts)
    label = np.array([names.index(x) for x in languages])[owner]
    pools = [np.flatnonzero(label == k) for k in range(len(names))]
    params = [model.inputs, model.state, model.output, model.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, -(-rows // len(pools))) for p in pools])
        _, g = loss_and_gradient(model, blocks[pick].astype(np.int64), label[pick])
        rate = 0.03 * 0.5 * (1 + np.cos(np.pi * t / steps)) + 1e-4
        for p, d, mi, vi in zip(params, [g.inputs, g.state, g.output, g.bias], m, v):
            mi += 0.1 * (d - mi)
            vi += 0.001 * (d * d - vi)
            p -= rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, learn_from, limit: int = 250, longest: int = 200_000, **how) -> Model:
    """A model learned from rows with text and lang where ``learn_from`` holds.

    At most ``limit`` texts of each language, in hash order, are used: a bounded
    training sample; the bound on rows is a parameter. Of a text of more than
    ``longest`` characters, pieces from all over it teach as much as one of that length. Only ids are ranked for it, and each
    task keeps no more than the limit of a language; the chosen texts alone are
    fetched. Languages are the distinct non-null values of all such rows with an id.
    """
    known = docs.where(learn_from & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    texts = known.select("doc_id", "lang", spread(F.col("text"), longest).cast("binary").alias("text")).join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])
    rows = sorted((r.lang, r.doc_id, bytes(r.text)) for r in texts.collect())
    return fit([t for _, _, t in rows], [name for name, _, _ in rows], **how)


def predict(docs: DataFrame, model: Model, columns: list[str] = ("doc_id",), block: int = 1 << 21) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred and score, the pooled probability, for each whole text.

    Texts that are null or have no letter are ``und`` with score 0; so are all
    texts if nothing could be learned. No other column enters a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns).schema
    names_out = [*kept.names, "lang_pred", "score"]

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = [None] * len(texts), [0.0] * len(texts)
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or b"") <= block):
                    size += len(texts[end] or b"")
                    end += 1
                part = [t if t and _LETTER.search(t.decode("utf-8", "replace")) else b"" for t in texts[start:end]]
                sums = position_sums(model, part) if model.languages else np.zeros((len(part), 1))
                for k, (t, row) in enumerate(zip(part, sums)):
                    if t and model.languages:
                        best = int(row.argmax())
                        names[start + k], scores[start + k] = model.languages[best], float(min(1.0, row[best] / len(t)))
                    else:
                        names[start + k] = "und"
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=names_out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return docs.select(*columns, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{schema}, lang_pred string, score double")
