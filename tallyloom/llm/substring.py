"""Exact removal of repeated word passages by relative Lempel-Ziv factors.

The reference is every text, cut into blocks at content-defined places. Of every
passage of ``window`` words the word group of ``gram`` words with the least hash
is its anchor; equal passages have equal anchors, so a passage whose anchor
stands in one text only is unique, and the neighbouring passages that share an
anchor are one block: about seventeen passages a row. Every block is indexed by
the hash of its words with the first place (doc_id and word) it stands at; blocks
are dealt to shards by that hash.

A document is factored against all blocks. A block that also stands in an
earlier document is a piece of a factor as a whole. The blocks at the edges of
a repeat, which hold words from outside it, are like no other, so the passages
of the first copy of each different block are indexed and looked up one by one.
Every piece knows its source's place; a factor starts at the first repeated
passage and is extended for as long as its source goes on in step with the
document. Where it breaks, the passages across the boundary have been looked up
like any others, so the next factor may overlap it, and no repeat that straddles
two factors is missed. Factors are at least ``window`` words long, and their
words are the duplicate spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

WINDOW = 50
GRAM = 16
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int):
        if n > len(self.up):
            m = 1 << n.bit_length()
            steps = np.full((2, m), [[self.base], [pow(self.base, -1, 1 << 64)]], np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1)
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolling(hashes: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hash of each run of ``size`` words: a polynomial modulo 2^64 of the word hashes, mixed."""
    up, down = _POWERS[which].upto(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _mix((sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each passage of ``window`` words."""
    return _sliding_min(_rolling(hashes, gram, 0), window - gram + 1)


def _bytes(column):
    """Texts of a binary column one at a time, so a batch is not held twice."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def _summaries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, n_words, sha, anchors) per row; sha is of the words joined by one space."""

    def run(batches):
        for batch in batches:
            n, sha, found = [], [], []
            for text in _bytes(batch.column(1)):
                words = (text or b"").split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                found.append(np.unique(anchors(_word_hashes(words), window, gram)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), lists], names=["doc_id", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, n_words long, sha binary, anchors array<long>")


def _pack(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    """Tuples of arrays, one for each column, as one batch."""
    columns = [np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kind.to_pandas_dtype())) for c, kind in zip(columns, kinds)], names=names)


def _blocks(shared: DataFrame, window: int, gram: int) -> DataFrame:
    """(f1, f2, n, doc_id, tag, at) of each block of ``n`` passages from word ``at`` whose anchor is in ``shared`` (doc_id, sha, text, anchors).

    ``tag`` tells texts with the same doc_id apart.
    """
    names = ["f1", "f2", "n", "doc_id", "tag", "at"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out, size = [], 0
            for i, (sha, text, known) in enumerate(zip(batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3))):
                words = text.split()
                if hashlib.sha256(b" ".join(words)).digest() != sha:
                    continue  # another row's text under the same doc_id
                hashes = _word_hashes(words)
                own = anchors(hashes, window, gram)
                at, n = _spans(own, window - gram + 1)
                keep_ = np.isin(own[at], np.asarray(known.values).astype(np.int64).view(np.uint64))
                at, n = at[keep_], n[keep_]
                f1, f2 = (_spanned(hashes, at, n + window - 1, k).view(np.int64) for k in (0, 1))
                out.append((f1, f2, n, np.full(len(at), ids[i]), np.full(len(at), _tag(sha), np.int32), at))
                size += len(at)
                if size > 200_000:
                    yield _pack(out, names, kinds)
                    out, size = [], 0
            yield _pack(out, names, kinds)

    return shared.select("doc_id", "sha", "text", "anchors").mapInArrow(run, "f1 long, f2 long, n int, doc_id long, tag int, at int")


def _spans(own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of neighbours with one anchor; runs of over ``most`` (a repeated group of words) are cut."""
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    length = np.diff(np.append(edges, len(own)))
    parts = -(-length // most)
    at = np.repeat(edges, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return at, np.minimum(most, np.repeat(edges + length, parts) - at)


def _spanned(hashes: np.ndarray, at: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Hash of the ``size[k]`` words from ``at[k]``."""
    up, down = _POWERS[which].upto(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _mix((sums[at + size] - sums[at]) * down[at] + size.astype(np.uint64))


def _passages(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, tag, at) of each passage of the blocks in ``texts`` (doc_id, sha, text, spans array<struct<at, n>>)."""
    names = ["h1", "h2", "doc_id", "tag", "at"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out, size = [], 0
            for i, (sha, text, spans) in enumerate(zip(batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3))):
                words = text.split()
                if hashlib.sha256(b" ".join(words)).digest() != sha:
                    continue
                hashes = _word_hashes(words)
                at, n = (np.asarray(spans.values.field(k)).astype(np.int64) for k in (0, 1))
                where = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                h1, h2 = (_spanned(hashes, where, np.full(len(where), window), k).view(np.int64) for k in (0, 1))
                out.append((h1, h2, np.full(len(where), ids[i]), np.full(len(where), _tag(sha), np.int32), where))
                size += len(where)
                if size > 200_000:
                    yield _pack(out, names, kinds)
                    out, size = [], 0
            yield _pack(out, names, kinds)

    return texts.select("doc_id", "sha", "text", "spans").mapInArrow(run, "h1 long, h2 long, doc_id long, tag int, at int")


def _tag(sha: bytes) -> int:
    return int.from_bytes(sha[:4], "little", signed=True)


def _tag_of(column: str):
    """The same number as :func:`_tag`, in Spark."""
    byte = lambda k: F.conv(F.hex(F.substring(column, k, 1)), 16, 10).cast("long")
    low = byte(1) + byte(2) * 256 + byte(3) * 65536 + byte(4) * 16777216
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int")


def parse(at: np.ndarray, n: np.ndarray, source: np.ndarray, source_at: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, source, source_start) of one document.

    From its repeated pieces (``n`` passages from word ``at``, and where they
    stand first), sorted by place: a factor is extended piece by piece while the
    next one follows at once in the document and in the same source.
    """
    if not len(at):
        return []
    follows = (at[1:] == at[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (source_at[1:] == source_at[:-1] + n[:-1])
    first = np.concatenate([[0], np.flatnonzero(~follows) + 1])
    last = np.append(first[1:], len(at)) - 1
    return [(int(at[a]), int(at[b] + n[b] - at[a]) + window - 1, int(source[a]), int(source_at[a])) for a, b in zip(first, last)]


_PARSED = "doc_id long, sha binary, n_removed long, kept_sha256 string, kept string, factors array<struct<start:int,length:int,source:long,source_start:int>>"


def _parsed(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """texts: doc_id, sha, text, hits array<struct<at, n, source, source_at>>."""

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3)):
                words = row[2].split()
                if hashlib.sha256(b" ".join(words)).digest() != row[1]:
                    continue
                hits = [np.asarray(row[3].values.field(k)).astype(np.int64) for k in range(4)]
                _, order = np.unique(hits[0], return_index=True)  # sorted, and equal rows' hits once
                factors = parse(*(x[order] for x in hits), window)
                depth = np.zeros(len(words) + 1, np.int64)
                for start, length, _, _ in factors:
                    depth[start] += 1
                    depth[start + length] -= 1
                stays = np.cumsum(depth)[:-1] == 0
                kept = b" ".join(w for w, s in zip(words, stays.tolist()) if s)
                if len(out) == 500:
                    yield pack(out)
                    out = []
                out.append((row[0], row[1], len(words) - int(stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if with_text else None, [dict(start=s, length=n, source=d, source_start=e) for s, n, d, e in factors]))
            yield pack(out)

    def pack(out):
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "sha", "n_removed", "kept_sha256", "kept", "factors"])

    return texts.mapInArrow(run, _PARSED)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept, copy_of, factors: one row per row of ``docs``.

    A word goes if it lies in a passage of ``window`` consecutive words of its
    document whose words also start in a document with a smaller doc_id;
    passages are judged on the input. ``factors`` (start, length, source,
    source_start) are the spans found and where the same words stand; for a document that repeats another whole one, ``copy_of``
    names it instead. ``kept`` is the remaining text if ``with_text``, for
    documents from which something went. Null texts have no words. A row with
    a null doc_id has no smaller document and is none, so it stays whole; rows
    with equal doc_id do not take words from each other. Other columns are
    ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    per_doc = keep(_summaries(d, window, gram))
    # Whole copies are settled by their hash; only the first of each text is indexed.
    # Grouped sides are written before they are joined: both sides of each join are then
    # exchanged for it, so Spark can split a hot key (a common text, anchor or passage).
    first = keep(per_doc.where(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first")))
    ranked = keep(per_doc.join(first, "sha", "left").withColumn("copy_of", F.when((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window), F.col("first"))).drop("first"))
    indexed = ranked.where(F.col("doc_id").isNotNull() & F.col("copy_of").isNull() & (F.size("anchors") > 0)).select("doc_id", "sha", F.explode("anchors").alias("anchor"))
    shared = keep(indexed.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    per_text = indexed.join(shared, "anchor").groupBy("doc_id", "sha").agg(F.collect_set("anchor").alias("anchors"))
    texts = keep(d.where(F.col("text").isNotNull()).join(per_text, "doc_id").select("doc_id", "sha", "text", "anchors"))
    tagged = texts.withColumn("tag", _tag_of("sha"))
    place = F.struct("doc_id", "at")
    # Blocks that also stand in an earlier document are pieces as they are; of every other block the passages are looked up.
    blocks = keep(_blocks(texts, window, gram))
    known = keep(blocks.groupBy("f1", "f2", "n").agg(F.min(place).alias("source"), F.max("doc_id").alias("high")).where("source.doc_id < high").drop("high"))
    found = keep(blocks.join(known, ["f1", "f2", "n"], "left"))
    again = F.col("source.doc_id") < F.col("doc_id")
    whole = found.where(again).select("doc_id", "tag", "at", "n", "source")
    spans = keep(found.where(F.col("source").isNull() | ~again).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans")))
    passages = keep(_passages(tagged.join(spans, ["doc_id", "tag"]), window))
    first_of = keep(passages.groupBy("h1", "h2").agg(F.min(place).alias("source"), F.max("doc_id").alias("high")).where("source.doc_id < high").drop("high"))
    single = passages.join(first_of, ["h1", "h2"]).where(again).select("doc_id", "tag", "at", F.lit(1).alias("n"), "source")
    hits = whole.unionByName(single).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n", F.col("source.doc_id").alias("source"), F.col("source.at").alias("source_at"))).alias("hits"))
    parsed = _parsed(tagged.join(hits, ["doc_id", "tag"]).select("doc_id", "sha", "text", "hits"), window, with_text).dropDuplicates(["doc_id", "sha"])
    out = ranked.drop("anchors").join(parsed, ["doc_id", "sha"], "left")
    copied = F.col("copy_of").isNotNull()
    return out.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copied, F.lit("")).otherwise(F.col("kept")).alias("kept"), "copy_of", "factors",
    )
