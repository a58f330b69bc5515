"""Quality filter: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

There are two forms, with the same result. A small model (``most`` n-grams at
most, three for each training word) is counted by grouping in Spark and sent to
all workers as open-addressed tables. A larger one is never in one place: n-grams of all texts are dealt
to shards that count and score them (:mod:`.dealt`).

A document is kept if its log perplexity is at most the quantile that trusted
documents of its language reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dealt
from .common import free, keep

#: Share of trusted documents, by language, that the threshold keeps.
QUANTILE = 0.998

START, END = 0, 1  # word ids of the text's edges; hashes of words avoid them


def word_ids(text: bytes | None) -> np.ndarray:
    """64-bit ids of the words of a whole text, unchanged, between two starts and one end."""
    words = (text or b"").split()
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ids[ids < 2] += np.uint64(2)
    return np.concatenate([np.array([START, START], np.uint64), ids, np.array([END], np.uint64)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def key(*ids: np.ndarray) -> np.ndarray:
    """One 64-bit key for each n-gram."""
    k = _mix(ids[0] + np.uint64(0x9E3779B97F4A7C15))
    for x in ids[1:]:
        k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + x)
    return np.maximum(k, np.uint64(1))  # 0 marks an empty slot


_EMPTY = np.uint64(0)


@dataclass
class Table:
    """Keys to float values by open addressing; a missing key gives ``missing``.

    Keys stand in the slots themselves, at a load of a half at most, so most
    lookups, found or not, read one or two slots. The slots are made where the
    first lookup is, so the driver never holds them; a table that has been
    looked up in cannot be sent on.
    """

    keys: np.ndarray
    values: np.ndarray
    missing: float

    def __post_init__(self):
        self.slots = None

    def _fill(self):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 2))))
        owner = np.full(1 << self.bits, -1, np.int32)
        waiting, at = np.arange(len(self.keys), dtype=np.int32), self._home(self.keys)
        while len(waiting):
            owner[at] = np.where(owner[at] < 0, waiting, owner[at])  # of several, one stays
            left = owner[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) & (len(owner) - 1)
        self.slots, self.found = np.full(len(owner), _EMPTY), np.full(len(owner), self.missing, np.float32)
        used = owner >= 0
        self.slots[used], self.found[used] = self.keys[owner[used]], self.values[owner[used]]
        self.keys = self.values = None  # the slots hold both

    def _home(self, keys):
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getstate__(self):
        return self.keys, self.values, self.missing

    def __setstate__(self, state):
        self.keys, self.values, self.missing = state
        self.__post_init__()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether each key is in the table."""
        if self.slots is None:
            self._fill()
        at = self._home(keys)
        here = self.slots[at]
        known = here == keys
        out = np.where(known, self.found[at], self.missing).astype(np.float64)
        left = np.flatnonzero(~known & (here != _EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            here = self.slots[at]
            hit = here == keys[left]
            out[left[hit]], known[left[hit]] = self.found[at[hit]], True
            on = ~hit & (here != _EMPTY)
            left, at = left[on], at[on]
        return out, known


@dataclass
class Model:
    """Discounted shares of trigrams, bigrams and words, and what each context leaves to the next order."""

    three: Table
    rest3: Table
    two: Table
    rest2: Table
    one: Table
    unknown: float

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each word after the two starts."""
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        p, word = self.one.find(key(c))
        # A bigram is known only if both words are, and a trigram only if its last two are one:
        # what cannot be there is not looked up.
        seen = np.concatenate([[True], word[:-1]])  # b is a start or a known word
        rest = np.ones(len(c))
        rest[seen], _ = self.rest2.find(key(b[seen]))
        p = rest * p
        both = np.flatnonzero(seen & word)
        share, known = self.two.find(key(b[both], c[both]))
        p[both] += share
        pair = np.zeros(len(c) + 1, bool)  # whether the two words before a place are a known bigram
        pair[0] = True
        pair[both[known] + 1] = True
        before = pair[:-1]
        context = np.flatnonzero(before)
        rest, _ = self.rest3.find(key(a[context], b[context]))
        p[context] *= rest
        three = both[known][before[both[known]]]
        share, _ = self.three.find(key(a[three], b[three], c[three]))
        p[three] += share
        return np.log(p)


def _trigrams(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            parts = [word_ids(t.as_buffer().to_pybytes()).view(np.int64) for t in batch.column(0)]
            columns = [np.concatenate([np.zeros(0, np.int64), *(p[k : len(p) - 2 + k] for p in parts)]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "c"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "a long, b long, c long")


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams counted once to four times."""
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * (after / before) if before else k * y for k, (before, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1))


def _in_context(counts: DataFrame, context: list[str]) -> DataFrame:
    """``counts`` with its context's sum of n (total) and number of n-grams counted once, twice and more often, after one exchange.

    One row of each context, that of its least c, is marked ``first``.
    """
    w = Window.partitionBy(*context)
    sums = [F.sum("n").over(w).alias("total"), *(F.sum((F.least("n", F.lit(3)) == k).cast("int")).over(w).alias(f"k{k}") for k in (1, 2, 3))]
    return counts.select("*", *sums, (F.col("c") == F.min("c").over(w)).alias("first"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    return discounts({r.n: r.k for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()})


def _cut(n, d: tuple[float, float, float]):
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _shares(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """Discounted shares of n-grams (a table of :func:`_in_context`) and the rest of each context."""
    d = _discounts(counts)
    shares = counts.withColumn("share", (F.col("n") - _cut(F.col("n"), d)) / F.col("total"))
    rests = counts.where("first").select(*context, ((F.col("k1") * d[0] + F.col("k2") * d[1] + F.col("k3") * d[2]) / F.col("total")).alias("share"))
    return shares, rests


def _table(df: DataFrame, columns: list[str], missing: float) -> Table:
    """The workers make the keys, so the driver gets 12 bytes a row."""

    def run(batches):
        for batch in batches:
            ids = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(key(*ids).view(np.int64)), pa.array(batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(np.float32))], names=["key", "share"])

    rows = df.select(*columns, "share").mapInArrow(run, "key long, share float").toArrow()
    found = Table(rows.column("key").to_numpy().view(np.uint64).copy(), rows.column("share").to_numpy().copy(), missing)
    del rows
    pa.default_memory_pool().release_unused()
    return found


@dataclass
class Shards:
    """What the model learns from, how many words and ends that is, and how often the common words stand in it."""

    trusted: DataFrame
    tokens: int
    frequent: DataFrame


def shards(trusted: DataFrame) -> Shards:
    """The texts of ``trusted`` to learn from (null texts are left out)."""
    texts = trusted.where(F.col("text").isNotNull())
    frequent = keep(dealt.frequency(texts))
    every = frequent.where("id is null").first()
    return Shards(texts, every.n if every else 0, frequent)


def gather(t: Shards) -> Model:
    """The model as tables of one process; ``t.tokens`` bounds the rows of each."""
    # Each table is written once, with its contexts' sums, and none is exchanged again for a join.
    three = keep(_in_context(_trigrams(t.trusted).groupBy("a", "b", "c").agg(F.count("*").alias("n")), ["a", "b"]))
    two = keep(_in_context(three.groupBy("b", "c").agg(F.count("*").alias("n")), ["b"]))
    one = keep(two.groupBy("c").agg(F.count("*").alias("n")))
    s3, r3 = _shares(three, ["a", "b"])
    s2, r2 = _shares(two, ["b"])
    facts = one.agg(F.sum("n").alias("total"), F.count("*").alias("words")).first()
    d = _discounts(one)
    cut = _cut(F.col("n"), d)
    total = facts.total or 0
    # What single words leave is spread over all words and the unknown one.
    unknown = one.agg(F.sum(cut).alias("cut")).first().cut / total / (facts.words + 1) if total else 0.5
    s1 = one.withColumn("share", (F.col("n") - cut) / F.lit(max(1, total)) + F.lit(unknown))
    s3, s2, s1 = s3.select("a", "b", "c", "share"), s2.select("b", "c", "share"), s1.select("c", "share")
    return Model(_table(s3, ["a", "b", "c"], 0.0), _table(r3, ["a", "b"], 1.0), _table(s2, ["b", "c"], 0.0), _table(r2, ["b"], 1.0), _table(s1, ["c"], unknown), unknown)


def fit(trusted: DataFrame) -> Model:
    """A model of the texts of ``trusted`` (a bounded table)."""
    return gather(shards(trusted))


def score_dealt(docs: DataFrame, learned: DataFrame, t: Shards) -> DataFrame:
    """As :func:`score`, the model spread over shards to which the n-grams of all documents are dealt (see :mod:`.dealt`)."""
    mark, key, n, log = (free(x, docs.columns) for x in ("trains", "key", "n", "log"))
    text = F.col("text").cast("binary")
    flagged = docs.select("doc_id", "text").join(F.broadcast(learned.select("doc_id", F.lit(True).alias(mark))), "doc_id", "left")
    flagged = flagged.where("text is not null").select("text", F.unhex(F.md5(text)).alias("key"), F.coalesce(mark, F.lit(False)).alias("trains"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    found = dealt.log_sums(flagged, t.trusted, dealt.plan(t.tokens, size, t.frequent)).where("n > 0")
    found = found.select(F.col("key").alias(key), F.col("n").alias(n), F.col("log").alias(log))
    out = docs.withColumn(key, F.unhex(F.md5(text))).join(found, key, "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(n, F.lit(0).cast("long")).alias("_tokens"), (-F.col(log) / (F.col(n) + 1)).alias("_log_ppl"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``_tokens`` (long), ``_log_ppl`` (double, null without any word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    place = docs.columns.index("text")
    names = [*schema.names, "_tokens", "_log_ppl"]

    def run(batches):
        m = shared.value
        for batch in batches:
            n, ppl = [], []
            for t in batch.column(place):
                ids = word_ids(t.as_buffer().to_pybytes() if t.is_valid else None)
                n.append(len(ids) - 3)
                ppl.append(-float(m.log_probabilities(ids).mean()) if len(ids) > 3 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ppl, pa.float64())], names=names)

    from pyspark.sql.types import DoubleType, LongType, StructType

    out = StructType(list(schema.fields)).add("_tokens", LongType()).add("_log_ppl", DoubleType())
    return docs.mapInArrow(run, out)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled quality 1 and never 0."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def thresholds(scored: DataFrame, quantile: float, step: float = 0.002) -> dict[str, float]:
    """Per language (None: all together) the log perplexity that ``quantile`` of trusted rows do not pass.

    From counts by language and step of log perplexity, so what reaches the
    driver is bounded by the number of languages, not of documents.
    """
    counts: dict = {}
    for r in scored.where("_log_ppl is not null").groupBy("lang", F.floor(F.col("_log_ppl") / step).alias("at")).count().collect():
        for lang in {r.lang, None}:
            counts.setdefault(lang, {})[r.at] = counts.setdefault(lang, {}).get(r.at, 0) + r["count"]
    out = {}
    for lang, c in counts.items():
        places = sorted(c)
        upto = np.cumsum([c[p] for p in places])
        out[lang] = float((places[int(np.searchsorted(upto, quantile * upto[-1]))] + 1) * step)
    return out


def assess(docs: DataFrame, labels: DataFrame, limit: int | None = 4000, quantile: float = QUANTILE, least: int = 30, part: int = 5, with_text: bool = True, most: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` with n_tokens, log_perplexity, threshold and keep.

    All documents are scored once, and the scores written; without ``with_text``
    the text is left out of that.

    One trusted document in ``part`` by hash never trains the model; the rest
    do, at most ``limit`` of them in hash order (the bound is this parameter;
    None: all of them, as the registered query and the pipeline say).
    Thresholds come from all trusted documents that did not train it.
    A language with fewer than ``least`` of those, and a null language, uses the
    threshold of all together; without any the filter keeps everything. Texts
    without a word (null, empty) are rejected. An input column named like a
    result (also ``_tokens`` and ``_log_ppl``) is replaced. ``most`` is the
    largest model, in n-grams, that is sent to the workers.
    """
    clean = docs.drop("n_tokens", "log_perplexity", "threshold", "keep", "_tokens", "_log_ppl")
    ids = trusted_ids(labels)
    learned = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) != 0)
    learned = keep(learned if limit is None else learned.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    tables = shards(clean.select("doc_id", "text").join(F.broadcast(learned), "doc_id"))
    scored = score(clean, gather(tables)) if 3 * tables.tokens <= most else score_dealt(clean, learned, tables)
    scored = keep(scored if with_text else scored.drop("text"))
    sizes = scored.select("doc_id", "lang", "_log_ppl").join(ids.join(learned, "doc_id", "left_anti"), "doc_id")
    sizes = keep(sizes)
    cut = thresholds(sizes, quantile)
    enough = {r.lang for r in sizes.groupBy("lang").count().where(F.col("count") >= least).collect()}
    pairs = [x for k, t in cut.items() if k is not None and k in enough for x in (F.lit(k), F.lit(t))]
    everywhere = F.lit(cut.get(None, float("inf")))
    own = F.coalesce(F.create_map(*pairs)[F.col("lang")], everywhere) if pairs else everywhere
    return scored.withColumnRenamed("_tokens", "n_tokens").withColumnRenamed("_log_ppl", "log_perplexity").withColumn("threshold", own).withColumn(
        "keep", (F.col("n_tokens") > 0) & (F.col("log_perplexity") <= F.col("threshold")))
