"""Modified Kneser-Ney trigrams of any size: n-grams are dealt to shards by their middle word, in packed blocks.

A task cuts its texts into blocks, one for each shard, and a shard meets the
blocks of all tasks: it counts the trigrams of training texts, and scores those
of all texts with the counts. A word that would fill a shard by itself is dealt
to several, by the word before it. The log probability of c after a, b is
log s1(c) + log(s3 / s1(c) + r3 * (s2 / s1(c) + r2)), so a shard needs s1 of
words that it has counted only; the first term is summed apart. All is done in
``GROUPS`` turns over the shards, so that only a part of the blocks is on disk.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep

GROUPS = 4
LETTERS = 12_000_000  # bytes of text that a task cuts at once
TRAINING, BYTES = 1_000_000, 32_000_000  # training words and bytes of text for each shard
COMMON = 100_000  # words whose shares all tasks know

SCHEMA = "to int, origin long, kind int, payload binary"
_ARROW = pa.schema([("to", pa.int32()), ("origin", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
BLOCK, TAIL, KEYS, SUMS, SHARES, HOT, WORDS, STATS, TOP = range(9)
_K = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Whole numbers get the least width, and bytes of one place stand together."""
    narrow = [a.astype(np.min_scalar_type(int(a.max()))) if a.dtype.kind in "iu" and len(a) else a for a in arrays]
    head = pickle.dumps([(a.dtype.str, len(a)) for a in narrow])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in narrow]
    raw = b"".join([len(head).to_bytes(4, "little"), head, *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in pickle.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
        at += n * size
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Plan:
    """How many shards there are, and which words (sorted ids) are dealt to how many of them."""

    shards: int
    hot: np.ndarray
    parts: np.ndarray

    def home(self, ids):
        return (_mix(ids + _K) % np.uint64(self.shards)).astype(np.int64)

    def tail(self, ids):
        """The shard of a word as the last one."""
        return (_mix(_mix(ids * _K) + np.uint64(77)) % np.uint64(self.shards)).astype(np.int64)

    def parts_of(self, ids):
        out = np.ones(len(ids), np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
            out = np.where(self.hot[at] == ids, self.parts[at], out)
        return out

    def middle(self, ids, a, b):
        """The shards of trigrams with these first and middle words (places in ``ids``)."""
        to, parts = self.home(ids)[b], self.parts_of(ids)[b]
        many = np.flatnonzero(parts > 1)
        if len(many):
            to[many] = (to[many] + (_mix(ids[a[many]] * _K) % parts[many].astype(np.uint64)).astype(np.int64)) % self.shards
        return to


def _cuts(batches):
    """For every ``LETTERS`` bytes of text or so: ids, places of the words of all texts in them, lengths, keys and whether a text trains."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(upto):
            before = upto[at - 1] if at else 0
            end = min(len(upto), int(np.searchsorted(upto, before + LETTERS - size)) + 1)
            held.append(batch.slice(at, end - at))
            size += upto[end - 1] - before
            at = end
            if size >= LETTERS:
                yield from _cut(held)
                held, size = [], 0
    yield from _cut(held)


def _cut(held):
    if not held:
        return
    text, keys, trains = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
    # ASCII white space parts words, as in bytes.split(); the bytes need not be UTF-8.
    words = pc.ascii_split_whitespace(text.view(pa.string()))
    flat, owner = words.flatten(), pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    n = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(text))
    flat = flat.filter(full).dictionary_encode()
    trains = trains.to_numpy(zero_copy_only=False).astype(bool)
    here = np.flatnonzero((n > 0) | (trains & text.is_valid().to_numpy(zero_copy_only=False)))
    if not len(here):
        return
    names = flat.dictionary
    _, places, data = names.buffers()
    places = np.frombuffer(places, np.int32, len(names) + 1, 4 * names.offset).tolist()
    data = data.to_pybytes() if data else b""
    ids = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(places, places[1:])), np.uint64, len(names))
    ids[ids < 2] += np.uint64(2)
    lengths = n[here] + 3
    ends = np.cumsum(lengths)
    codes, inside = np.zeros(ends[-1], np.int32), np.ones(ends[-1], bool)
    codes[ends - 1] = 1
    inside[ends - 1] = inside[ends - lengths] = inside[ends - lengths + 1] = False
    codes[inside] = flat.indices.to_numpy(zero_copy_only=False) + 2
    yield np.concatenate([np.array([0, 1], np.uint64), ids]), codes, lengths, keys.take(pa.array(here)).to_pylist(), trains[here]


def _trigrams(codes, lengths):
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(lengths)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    return codes[at], codes[at + 1], codes[at + 2], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths - 2)


def _groups(to):
    """Each value of ``to`` and where it stands, in order."""
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 65536 else to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(to[part[0]]), part


def _texts(doc):
    """Texts of a sorted array, their first places, and both as steps and counts for :func:`pack`."""
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(doc)) + 1]) if len(doc) else np.zeros(0, np.int64)
    texts = doc[first].astype(np.int64)
    return texts, np.diff(texts, prepend=0), np.diff(first, append=len(doc))


def _rows(rows):
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], schema=_ARROW)


def _batches(rows, size=16_000_000):
    """Rows as Arrow batches of bounded bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[3])
        if n >= size:
            yield _rows(held)
            held, n = [], 0
    if held:
        yield _rows(held)


def _local(ids, *codes):
    """The ids that ``codes`` are places of, and their places in these."""
    mark = np.zeros(len(ids), bool)
    for x in codes:
        mark[x] = True
    used = np.flatnonzero(mark)
    place = np.empty(len(ids), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return ids[used], [place[x] for x in codes]


def _training_blocks(plan: Plan):
    def rows(batches):
        for ids, codes, lengths, _, _ in _cuts(batches):
            a, b, c, _ = _trigrams(codes, lengths)
            for to, part in _groups(plan.middle(ids, a, b)):
                own, abc = _local(ids, a[part], b[part], c[part])
                yield to, 0, BLOCK, pack(own, *abc)

    return lambda batches: _batches(rows(batches))


@dataclass
class Counts:
    """Distinct trigrams of a shard. A pair is b * v + a, a trigram pair's place * v + c, a bigram b * v + c."""

    words: np.ndarray
    pairs: np.ndarray
    tri: np.ndarray
    n: np.ndarray
    big: np.ndarray
    n2: np.ndarray

    @property
    def v(self):
        return max(1, len(self.words))


def count(blocks) -> Counts:
    used = []
    for ids, *abc in blocks:
        mark = np.zeros(len(ids), bool)
        for x in abc:
            mark[x] = True
        used.append(ids[mark])
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *used]))
    v = max(1, len(words))
    at = [np.searchsorted(words, ids.astype(np.uint64)) for ids, *_ in blocks]
    a, b, c = (np.concatenate([np.zeros(0, np.int64), *(w[block[k]] for w, block in zip(at, blocks))]) for k in (1, 2, 3))
    pairs, pair = np.unique(b * v + a, return_inverse=True)
    tri, n = np.unique(pair * v + c, return_counts=True)
    big, n2 = np.unique(pairs[tri // v] // v * v + tri % v, return_counts=True)
    return Counts(words, pairs, tri, n, big, n2)


def _stats(level, n, total=0, words=0):
    out = np.zeros(14, np.int64)
    out[4 * level : 4 * level + 4] = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
    out[12:] = total, words
    return out


def _by_shard(plan: Plan):
    """Counts of a shard's trigrams; what it adds to its last words goes to theirs."""

    def run(key, table):
        me = key[0].as_py()
        x = count([unpack(p.as_py()) for p in table.column("payload")])
        hot = plan.parts_of(x.words)[x.big // x.v] > 1
        last = x.big % x.v
        own = np.bincount(last[~hot], minlength=x.v)
        rows = [(0, me, STATS, (_stats(0, x.n) + _stats(1, x.n2[~hot])).tobytes())]
        to = plan.tail(x.words)
        at = np.unique(last)
        pairs = {t: np.flatnonzero(hot)[p] for t, p in _groups(to[last[hot]])}
        for t, p in _groups(to[at]):
            h = pairs.get(t, np.zeros(0, np.int64))
            rows.append((t, me, BLOCK, pack(x.words[at[p]], own[at[p]], x.words[x.big[h] // x.v], x.words[last[h]], x.n2[h])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _by_last(plan: Plan, top: int):
    """Counts of last words, told to every shard that has them."""

    def run(key, table):
        me = key[0].as_py()
        rows, blocks = [], []
        for origin, kind, p in zip(table.column("origin").to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            if kind == STATS:
                rows.append((0, 0, STATS, p))
            else:
                blocks.append((origin, *unpack(p)))
        if not blocks:
            return pa.Table.from_batches([_rows(rows)])
        words = np.unique(np.concatenate([b[1] for b in blocks]))
        at = [np.searchsorted(words, b[1]) for b in blocks]
        n = np.bincount(np.concatenate(at), np.concatenate([b[2] for b in blocks]), len(words)).astype(np.int64)
        b, c = (np.concatenate([x[k] for x in blocks]).astype(np.uint64) for k in (3, 4))
        keys, owner = np.unique(np.searchsorted(plan.hot, b) * len(words) + np.searchsorted(words, c), return_inverse=True)
        n2 = np.bincount(owner, np.concatenate([x[5] for x in blocks]), len(keys)).astype(np.int64)
        n += np.bincount(keys % len(words), minlength=len(words))
        rows.append((0, 0, STATS, (_stats(1, n2) + _stats(2, n, n.sum(), len(n))).tobytes()))
        for (origin, *_), w in zip(blocks, at):
            rows.append((origin, me, SHARES, pack(n[w])))
        for h, part in _groups(keys // len(words)):
            last = keys[part] % len(words)
            value = pack(words[last], n[last], n2[part])
            home = int(plan.home(plan.hot[h : h + 1])[0])
            rows += [((home + r) % plan.shards, h, HOT, value) for r in range(int(plan.parts[h]))]
        rows.append((plan.shards + me, 0, WORDS, pack(words, n)))
        most = np.argsort(-n, kind="stable")[:top]
        rows.append((0, 0, TOP, pack(words[most], n[most])))
        return pa.Table.from_batches([_rows(rows)])

    return run


@dataclass
class Facts:
    """Discounts of the three orders, the sum of words' counts, the share of an unknown word, and the commonest words."""

    d: tuple
    total: int
    unknown: float
    top: np.ndarray
    logs: np.ndarray

    def cut(self, level, n):
        return np.array([0.0, *self.d[level]])[np.minimum(n, 3)]

    def single(self, n):
        return (n - self.cut(2, n)) / max(1, self.total) + self.unknown

    def rests(self, level, where, n, size):
        """Sums of n and what is left, by place."""
        total = np.bincount(where, n, size)
        return total, np.where(total > 0, np.bincount(where, self.cut(level, n), size) / np.maximum(total, 1), 1.0)


def _find(table, keys):
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _text_blocks(plan: Plan, shared, group: int):
    def rows(batches):
        facts = shared.value
        for k, (ids, codes, lengths, keys, trains) in enumerate(_cuts(batches)):
            me = (TaskContext.get().partitionId() << 24) + k
            a, b, c, doc = _trigrams(codes, lengths)
            at, known = _find(facts.top, ids)
            back = group + GROUPS * (me % (plan.shards // GROUPS))  # any shard of this turn
            yield back, me, KEYS, pack(np.frombuffer(b"".join(keys), np.uint8), lengths - 3)
            if group == 0:
                logs = np.where(known, facts.logs[at], 0.0) if len(facts.top) else np.zeros(len(ids))
                yield back, me, SUMS, pack(np.diff(np.arange(len(lengths)), prepend=0), np.bincount(doc, logs[c], len(lengths)))
            to = plan.middle(ids, a, b)
            own = np.flatnonzero(to % GROUPS == group)
            for s, p in _groups(to[own]):
                part = own[p]
                texts, steps, n = _texts(doc[part])
                words, abc = _local(ids, a[part], b[part], c[part])
                yield s, me, BLOCK, pack(words, *abc, steps, n, trains[texts].view(np.uint8))
            to = plan.tail(ids)[c]
            own = np.flatnonzero((to % GROUPS == group) & ~known[c])
            for s, p in _groups(to[own]):
                part = own[p]
                _, steps, n = _texts(doc[part])
                words, (last,) = _local(ids, c[part])
                yield plan.shards + s, me, TAIL, pack(words, last, steps, n)

    return lambda batches: _batches(rows(batches))


def _sums(logs, n):
    return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(n.astype(np.int64))[:-1]])).astype(np.float32)


def _score_shard(plan: Plan, shared):
    def last_words(rows, facts):
        words, n = next((unpack(p) for _, kind, p in rows if kind == WORDS), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        for origin, kind, p in rows:
            if kind == TAIL:
                ids, last, steps, count = unpack(p)
                at, known = _find(words, ids)
                logs = np.log(np.where(known, facts.single(n[at].astype(np.int64)), facts.unknown) if len(words) else np.full(len(ids), facts.unknown))
                yield 0, origin, SUMS, pack(steps, _sums(logs[last], count))

    def middle_words(rows, facts):
        blocks = [(origin, *unpack(p)) for origin, kind, p in rows if kind == BLOCK]
        if not blocks:
            return
        training = []
        for _, ids, a, b, c, steps, n, trains in blocks:
            own = np.repeat(trains.astype(bool), n)
            if own.any():
                training.append((ids, a[own], b[own], c[own]))
        x = count(training)
        v = x.v
        hot = plan.parts_of(x.words)[x.big // v] > 1
        last = np.unique(x.big % v)
        to, single = plan.tail(x.words)[last], np.zeros(v, np.int64)
        for origin, kind, p in rows:
            if kind == SHARES:
                single[last[to == origin]] = unpack(p)[0]
        # Bigrams of words that are dealt to several shards come whole from their last words' shards.
        more = [(plan.hot[origin], *unpack(p)) for origin, kind, p in rows if kind == HOT]
        words = np.unique(np.concatenate([x.words, *(m[1].astype(np.uint64) for m in more), np.array([m[0] for m in more], np.uint64)]))
        size, new = max(1, len(words)), np.searchsorted(words, x.words)
        n1 = np.zeros(size, np.int64)
        n1[new] = single[: len(new)]
        cold = x.big[~hot]
        big, n2 = [new[cold // v] * size + new[cold % v]], [x.n2[~hot]]
        for b, c, one, two in more:
            c = np.searchsorted(words, c.astype(np.uint64))
            n1[c] = one
            big.append(int(np.searchsorted(words, b)) * size + c)
            n2.append(two.astype(np.int64))
        big, n2 = np.concatenate(big), np.concatenate(n2)
        order = np.argsort(big, kind="stable")
        big, n2 = big[order], n2[order]
        s1 = facts.single(n1)
        total, r2 = facts.rests(1, big // size, n2, size)
        q2 = (n2 - facts.cut(1, n2)) / total[big // size] / s1[big % size] + r2[big // size]
        total, r3 = facts.rests(0, x.tri // v, x.n, max(1, len(x.pairs)))
        pairs = new[x.pairs // v] * size + new[x.pairs % v]
        tri = x.tri // v * size + new[x.tri % v]
        q3 = (x.n - facts.cut(0, x.n)) / total[x.tri // v] / s1[tri % size]
        for origin, ids, a, b, c, steps, n, _ in blocks:
            at, known = _find(words, ids)
            at = np.where(known, at, -1)
            a, b, c = at[a], at[b], at[c]
            q = np.where(b >= 0, r2[b], 1.0)
            both = np.flatnonzero((b >= 0) & (c >= 0))
            place, hit = _find(big, b[both] * size + c[both])
            q[both[hit]] = q2[place[hit]]
            both = np.flatnonzero((b >= 0) & (a >= 0))
            place, hit = _find(pairs, b[both] * size + a[both])
            both, place = both[hit], place[hit]
            q[both] *= r3[place]
            end = c[both] >= 0
            both, place = both[end], place[end]
            place, hit = _find(tri, place * size + c[both])
            q[both[hit]] += q3[place[hit]]
            yield 0, origin, SUMS, pack(steps, _sums(np.log(q), n))

    def run(key, table):
        me, facts = key[0].as_py(), shared.value
        rows = list(zip(table.column("origin").to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist()))
        out = [(0, origin, kind, p) for origin, kind, p in rows if kind in (KEYS, SUMS)]
        out += (middle_words if me < plan.shards else last_words)(rows, facts)
        return pa.Table.from_batches([_rows(out)])

    return run


def _total(key, table):
    rows = list(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()))
    keys, n = next(unpack(p) for kind, p in rows if kind == KEYS)
    logs = np.zeros(len(n))
    for kind, p in rows:
        if kind == SUMS:
            steps, sums = unpack(p)
            logs[np.cumsum(steps.astype(np.int64))] += sums
    return pa.table({"key": pa.array([k.tobytes() for k in keys.reshape(-1, 16)], pa.binary()), "n": pa.array(n.astype(np.int64)), "log": pa.array(logs)})


def frequency(texts: DataFrame) -> DataFrame:
    """How often words stand in ``texts``, rare ones left out, and (id null) all words and ends together."""

    def run(batches):
        for ids, codes, lengths, _, _ in _cuts(batches):
            n = np.bincount(codes, minlength=len(ids))
            often = np.flatnonzero(n * 20_000 >= len(codes))
            yield pa.RecordBatch.from_arrays([pa.array([None, *ids[often].view(np.int64).tolist()], pa.int64()), pa.array([int((lengths - 2).sum()), *n[often].tolist()], pa.int64())], names=["id", "n"])

    return _training(texts).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _training(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("text").cast("binary").alias("text"), F.lit(None).cast("binary").alias("key"), F.lit(True).alias("trains"))


def plan(tokens: int, size: int, frequent: DataFrame) -> Plan:
    """Shards for so many training words and bytes of text. A word with more than a shard's part of the words is dealt to several."""
    shards = -(-max(tokens // TRAINING, size // BYTES, 1) // GROUPS) * GROUPS
    often = sorted((r.id % 2**64, r.n) for r in frequent.where(F.col("id").isNotNull() & (F.col("n") * shards > tokens)).collect())
    parts = [min(shards, 1 + n * shards // max(1, tokens)) for _, n in often]
    return Plan(shards, np.array([i for i, _ in often], np.uint64), np.array(parts, np.int64))


def _facts(told: DataFrame) -> Facts:
    from .quality import discounts

    stats = sum((np.frombuffer(r.payload, np.int64) for r in told.where(F.col("kind") == STATS).select("payload").collect()), np.zeros(14, np.int64))
    d = tuple(discounts(dict(enumerate(stats[4 * k : 4 * k + 4].tolist(), 1))) for k in range(3))
    total, words = stats[12:].tolist()
    one, two = stats[8:10].tolist()
    left = d[2][0] * one + d[2][1] * two + d[2][2] * (words - one - two)
    facts = Facts(d, total, left / total / (words + 1) if total else 0.5, np.zeros(0, np.uint64), np.zeros(0))
    top = [unpack(r.payload) for r in told.where(F.col("kind") == TOP).select("payload").collect()]
    if top:
        ids, n = np.concatenate([x.astype(np.uint64) for x, _ in top]), np.concatenate([n.astype(np.int64) for _, n in top])
        order = np.argsort(ids)
        facts.top, facts.logs = ids[order], np.log(facts.single(n[order]))
    return facts


def log_sums(docs: DataFrame, trusted: DataFrame, p: Plan) -> DataFrame:
    """Of each ``key`` of ``docs`` (text, key, trains) the words n and the sum of their and the end's natural log probabilities.

    The model is that of ``trusted``, which holds the texts of ``docs`` that train.
    Equal keys say equal texts.
    """
    spark = docs.sparkSession
    blocks = _training(trusted).mapInArrow(_training_blocks(p), SCHEMA)
    counted = blocks.repartition(p.shards, "to").groupBy("to").applyInArrow(_by_shard(p), SCHEMA)
    told = keep(counted.repartition(p.shards, "to").groupBy("to").applyInArrow(_by_last(p, -(-COMMON // p.shards)), SCHEMA))
    shared = spark.sparkContext.broadcast(_facts(told))
    turns = []
    for group in range(GROUPS):
        own = told.where(F.col("kind").isin(SHARES, HOT, WORDS) & (F.col("to") % GROUPS == group))
        cut = docs.select(F.col("text").cast("binary"), "key", "trains").mapInArrow(_text_blocks(p, shared, group), SCHEMA)
        sums = cut.union(own).repartition(max(4, 2 * p.shards // GROUPS), "to").groupBy("to").applyInArrow(_score_shard(p, shared), SCHEMA)
        turns.append(keep(sums.groupBy("origin").applyInArrow(_total, "key binary, n long, log double").withColumn("turn", F.lit(group))))
    drop(told)
    together = turns[0]
    for t in turns[1:]:
        together = together.union(t)
    return together.groupBy("key", "turn").agg(F.max("n").alias("n"), F.max("log").alias("log")).groupBy("key").agg(F.max("n").alias("n"), F.sum("log").alias("log"))
