"""Alignment of two tokenizers over a corpus: which tokens cover the same bytes, and which partner is a token's best.

A text is encoded by A, a byte-level merge vocabulary, and by B, a piece
vocabulary with byte fallback. Tokens whose byte ranges overlap are linked; byte
offsets where both sides end cut the tokens into groups. The count of an id pair
is the number of documents that hold it linked.

Encoding. Neither side has a token that goes past a single space between two
visible characters, so a text falls into chunks there, and each side's tokens of
the text are those of its chunks. A worker encodes a chunk once and looks it
up afterwards, and a text of any length is never encoded as one.

Counts. Ids of A are striped: id a belongs to stripe ``a % stripes`` and is row
``a // stripes`` of that stripe's block, a dense matrix with a column for each
id of B. A task adds its documents up before anything is exchanged. Stripes get
these partial counts in rounds of bounded fan-in; ``np.add.at`` puts them into
the block, and its row maxima are the best counts. A block has
``ids of A / stripes x ids of B`` cells whatever the corpus is.

Scores. Links go to the stripe of their A id, each stripe over as many partitions
as its share of all links asks for, so a hot id's links are split. A partition
gets its stripe's counts first, then scores its links one row at a time. What
documents get from each stripe is added up by block of documents.

Rows are told apart by their place in the written link table, so ids may be
null or repeated. Links of all documents go through one kept table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: A single space between two characters that are no white space in either vocabulary's rules.
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: Chunks that the fast encoder may take: short, and of characters on whose classes all versions of Unicode agree.
_PLAIN = re.compile("[\x00-ɏ]{,1000}")
_MARK = "▁"
_BLOCK_BYTES = 1_000_000
_BLOCK_DOCS = 2048
_CACHED = 120_000
_LINK = "kind int, stripe int, block long, n long, places array<int>, cells array<int>, times array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>"


def byte_table(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary, whose entries write byte b as its own character if that is visible, else as U+0100 onwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    code = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {i: bytes(code[c] for c in entry) for entry, i in vocabulary.items() if all(c in code for c in entry)}


class Vocabularies:
    """Both encoders with the bytes of their ids."""

    def __init__(self, a_file: str, b_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a_file = a_file
        with open(a_file, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        self.bytes_a = byte_table({k: v for k, v in model["model"]["vocab"].items() if k not in special})
        self.fast_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in self.bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.n_a, self.n_b = max(model["model"]["vocab"].values()) + 1, self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(t.get(i, b"")) for i in range(n)], np.int64) for t, n in ((self.bytes_a, self.n_a), (dict(enumerate(self.bytes_b)), self.n_b)))
        # How a token is written inside its side of a group, and at that side's end.
        self.inside = np.array([f"{i}," for i in range(max(self.n_a, self.n_b))], object)
        self.end_a, self.end_b = (np.array([f"{i}{sign}" for i in range(n)], object) for n, sign in ((self.n_a, "|"), (self.n_b, ";")))
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces):
            raise ValueError("a piece of B goes past a space: texts can't be cut there")

    @cached_property
    def slow_a(self):
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(self.a_file)
        a.encode_special_tokens = True
        return a

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a: list = [None] * len(chunks)
        slow = []
        for i, c in enumerate(chunks):
            if _PLAIN.fullmatch(c):
                a[i] = self.fast_a.encode_ordinary(f" {c}")
            else:
                slow.append(i)
        for i, e in zip(slow, self.slow_a.encode_batch([f" {chunks[i]}" for i in slow], add_special_tokens=False) if slow else ()):
            a[i] = e.ids
        return a, self.b.encode(chunks, num_threads=1)


class Chunks:
    """Encoded chunks: token and group counts, the written form of the groups, and the linked id pairs as a * n_b + b."""

    def __init__(self, v: Vocabularies):
        self.v, self.known = v, {}
        self.sums = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, broken
        self.written: list[str] = []
        self.pairs, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, fresh: list[str]) -> None:
        """Encode chunks that are not known yet, all at once in flat arrays."""
        v = self.v
        a, b = v.encode(fresh)
        broken = np.zeros(len(fresh), np.int64)
        want = [f" {c}".encode() for c in fresh]
        whole = b"".join(want)
        if any(b"".join(map(table.__getitem__, chain.from_iterable(side))) != whole for table, side in ((v.bytes_a, a), (v.bytes_b, b))):
            for i, w in enumerate(want):  # some chunk does not come back byte for byte
                if b"".join(map(v.bytes_a.__getitem__, a[i])) != w or b"".join(map(v.bytes_b.__getitem__, b[i])) != w:
                    broken[i], a[i], b[i] = 1, [], []
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(fresh)) for side in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(v.length_a[ids_a]), np.cumsum(v.length_b[ids_b])
        begin_a, begin_b = np.concatenate(([0], end_a[:-1]))[: len(end_a)], np.concatenate(([0], end_b[:-1]))[: len(end_b)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        owner_a = np.repeat(np.arange(len(fresh)), n_a)
        n_groups = np.bincount(owner_a[np.searchsorted(end_a, both)], minlength=len(fresh))
        # The B tokens that overlap an A token follow each other.
        low, high = np.searchsorted(end_b, begin_a, "right"), np.searchsorted(begin_b, end_a, "left")
        width = high - low
        at_a = np.repeat(np.arange(len(ids_a)), width)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        n_links = np.bincount(owner_a[at_a], minlength=len(fresh))
        self.written += self._write(ids_a, ids_b, end_a, end_b, both, n_a + n_b)
        self.pairs = np.concatenate((self.pairs, ids_a[at_a] * v.n_b + ids_b[at_b]))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(n_links)))
        self.sums = np.concatenate((self.sums, np.stack((n_a, n_b, n_groups, n_links, broken), axis=1)))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))

    def _write(self, ids_a, ids_b, end_a, end_b, both, n) -> list[str]:
        """``a1,a2|b1`` of each group, groups joined by ``;``: each token with the sign after it, group by group, side A first."""
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        # A token stands after all of its own side before it and the other side's tokens of the groups before (side B: and of its own).
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        text = np.empty(len(ids_a) + len(ids_b), object)
        for ids, place, group, ends in ((ids_a, place_a, group_a, self.v.end_a), (ids_b, place_b, group_b, self.v.end_b)):
            last = np.append(group[1:] != group[:-1], True)[: len(ids)]
            text[place] = self.v.inside[ids]
            text[place[last]] = ends[ids[last]]
        text, ends = text.tolist(), np.cumsum(n).tolist()
        return ["".join(text[e - k : e])[:-1] for e, k in zip(ends, n.tolist())]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of the chunks of each text, in order; none for a text that is empty or no valid UTF-8."""
        cut = []
        for t in texts:
            try:
                cut.append(_CUT.split(t.decode()) if t else [])
            except UnicodeDecodeError:
                cut.append([])
        if fresh := list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.known)):
            self.add(fresh)
        return [np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks)) for chunks in cut]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of links of each chunk, all their pairs)."""
        width = self.begin[numbers + 1] - self.begin[numbers]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.begin[numbers], width)
        return width, self.pairs[at]


@lru_cache(maxsize=1)
def vocabularies(a_file: str, b_file: str) -> Vocabularies:
    """Read once in a Python worker, whose tasks share them."""
    return Vocabularies(a_file, b_file)


@lru_cache(maxsize=1)
def _held(a_file: str, b_file: str) -> list[Chunks]:
    """The chunks that a worker's tasks know, as the only entry of a list."""
    return [Chunks(vocabularies(a_file, b_file))]


def _give_back() -> None:
    """A worker that has encoded lets go of its chunks before it holds counts."""
    _held.cache_clear()
    pa.default_memory_pool().release_unused()


@contextmanager
def _small_batches(spark, rows: int = 1000, size: str = "16m"):
    """Rows here are long: Arrow batches of fewer of them. The session's settings come back afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes]]]:
    """Rows (doc_id, text) in blocks of bounded bytes and number; a longer text is a block of its own."""
    rows, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            if rows and (size + len(text) > _BLOCK_BYTES or len(rows) == _BLOCK_DOCS):
                yield rows
                rows, size = [], 0
            rows.append((ids[i].as_py(), text))
            size += len(text)
    if rows:
        yield rows


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (key, number) arrays by key, keys in order."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def _split(values: np.ndarray, stripe: np.ndarray, stripes: int) -> tuple[np.ndarray, list[int]]:
    """Order of ``values`` by stripe, otherwise as they are, and where each stripe ends."""
    order = np.argsort(stripe.astype(np.int32), kind="stable")
    return order, np.cumsum(np.bincount(stripe, minlength=stripes)).tolist()


def _rows(**columns) -> dict:
    names = [x.split()[0] for x in _LINK.split(", ")]
    return {n: columns.get(n) for n in names}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in (x.split() for x in _LINK.split(", "))], names=[x.split()[0] for x in _LINK.split(", ")])


def _encode(a_file: str, b_file: str, stripes: int):
    """Blocks of documents to rows of kind 0 (what is known of the documents), 1 (their links by stripe) and 2 (the task's own counts by stripe)."""

    def run(batches):
        v, known = vocabularies(a_file, b_file), _held(a_file, b_file)
        own, held = [], 0
        block = TaskContext.get().partitionId() << 32
        for rows in _blocks(batches):
            if len(known[0].known) > _CACHED:
                known[0] = Chunks(v)
            chunks = known[0]
            facts, place, pair, times = [], [], [], []
            for i, ((doc_id, _), numbers) in enumerate(zip(rows, chunks.of([t for _, t in rows]))):
                sums = chunks.sums[numbers].sum(axis=0)
                if not len(numbers) or sums[4]:
                    facts.append((doc_id, 0, 0, 0, 0, ""))
                    continue
                sha = hashlib.sha256()
                for at in range(0, len(numbers), 100_000):
                    sha.update((";" * bool(at) + ";".join([chunks.written[k] for k in numbers[at : at + 100_000].tolist()])).encode())
                facts.append((doc_id, *sums[:4].tolist(), sha.hexdigest()))
                used, often = np.unique(numbers, return_counts=True)
                width, found = chunks.gather(used)
                found, n = _merged([(found, np.repeat(often, width))])
                place.append(np.full(len(found), i, np.int32))
                pair.append(found)
                times.append(n)
            names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")
            yield _arrow([_rows(kind=0, stripe=-1, block=block, n=len(rows), **dict(zip(names, map(list, zip(*facts)))))])
            if pair:
                place, pair, times = map(np.concatenate, (place, pair, times))
                order, ends = _split(pair, pair // v.n_b % stripes, stripes)
                cells = (pair // v.n_b // stripes * v.n_b + pair % v.n_b)[order].astype(np.int32)
                place, times = place[order], times[order]
                yield _arrow([_rows(kind=1, stripe=s, block=block, n=e - b, places=place[b:e], cells=cells[b:e], times=times[b:e]) for s, (b, e) in enumerate(zip([0, *ends], ends)) if e > b])
                own.append(_merged([(pair, np.ones(len(pair), np.int64))]))
                held += len(own[-1][0])
                if held > 500_000:
                    own = [_merged(own)]
                    held = len(own[0][0])
                    if held > 350_000:
                        yield from _counts(own[0], v.n_b, stripes, block)
                        own, held = [], 0
            block += 1
        if own:
            yield from _counts(_merged(own), v.n_b, stripes, block)

    return run


def _counts(own, n_b: int, stripes: int, block: int):
    pair, n = own
    order, ends = _split(pair, pair // n_b % stripes, stripes)
    cells, n = (pair // n_b // stripes * n_b + pair % n_b)[order].astype(np.int32), n[order]
    yield _arrow([_rows(kind=2, stripe=s, block=block, n=e - b, cells=cells[b:e], times=n[b:e]) for s, (b, e) in enumerate(zip([0, *ends], ends)) if e > b])


def _numbers(column, row: int) -> np.ndarray:
    """A list cell as an array, without Python objects."""
    return column[row].values.to_numpy(zero_copy_only=False)


def _add_up(n_rows: int, n_b: int):
    """Partial counts of stripes, each stripe's rows together: np.add.at into the stripe's dense block, then its cells in use."""

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), _numbers(batch.column(2), i), _numbers(batch.column(3), i)

        for (stripe, part), group in groupby(rows(), key=lambda r: r[0]):
            _give_back()
            block, met = np.zeros((n_rows, n_b), np.int64), np.zeros(n_rows, bool)
            for _, cells, n in group:
                np.add.at(block.reshape(-1), cells, n)
                met[cells // n_b] = True
            for some in np.array_split(np.flatnonzero(met), -(-n_rows // 32)):  # rows of ids that occur, a few at a time
                if len(some):
                    row, column = np.nonzero(block[some])
                    cells, n = (some[row] * n_b + column).astype(np.int32), block[some[row], column]
                    best = block[some].max(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((stripe, pa.int32()), (part, pa.int64()), (cells, pa.list_(pa.int32())), (n, pa.list_(pa.int64())), (some.astype(np.int32), pa.list_(pa.int32())), (best, pa.list_(pa.int64())))], names=["stripe", "block", "cells", "times", "ids", "best"])

    return run


def stripe_counts(partial: DataFrame, n_rows: int, n_b: int, stripes: int, fan_in: int = 512) -> DataFrame:
    """(stripe, block, cells, times, ids, best): the corpus-wide counts, and the row maxima of each stripe's ids.

    ``partial`` has as many rows of a stripe as tasks made; rounds of at most
    about ``fan_in`` rows a task bring them together, so no task meets them all.
    """
    parts = max(1, partial.groupBy("stripe").count().agg(F.max("count")).first()[0] or 1)
    schema, kept = "stripe int, block long, cells array<int>, times array<long>, ids array<int>, best array<long>", None
    while True:
        parts = -(-parts // fan_in)
        dealt = partial.select("stripe", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("long").alias("block"), "cells", "times")
        dealt = dealt.repartitionById(stripes * parts, (F.col("stripe") * parts + F.col("block")).cast("int")).sortWithinPartitions("stripe", "block")
        done = keep(dealt.mapInArrow(_add_up(n_rows, n_b), schema))
        if kept is not None:
            drop(kept)
        if parts == 1:
            return done
        partial = kept = done


def _score(n_rows: int, n_b: int):
    """One stripe's counts (kind 0), then links (kind 1) of blocks of documents: sums of each document's links."""

    def run(batches):
        _give_back()
        counts, best = np.zeros(n_rows * n_b, np.int64), np.zeros(n_rows, np.int64)
        for batch in batches:
            blocks, places, best_n, sums = [], [], [], []
            for i in range(batch.num_rows):
                cells, times = _numbers(batch.column("cells"), i), _numbers(batch.column("times"), i)
                if batch.column("kind")[i].as_py() == 0:
                    counts[cells] = times
                    best[_numbers(batch.column("ids"), i)] = _numbers(batch.column("best"), i)
                    continue
                place, n = _numbers(batch.column("places"), i), counts[cells]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                blocks.append(batch.column("block")[i].as_py())
                places.append(place[first])
                best_n.append(np.add.reduceat(np.where(n == best[cells // n_b], times, 0), first))
                sums.append(np.add.reduceat(n * times, first))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(best_n, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))], names=["block", "places", "n_best", "count_sum"])

    return run


def _together(batches):
    """Rows of one block after another, its documents first (kind 0): a row for each document."""
    facts = best = total = None

    def out():
        return pa.RecordBatch.from_arrays([*facts, pa.array(best), pa.array(total)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("kind")[i].as_py() == 0:
                if facts is not None:
                    yield out()
                facts = [batch.column(c)[i].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")]
                best, total = np.zeros(len(facts[0]), np.int64), np.zeros(len(facts[0]), np.int64)
            else:
                place = _numbers(batch.column("places"), i)
                best[place] += _numbers(batch.column("n_best"), i)
                total[place] += _numbers(batch.column("count_sum"), i)
    if facts is not None:
        yield out()


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, stripes: int = 128, fan_in: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    * A text that is null or empty, is no valid UTF-8, or that either side does
      not give back byte for byte has no tokens: zeros and ''.
    * n_best counts the links whose pair has its A id's highest count, ties
      included; count_sum adds the counts of all links.
    * Null and repeated ids and repeated rows are documents of their own. An
      empty table gives an empty result. Further columns, whatever their names,
      are not looked at.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    v = _sizes(a_file, b_file)
    n_rows = -(-v[0] // stripes)
    with _small_batches(docs.sparkSession):
        links = keep(source.mapInArrow(_encode(a_file, b_file, stripes), _LINK), by="kind")
        counts = stripe_counts(links.where("kind = 2").select("stripe", "block", "cells", "times"), n_rows, v[1], stripes, fan_in)
        # One figure a stripe comes to the driver: how many partitions its links get.
        share = {r[0]: r[1] for r in links.where("kind = 1").groupBy("stripe").agg(F.sum("n")).collect()}
        usual = max(1, sum(share.values()) // stripes)
        split = [max(1, -(-share.get(s, 0) // usual)) for s in range(stripes)]
        base = np.concatenate(([0], np.cumsum(split))).tolist()
        begin, n = F.array(*map(F.lit, base[:-1])), F.array(*map(F.lit, split))
        stripe = F.col("stripe") + 1
        dealt = links.where("kind = 1").select((F.element_at(begin, stripe) + F.pmod(F.xxhash64("block"), F.element_at(n, stripe))).cast("int").alias("unit"), F.lit(1).alias("kind"), "block", "places", "cells", "times")
        first = F.element_at(begin, stripe)
        told = counts.select(F.explode(F.sequence(first, first + F.element_at(n, stripe) - 1)).alias("unit"), F.lit(0).alias("kind"), "cells", "times", "ids", "best")
        units = dealt.unionByName(told, allowMissingColumns=True).repartitionById(base[-1], F.col("unit")).sortWithinPartitions("kind")
        scored = keep(units.drop("unit").mapInArrow(_score(n_rows, v[1]), "block long, places array<int>, n_best array<long>, count_sum array<long>"))
        drop(counts)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")
    facts = links.where("kind = 0").select("block", F.lit(0).alias("kind"), *names)
    rows = facts.unionByName(scored.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(_together, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _sizes(a_file: str, b_file: str) -> tuple[int, int]:
    """Numbers of ids of both vocabularies."""
    v = vocabularies(a_file, b_file)
    return v.n_a, v.n_b
