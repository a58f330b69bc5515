"""SimHash near-duplicates by segment popcounts.

A fingerprint maps to the number of set bits in each of its 32 two-bit segments.
The Manhattan distance of two such vectors is never more than the Hamming
distance of the fingerprints, and at radius 3 one half of the vector (16
segments) has a distance of at most 1. So the grid has unit cells in each half,
every fingerprint stands in its two home cells, and it also probes the cells
one step up along each axis; a pair one step apart meets where the lower one
probes the higher one's home. Pairs that meet are compared exactly.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, keep
from .components import components
from .forest import forest

RADIUS = 3
_PAIRS = 0x55555555


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a whole text, A-Z lower-cased.

    Repeated shingles count each time; fewer words than a shingle are one
    shingle, and no word at all (also null) gives 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; only doc_id and text are read."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cells(fps: DataFrame) -> DataFrame:
    """(half, cell, home, fp): both home cells of each fingerprint and the probes one step up."""
    # Popcounts of 16 two-bit fields at once: even bits plus odd bits.
    def counts(bits):
        return bits.bitwiseAND(F.lit(_PAIRS)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_PAIRS))

    halves = F.array(*(
        F.struct(F.lit(k).alias("half"), counts(F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))).alias("cell")) for k in (0, 1)
    ))
    up = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.call_function("shiftright", F.col("h.cell"), i * 2).bitwiseAND(F.lit(3)) < 2),
        lambda i: F.struct(F.lit(False).alias("home"), (F.col("h.cell") + F.call_function("shiftleft", F.lit(1).cast("long"), i * 2)).alias("cell")),
    )
    home = F.array(F.struct(F.lit(True).alias("home"), F.col("h.cell").alias("cell")))
    return fps.select("fp", F.explode(halves).alias("h")).select("fp", F.col("h.half").alias("half"), F.explode(F.concat(home, up)).alias("c")).select("half", "c.cell", "c.home", "fp")


def _links(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one cell; probes meet homes only."""
    n, a, b = len(fp), [], []
    homes = np.flatnonzero(home)
    step = max(1, (1 << 21) // n)
    for at in range(0, len(homes), step):
        rows = homes[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, :]) <= radius)
        different = fp[rows[i]] != fp[j]
        a.append(rows[i][different])
        b.append(j[different])
    if not a:
        return fp[:0], fp[:0]
    x, y = forest(n, np.concatenate(a), np.concatenate(b))
    return fp[x], fp[y]


def links(fps: DataFrame, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within ``radius`` bits, directly or by steps.

    ``fps`` has distinct long ``fp``. All true links of a cell of up to eight
    are listed; of a fuller cell a spanning forest is, so a dense group costs
    edges in proportion to its size. Cells of more than ``block`` members are
    split, and each pair of parts is a task's group of its own.
    """
    if radius > 3:
        raise ValueError("one step in a half cell is only enough up to radius 3")
    cells = keep(_cells(fps))
    full = keep(cells.groupBy("half", "cell").count().where(F.col("count") > block))
    if full.isEmpty():
        parted = cells.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = F.ceil(F.col("count") / F.lit(block)).cast("long")
        parted = cells.join(full.select("half", "cell", parts.alias("parts")), ["half", "cell"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.least(own, x) * F.col("parts") + F.greatest(own, x))))
        parted = parted.select("half", "cell", "home", "fp", other.alias("part"))

    def run(batches):
        rest = None
        for batch in batches:
            x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                x = [np.concatenate(p) for p in zip(rest, x)]
            key = np.flatnonzero((x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[4][1:] != x[4][:-1])) + 1
            last = key[-1] if len(key) else 0
            rest = [p[last:] for p in x]
            yield from groups([p[:last] for p in x], key)
        if rest is not None:
            yield from groups(rest, np.zeros(0, np.int64))

    def groups(x, key):
        n = len(x[0])
        if not n:
            return
        starts = np.concatenate([[0], key[key < n]])
        ends = np.append(starts[1:], n)
        fp, home = x[3].astype(np.int64).view(np.uint64), x[2].astype(bool)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        few = (ends - starts)[group] <= 8
        out_a, out_b = [], []
        for step in range(1, 8):
            i = np.flatnonzero(few[:-step] & (group[:-step] == group[step:]) & (home[:-step] | home[step:]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
            out_a.append(fp[i])
            out_b.append(fp[i + step])
        for g in np.flatnonzero((ends - starts) > 8):
            a, b = _links(fp[starts[g] : ends[g]], home[starts[g] : ends[g]], radius)
            out_a.append(a)
            out_b.append(b)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        differ = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[differ].view(np.int64)), pa.array(b[differ].view(np.int64))], names=["a", "b"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        parted.repartition(n, "half", "cell", "part").sortWithinPartitions("half", "cell", "part")
        .select("half", "cell", "home", "fp", "part").mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Two documents link if their fingerprints differ in at most ``radius`` bits;
    component_id is the least doc_id reachable by links, itself included. Equal
    texts share a fingerprint and are compared once. Null and empty texts have
    fingerprint 0. Repeated rows come out each, a null doc_id never names a
    component (a component of null ids only has a null id), and other columns
    are ignored.
    """
    per_doc = keep(fingerprints(docs, shingle))
    distinct = keep(per_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = keep(components(links(distinct.select("fp"), radius, block)))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = keep(named)
    names = keep(named.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so a hot root is split
    return per_doc.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- Similarity of a given size ---------------------------------------------------------------
#
# A similarity of 0.8 moves about 15 % of a fingerprint's bits, far beyond a radius at which popcounts
# tell anything apart. For it, fingerprints are 1024 bits long. Two sets at 0.8 have at least four fifths of
# each in common, so in any one order of all shingles the first fifth (and one more) of each holds a common
# shingle: sets that share one of these are compared, none else need be. The order is that of the hashes,
# with very common shingles last. Those within a wide radius are candidates; the sets of shingles decide.

_ODD = np.array([xxhash.xxh64_intdigest(b"%d" % k, 7) | 1 for k in range(64)], np.uint64)


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Hash family: one 64-bit hash of each h for each multiplier."""
    x = h[:, None] * k[None, :]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased; fewer words than a shingle are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64))


def first_shingles(h: np.ndarray, similarity: float) -> np.ndarray:
    """The least hashes, as signed numbers, of which two sets at ``similarity`` or more share one."""
    return np.sort(h.view(np.int64))[: _first(len(h), similarity)]


def _first(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def sketch(text: bytes | None, shingle: int = 5, width: int = 16, similarity: float = 0.8) -> tuple[bytes, np.ndarray]:
    """Long fingerprint (``width`` x 64 bits) of a text's set of word shingles and the set's :func:`first_shingles`."""
    h = shingle_set(text, shingle)
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(h), 2048):
        ones += np.unpackbits(_mixed(h[at : at + 2048], _ODD[:width]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), first_shingles(h, similarity)


def radius_of(similarity: float, bits: int = 1024, deviations: float = 2.0) -> int:
    """Differing bits of two equally long texts at this Jaccard similarity, plus so many deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def _close(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows (words of 64 bits) within ``radius`` bits; a quarter of the words rules most pairs out."""
    first = x.shape[1] // 4
    far = np.zeros((len(x), len(y)), np.uint16)
    for k in range(first):
        far += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    i, j = np.nonzero(far <= radius)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        far[a, b] += np.bitwise_count(x[a, first:] ^ y[b, first:]).sum(1, dtype=np.uint16)
    ok = far[i, j] <= radius
    return i[ok], j[ok]


def _near_forest(fp: np.ndarray, lead: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs within ``radius`` bits of which one is among the first ``lead`` rows.

    Rows within the radius of the first one are joined through it and not compared with each other.
    """
    n = len(fp)
    _, near = _close(fp[:1], fp, radius)
    a, b = [np.zeros(len(near), np.int64)], [near]
    outside = np.setdiff1d(np.arange(n), near)
    # Leads outside meet all rows, leads inside the rows outside that do not lead.
    for some, others in ((outside[outside < lead], np.arange(n)), (near[(near < lead) & (near > 0)], outside[outside >= lead])):
        for at in range(0, len(some) if len(others) else 0, 512):
            i, j = _close(fp[some[at : at + 512]], fp[others], radius)
            a.append(some[at + i])
            b.append(others[j])
    return forest(n, np.concatenate(a), np.concatenate(b))


def _verified(fp: np.ndarray, sets: list[np.ndarray], lead: int, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs within ``radius`` bits whose sets have a Jaccard of ``similarity`` or more, one of them among the first ``lead``.

    A pair that is already connected is not compared again, so a dense group costs in proportion to its size.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label, a, b = np.arange(n), [], []
    for i in range(min(lead, n - 1)):
        later = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(later):
            continue
        far = np.bitwise_count(fp[later] ^ fp[i]).sum(1, dtype=np.uint16)
        later = later[(far <= radius) & (np.minimum(sizes[later], sizes[i]) >= similarity * np.maximum(sizes[later], sizes[i]))]
        if not len(later):
            continue
        # Members that hold each shingle of i, from the inverted list of the block.
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        count = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=n)[later]
        for j in later[common >= similarity * (sizes[later] + sizes[i] - common) - 1e-9]:
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _connect(members: DataFrame, by: list[str], block: int, links) -> DataFrame:
    """Edges (a, b) that connect the members of each group (columns ``by``) just as all links in it do.

    ``links(columns, lead)`` finds links in one block, from the columns after
    node, of which one end is among the first ``lead`` rows. Groups are cut into
    parts of about ``block`` members, and the group's least node, its hub, stands
    first in every part. Members that some link in their part connects with the
    hub are connected with all others of that kind. Only the rest, in a group of
    near copies few or none, are then compared with all parts, in blocks of
    their own. So no group is in one task, and a group of near copies costs in
    proportion to its size.
    """
    payload = [c for c in members.columns if c not in (*by, "node")]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = keep(members.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"), F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = F.when(F.col("node") == F.col("hub"), upto("parts")).otherwise(F.array(own))
    dealt = members.join(sizes, by).withColumn("part", F.explode(place)).withColumn("lead", F.col("node") == F.col("hub"))
    keys = len(by) + 1
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["a long, b long"])

    def columns(group, at):
        """node, and the payload's columns, from column ``at`` on; a node that is there twice counts once, where it leads."""
        node = np.concatenate([g.column(at).to_numpy() for g in group])
        _, first = np.unique(node, return_index=True)
        first.sort()
        rest = [[x for g in group for x in g.column(k).to_pylist()] for k in range(at + 1, at + 1 + len(payload))]
        return node[first], [[c[i] for i in first.tolist()] for c in rest]

    def first_pass(batches):
        for group in _grouped(batches, keys):
            node, rest = columns(group, keys + 1)
            x, y = links(rest, len(node))
            a, b = [node[x]], [node[y]]
            if group[0].column(keys)[0].as_py() > 1:
                label = np.arange(len(node))
                for i, j in zip(x.tolist(), y.tolist()):
                    label[label == label[j]] = label[i]
                left = node[label != label[0]]
                a.append(left)
                b.append(np.full(len(left), -1))
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([*(pa.array([group[0].column(k)[0].as_py()] * len(a), group[0].column(k).type) for k in range(len(by))), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[*by, "a", "b"])

    blocks = dealt.repartition(n, *by, "part").sortWithinPartitions(*by, "part", F.desc("lead"), "node")
    found = keep(blocks.select(*by, "part", "parts", "node", *payload).mapInArrow(first_pass, schema))
    edges = found.where("b >= 0").select("a", "b")
    left = keep(found.where("b < 0").select(*by, F.col("a").alias("node")).distinct())
    if left.isEmpty():
        return edges
    late = keep(left.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("late")))
    whole = members.join(sizes, by).join(late, by).join(left.withColumn("lead", F.lit(True)), [*by, "node"], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    mine = F.pmod(F.xxhash64("node", F.lit("late")), F.col("late")).cast("int")
    pair = lambda lead, p, q: F.struct(F.lit(lead).alias("lead"), p.alias("part"), q.alias("chunk"))
    follows = F.transform(upto("late"), lambda q: pair(False, own, q))
    leads = F.when(F.col("lead"), F.transform(upto("parts"), lambda p: pair(True, p, mine))).otherwise(F.array().cast("array<struct<lead:boolean,part:int,chunk:int>>"))
    again = whole.withColumn("x", F.explode(F.concat(leads, follows))).select(*by, "x.part", "x.chunk", "x.lead", "node", *payload)

    def second_pass(batches):
        for group in _grouped(batches, keys + 1):
            node, rest = columns(group, keys + 2)
            lead = sum(int(np.count_nonzero(g.column(keys + 1).to_numpy(zero_copy_only=False))) for g in group)
            x, y = links(rest, lead)
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    blocks = again.repartition(n, *by, "part", "chunk").sortWithinPartitions(*by, "part", "chunk", F.desc("lead"), "node")
    return edges.unionByName(blocks.mapInArrow(second_pass, "a long, b long"))


def _grouped(batches, keys: int):
    """Groups of rows (lists of Arrow batches' slices) that agree in the first ``keys`` columns, from sorted batches."""
    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in x], axis=0)) + 1])
        if rest and any(rest[-1].column(k)[0].as_py() != x[k][0] for k in range(keys)):
            yield rest
            rest = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield [*rest, batch.slice(s, e - s)]
            rest = []
        rest.append(batch.slice(int(starts[-1])))
    if rest:
        yield rest


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, width: int = 16, block: int = 512, common: int = 1024) -> DataFrame:
    """(doc_id, component_id) for every row: groups of texts whose sets of shingles have a Jaccard of ``similarity`` or more."""
    rows, texts = _similar(docs, similarity, shingle, width, block, common)
    return rows.join(texts, "text_key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, width: int = 16, block: int = 512, common: int = 1024) -> DataFrame:
    """One document of each group of :func:`similar_documents`, all columns.

    A document is a row's doc_id and text: different texts under one doc_id are
    compared like any others, and so are rows without a doc_id. Of a group the
    least doc_id stays (null last), of one doc_id the least hash of the text; of
    rows that are one document but differ in other columns the one whose columns
    come first as text.
    """
    rows, texts = _similar(docs, similarity, shingle, width, block, common)
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "row")
    copies = keep(rows.groupBy("text_key", "row", "doc_id").agg(F.count("*").alias("n")))
    named = keep(copies.join(texts.select("text_key", "root"), "text_key").select("root", order.alias("o"), "n"))
    first = named.groupBy("root").agg(F.min(F.struct("o", "n")).alias("x")).select(F.col("x.o.row").alias("row"), (F.col("x.n") > 1).alias("several"))
    row, several = free("row", docs.columns), free("several", docs.columns)
    stays = keep(docs.withColumn(row, _document()).join(first.toDF(row, several), row))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alike = stays.where(F.col(several)).groupBy(row).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(several)).select(f"{several}.*")
    return stays.where(~F.col(several)).select(*columns).unionByName(alike)


def _document():
    """Identity of a row: equal rows, same doc_id and text, are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit("")), F.col("text").isNull())


def _meetings(read: DataFrame, nodes: DataFrame, similarity: float, shingle: int, common: int) -> DataFrame:
    """(node, cell): the first shingles of each text that another text has among its own.

    Shingles that are among the first of more than ``common`` texts go to the end
    of the order, so a line that many texts hold brings no two of them together
    unless they hold little else. Any order gives the same links, so the tasks are told
    the million most common ones, 8 MB, at most.
    """
    cells = nodes.select("node", F.explode("keys").alias("cell"))
    counts = keep(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    hot = keep(counts.where(F.col("n") > common).orderBy(F.desc("n"), "cell").limit(1_000_000).select("cell"))
    if hot.isEmpty():
        return cells.join(counts.select("cell"), "cell", "left_semi")
    last = hot.sparkSession.sparkContext.broadcast(np.sort(hot.toArrow().column("cell").to_numpy()))

    def choose(batches):
        for batch in batches:
            lists = []
            for t in batch.column(1):
                h = np.sort(shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, shingle).view(np.int64))
                is_hot = last.value[np.minimum(np.searchsorted(last.value, h), len(last.value) - 1)] == h
                lists.append(np.concatenate([h[~is_hot], h[is_hot]])[: _first(len(h), similarity)])
            cell = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch.column(0), cell], names=["row", "cell"])

    late = keep(cells.join(hot, "cell", "left_semi").select("node").distinct().join(nodes.select("node", F.col("bearer").alias("row")), "node"))
    again = read.join(late.select("row"), "row", "left_semi").select("row", "text").mapInArrow(choose, "row long, cell array<long>").dropDuplicates(["row"])
    again = again.join(late, "row").select("node", F.explode("cell").alias("cell"))
    cells = keep(cells.join(late.select("node"), "node", "left_anti").unionByName(again))
    return cells.join(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cell", "left_semi")


def _similar(docs: DataFrame, similarity: float, shingle: int, width: int, block: int, common: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_key) of every row and (text_key, root, component_id) of every text; the same lower-cased words are one text.

    Candidates share one of their first shingles (:func:`_meetings`) and are within 13
    deviations of the mean distance at ``similarity``: few shingles spread wider than
    many, four and five are at 8.9 deviations of theirs. Their groups are
    dealt once more with the sets of shingles, and only pairs that reach
    ``similarity`` exactly are linked (:func:`_connect`, both times).
    Rows, nulls and other columns as in :func:`near_duplicates`.
    """
    radius = radius_of(similarity, 64 * width, 13.0)

    def run(batches):
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
            made = [sketch(t, shingle, width, similarity) for t in texts]
            names = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) for _, k in made)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(k for _, k in made)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array([s for s, _ in made], pa.binary()), keys], names=["row", "doc_id", "text_key", "fp", "keys"])

    read = docs.select(_document().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    per_doc = keep(read.mapInArrow(run, "row long, doc_id long, text_key binary, fp binary, keys array<long>"))
    nodes = keep(per_doc.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.min("row").alias("bearer"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))

    def near(columns, lead):
        return _near_forest(np.frombuffer(b"".join(columns[0]), np.uint64).reshape(-1, width), lead, radius)

    cells = _meetings(read, nodes, similarity, shingle, common).join(nodes.select("node", "fp"), "node").select("cell", "node", "fp")
    candidates = keep(components(_connect(keep(cells), ["cell"], block, near)))

    def sets(batches):
        for batch in batches:
            made = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in batch.column(0)]
            names = [xxhash.xxh3_128_digest(b" ".join((t.as_py() or b"").lower().split())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([x.tobytes() for x in made], pa.binary())], names=["text_key", "set"])

    def alike(columns, lead):
        return _verified(np.frombuffer(b"".join(columns[0]), np.uint64).reshape(-1, width), [np.frombuffer(x, np.uint64) for x in columns[1]], lead, radius, similarity)

    # One row of each text that has a candidate brings its set.
    wanted = keep(nodes.select("text_key", "bearer", "node", "fp").join(candidates.withColumnRenamed("root", "group"), "node"))
    bring = read.join(wanted.select(F.col("bearer").alias("row")), "row", "left_semi").select("text").mapInArrow(sets, "text_key binary, set binary").groupBy("text_key").agg(F.first("set").alias("set"))
    members = keep(wanted.join(bring, "text_key").select("group", "node", "fp", "set"))
    roots = keep(components(_connect(members, ["group"], block, alike)))
    named = keep(nodes.select("text_key", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = keep(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return per_doc.select("row", "doc_id", "text_key"), keep(named.join(names, "root").select("text_key", "root", "component_id"))
