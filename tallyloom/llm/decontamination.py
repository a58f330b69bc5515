"""Benchmark decontamination (DataFrame functions only).

Every benchmark item is looked for in windows of its own size in every document.
Windows get a SimHash of their shingles of five words, each as often as it
occurs; items get one in the same way. Multi-index block tables find all
(window, item) pairs of one size whose fingerprints are within the radius: the 64
bits are cut into six blocks, and of at most 17 differing bits some block has two
or fewer, so a window looks up its six blocks in tables that hold each item block
with all its neighbours at up to two bits. What is found is decided by the exact
weighted Jaccard similarity of the shingles (0.8 or more).

A window without any shingle of the benchmark has similarity zero to every item,
and of all windows that hold the same shared shingles the one that starts with
the first of them is as good as any. So windows are taken where a document has
some benchmark shingle, in every item size there is. Which item a window might
hold, the block tables alone say.

An item of fewer than five words is one shingle of all its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, keep

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 17  # of 64 bits; at similarity 0.8 about 10 bits differ, with a deviation of 2.9
BLOCKS = (11, 11, 11, 11, 10, 10)
_BREAK = r"[\x20\x09-\x0D]+"


def _row():
    """Identity of a row: equal rows, same doc_id and text, are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.col("text"))


def _hashes(column: str):
    """Hashes of the words in lower case, split at ASCII white space."""
    return F.transform(F.filter(F.split(F.lower(column), _BREAK), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: str, width: int = SHINGLE):
    """64-bit hashes of the shingles of ``width`` words, in order, from the column of word hashes."""
    last = F.size(words) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(width))))


def _near(df: DataFrame, small: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """Join with ``small``: broadcast while it has at most ``most`` rows, else exchanged like any other join."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, width, total, h, times): each shingle with its count, of each different (item_id, text) with a word.

    ``item`` numbers the items by a hash of both, so a null or repeated item_id is an item like any other.
    """
    item = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.lit("|"), F.col("text"))
    words = benchmark.where(F.col("text").isNotNull()).select(item.alias("item"), "item_id", _hashes("text").alias("w")).where(F.size("w") > 0).dropDuplicates(["item"])
    width = F.least(F.size("w"), F.lit(SHINGLE))
    short = [F.when(F.size("w") == k, _shingles("w", k)) for k in range(1, SHINGLE)]
    flat = words.select("item", "item_id", width.alias("width"), (F.size("w") - width + 1).alias("total"), F.explode(F.coalesce(*short, _shingles("w"))).alias("h"))
    return flat.groupBy("item", "item_id", "width", "total", "h").agg(F.count("*").cast("int").alias("times"))


def _fingerprints(shingles: DataFrame, by: list[str], longest: int) -> DataFrame:
    """SimHash of the rows' h in each group: a bit is set if it is in over half of them (column times weighs, if there).

    Counters of several bits share one sum; ``longest`` shingles in a group say how wide a counter must be.
    """
    lane = next(k for k in (8, 16, 32) if longest < 1 << (k - 1))
    ones = sum(1 << k for k in range(0, 64, lane))
    times = F.col("times").cast("long") if "times" in shingles.columns else F.lit(1).cast("long")
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(ones)) * times).alias(f"_{k}") for k in range(lane)]
    counted = shingles.groupBy(*by).agg(F.sum(times).alias("_n"), *sums)
    mask = F.lit((1 << lane) - 1)
    bits = []
    for bit in range(64):
        count = F.shiftrightunsigned(f"_{bit % lane}", bit // lane * lane).bitwiseAND(mask)
        bits.append(F.when(count * 2 > F.col("_n"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))).otherwise(F.lit(0)).cast("long"))
    return counted.select(*by, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _keys():
    """The six blocks of the column fp as structs (block, value)."""
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    return F.explode(F.array(*(
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)).cast("int").alias("value")) for k, (at, n) in enumerate(zip(starts, BLOCKS))
    ))).alias("b")


def _neighbours(reach: int) -> list:
    """For each block width the changes of up to ``reach`` bits."""
    out = {}
    for n in set(BLOCKS):
        found = {0}
        for _ in range(reach):
            found |= {x ^ (1 << k) for x in found for k in range(n)}
        out[n] = F.array(*map(F.lit, sorted(found)))
    return [out[n] for n in BLOCKS]


def _candidates(windows: DataFrame, items: DataFrame, radius: int, most: int) -> DataFrame:
    """Distinct (row, item, start) of one width and total whose fingerprints are within ``radius``, by block tables."""
    reach = max(0, radius) // len(BLOCKS)
    change = F.element_at(F.array(*_neighbours(reach)), F.col("b.block") + 1)
    tables = items.select("item", "width", "total", F.col("fp").alias("item_fp"), _keys()).select("item", "width", "total", "item_fp", "b.block", "b.value", F.explode(change).alias("x"))
    tables = tables.select("item", "width", "total", "item_fp", "block", F.col("value").bitwiseXOR(F.col("x")).alias("value"))
    probes = windows.select("row", "width", "total", "start", "fp", _keys()).select("row", "width", "total", "start", "fp", "b.block", "b.value")
    found = _near(probes, tables, ["width", "total", "block", "value"], "inner", most)
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("row", "item", "start").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, most: int = 500_000) -> DataFrame:
    """(row, doc_id, item_id, similarity, start, size): each document and item that match, with the best window.

    similarity is the weighted Jaccard of the shingles of the item and of the
    window of ``size`` words from word ``start`` (the whole text if it is
    shorter than the item), at least ``threshold``; the first of equal windows.
    The index finds pairs by any window; the windows around it, up to an item's
    size away, are then compared too. Null texts and texts without a word match
    nothing; an item under five words matches where its words stand in a row.
    Items with a null item_id match too, and those with one id and different
    texts each on their own (a pair of row and item_id then comes once, with the
    best). Rows equal in doc_id and text count once. Other columns are ignored.
    ``most`` rows is the largest broadcast.
    """
    items = keep(item_shingles(benchmark))
    kinds = keep(items.select("width", "total").distinct())
    widths = sorted(r.width for r in kinds.select("width").distinct().collect())  # at most five
    longest = kinds.agg(F.max("total")).first()[0] or 0
    hashed = docs.where(F.col("text").isNotNull()).select(_row().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _hashes("text").alias("w"))
    known = items.select("width", "h").distinct()
    hits = None
    for width in widths or [SHINGLE]:
        flat = hashed.select("row", "doc_id", F.size("w").alias("words"), F.posexplode(_shingles("w", width)).alias("at", "h"))
        part = _near(flat, known.where(F.col("width") == width).select("h"), ["h"], "left_semi", most).withColumn("width", F.lit(width))
        hits = part if hits is None else hits.unionByName(part)
    hits = keep(hits.groupBy("row", "width").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"), F.collect_set("at").alias("ats")))

    # The shingles of the documents that have any, and their windows: one task has all windows of a text.
    texts = _near(hashed, hits.select("row").distinct(), ["row"], "left_semi", most)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = texts.groupBy("row").agg(F.first("w").alias("w")).join(hits, "row")
    every = reduce(lambda a, k: F.when(F.col("width") == k, _shingles("w", k)).otherwise(a), widths, F.array().cast("array<long>"))
    placed = keep(both.select("row", "doc_id", "width", "words", "ats", every.alias("hs"))).repartition(n, "row")
    sized = placed.join(F.broadcast(kinds), "width")  # a row for each different item size
    # A window that would run over the text's end is the last one.
    starts = F.array_distinct(F.transform("ats", lambda a: F.greatest(F.lit(0), F.least(a, F.size("hs") - F.col("total")))))
    opened = sized.select("row", "width", "total", "hs", F.explode(starts).alias("start"))
    windows = opened.select("row", "width", "total", "start", F.explode(F.slice("hs", F.col("start") + 1, F.col("total"))).alias("h"))
    prints = _fingerprints(windows, ["row", "width", "total", "start"], longest)
    found = keep(_candidates(prints, _fingerprints(items, ["item", "width", "total"], longest), radius, most))

    # Exact similarity at the found windows and at those around them.
    pairs = found.groupBy("row", "item").agg(F.collect_set("start").alias("found")).join(items.select("item", "item_id", "width", "total").distinct(), "item")
    near = F.filter(starts, lambda at: F.exists("found", lambda x: F.abs(at - x) <= F.col("total")))
    compared = pairs.join(placed, ["row", "width"]).select("row", "doc_id", "item", "item_id", "width", "total", "hs", F.explode(near).alias("at"))
    compared = compared.select("row", "doc_id", "item", "item_id", "width", "total", "at", F.explode(F.slice("hs", F.col("at") + 1, F.col("total"))).alias("h"))
    own = compared.groupBy("row", "doc_id", "item", "item_id", "width", "total", "at", "h").agg(F.count("*").cast("int").alias("times"))
    own = _near(own, items.select("item", "h", F.col("times").alias("item_times")), ["item", "h"], "left", most)
    exact = own.groupBy("row", "doc_id", "item", "item_id", "width", "total", "at").agg(
        F.sum("times").alias("own"), F.sum(F.least("times", F.coalesce("item_times", F.lit(0)))).alias("common"))
    best = exact.withColumn("similarity", F.col("common") / (F.col("own") + F.col("total") - F.col("common"))).where(F.col("similarity") >= threshold)
    top = F.struct("similarity", -F.col("at"))
    return best.groupBy("row", "doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max_by("at", top).alias("start"), F.max_by(F.col("total") + F.col("width") - 1, top).alias("size"),
    ).select("row", "doc_id", "item_id", "similarity", "start", "size")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, most: int = 500_000) -> DataFrame:
    """The rows of ``docs``, all columns, that match no benchmark item; see :func:`matches`."""
    row = free("row", docs.columns)
    leaks = matches(docs, benchmark, threshold, radius, most).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, _row()).join(leaks, row, "left_anti").drop(row)
