"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document of a source is queued in a fixed shuffled order, once per epoch.
Its virtual finish time is the source's cumulative size up to and including it,
divided by the source's target. Serving all queues by finish time and stopping
at the total budget gives each source its share at every point of the sequence.

Both running sums are taken in two levels: rows fall into many even cells, cell
totals are prefix-summed, and only the inside of a cell is a window. So a source
that holds a third of all rows is spread over as many tasks as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, keep


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target of each source: (source, source_size, budget, target); budget is the sum of all sizes.

    ``sizes`` has (source, size). Sources in code point order, null last, weigh
    ``weights`` in turn and share the sum of all sizes; none gets more than
    ``max_epochs`` times its own size, and the excess goes to the others by
    weight. Capped sources are those with the least (cap / weight), so sorting
    by that ratio finds the water level without iterating. One row per source
    takes part in the two windows, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    )
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    # The first source, in ratio order, that the level does not fill is where capping ends.
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.coalesce(F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"], F.lit(float("inf"))))
    return s.select("source", "source_size", F.col("total").alias("budget"), F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target"))


def _running(df: DataFrame, groups: list[str], cell: str, order: list, size: str, name: str) -> DataFrame:
    """Running sum of ``size`` in ``groups`` by (cell, order), in two levels."""
    totals = df.groupBy(*groups, cell).agg(F.sum(size).alias("_cell"))
    upto = Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, cell, F.coalesce(F.sum("_cell").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum(size).over(inside))
        .join(offsets, [*groups, cell])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def cells_for(docs: DataFrame, rows: int = 8192) -> int:
    """A power of sixteen of cells, so that one holds about ``rows`` rows or fewer even if all are of one source."""
    cells = 256
    n = docs.count()
    while cells * rows < n:
        cells *= 16
    return cells


def queue(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", cells: int | None = None) -> DataFrame:
    """All queued (document, epoch) pairs with their finish times: doc_id, mark, copy, source, size,
    source_size, budget, target, epoch, order, finish, begins (the finish time of the document before).

    ``docs`` needs doc_id, text and source; other columns are ignored. A null
    text has size 0 and is served like any other. Repeated rows are queued each
    on their own. The order is a hash of (seed, epoch, doc_id, size), so reruns
    agree. ``cells`` follows the number of rows if not given; it changes no result.
    """
    cells = cells or cells_for(docs)
    d = docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _same().alias("mark"),
    )
    # Rows equal in all columns are told apart by a number.
    d = d.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("_n")).select("doc_id", "source", "size", "mark", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"))
    # A null source would be lost in joins.
    d = d.withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    t = source_targets(d.select("source", "size"), max_epochs, weights).withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    hashed = F.sha2(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")), 256)
    e = (
        d.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs))))
        .withColumn("order", hashed)
        .withColumn("cell", F.concat(F.col("epoch").cast("string"), F.substring("order", 1, len(f"{cells - 1:x}"))))
    )
    e = _running(e, ["_s"], "cell", ["order", "doc_id", "mark", "copy"], "size", "upto")
    return e.join(t, "_s").withColumn("finish", F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(F.lit(0.0))).withColumn("begins", F.when(F.col("target") > 0, (F.col("upto") - F.col("size")) / F.col("target")).otherwise(F.lit(0.0))).drop("_s", "upto", "cell")


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", cells: int | None = None) -> DataFrame:
    """What each document gives to the mix: doc_id, source, size, source_size, target, epochs, taken.

    A source's queue ends with the document that leaves the smaller error of its
    target: one that crosses it is in if at least half of it lies before. Finish
    times are then served in order until the total budget, the sum of all sizes,
    is reached; the document that crosses the budget is in by the same rule. A
    document is served whole or not in an epoch. An empty table gives an empty
    result. Documents that are never served have epochs and taken 0.
    """
    return _mix(docs, max_epochs, weights, seed, cells).drop("mark", "copy")


def _same():
    """Identity of a row: doc_id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    return F.xxhash64(part("doc_id"), F.lit("|"), part("source"), F.lit("|"), part("text"))


def _mix(docs: DataFrame, max_epochs: int, weights: tuple[int, ...], seed: str, cells: int | None) -> DataFrame:
    cells = cells or cells_for(docs)
    q = queue(docs, max_epochs, weights, seed, cells)
    # Finish times run evenly, so equal-width slots of them hold about equal sizes. What is
    # never served adds nothing to the sum and is spread over slots of its own.
    begun = F.col("begins") + F.col("finish") <= 2
    late = F.lit(9 * cells) + F.pmod(F.xxhash64("order"), F.lit(cells))
    q = q.withColumn("slot", F.when(begun, F.floor(F.least(F.col("finish"), F.lit(8.0)) * cells).cast("long")).otherwise(late))
    q = q.withColumn("counted", F.when(begun, F.col("size")).otherwise(F.lit(0)))
    q = _running(q, [], "slot", ["finish", "epoch", "order", "doc_id", "mark", "copy"], "counted", "served")
    q = q.withColumn("in_mix", (2 * F.col("served") - F.col("size") <= 2 * F.col("budget")) & begun)
    return q.groupBy("doc_id", "source", "size", "source_size", "target", "mark", "copy").agg(
        F.count_if("in_mix").alias("epochs"),
        F.sum(F.when(F.col("in_mix"), F.col("size")).otherwise(F.lit(0))).alias("taken"),
    )


def mixed_documents(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", cells: int | None = None) -> DataFrame:
    """The documents of the mix: all columns of ``docs`` with size, source_size, target, epochs and taken, for epochs over 0.

    Rows equal in doc_id, source and text are one document here, with the epochs
    of all of them and the columns that come first as text. An input column named like a result is replaced.
    """
    added = ["size", "source_size", "target", "epochs", "taken"]
    base = docs.drop(*added)
    key, several = free("document", base.columns), free("several", base.columns)
    shares = _mix(base, max_epochs, weights, seed, cells).groupBy("mark").agg(F.count("*").alias(several), *(F.first(c).alias(c) for c in added[:3]), *(F.sum(c).alias(c) for c in added[3:]))
    found = base.withColumn(key, _same()).join(keep(shares.where("epochs > 0").withColumnRenamed("mark", key)), key)
    columns = [F.col(f"`{c}`") for c in base.columns] + [F.col(c) for c in added]
    # The window stands on the join's exchange, so texts are exchanged once.
    order = Window.partitionBy(key).orderBy(F.when(F.col(several) > 1, F.to_json(F.struct(*columns))))
    return found.withColumn(several, F.row_number().over(order)).where(F.col(several) == 1).select(*columns)
