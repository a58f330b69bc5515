"""Repeated line runs by a suffix array over line ids (DataFrame functions only).

Every line has an id, and a document is the sequence of its ids. The suffix
array is built by prefix doubling: a rank orders all suffixes by their first h
lines, and the pairs (rank here, rank h lines on) order them by their first 2h.
Ranks of one round are the positions of the distinct pairs after a range sort,
so they keep the order and no task sees more than its share. A suffix whose
first h lines are like no other's has its final place; only those that share
their prefix go on, and doubling ends when none is left.

The ranks of all rounds then give the longest common prefixes. An interval of
the suffix array holds suffixes with a common prefix of some length; going down
from the longest round, each interval is cut by the next lines' ranks at 2^k
lines into intervals of a longer common prefix. A suffix that is not the first
of its interval, in the order of the corpus, is a copy for that many lines and
goes on into the longer interval. The first one, which stands for all of them,
goes on as their source, and stays as a suffix of the shorter interval, where an
earlier one may be. So after all rounds each suffix has the exact length of the
longest run of lines that starts with it and also starts earlier, and the first
place where it does. Runs that lie in no longer one are maximal, and their lines
are the later copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, free, keep

MIN_RUN = 2
MIN_WORDS = 8  # a single line of so many words is a run of its own
BREAK = "\n"
_BLANK = "\t\n\x0b\x0c\r "
_LAST = (1 << 63) - 1


def _row():
    """Identity of a row: equal rows, same doc_id and text, are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.col("text"))


def _sequence():
    """Non-blank lines of a text as structs (at, line): index in the text and trimmed line."""
    trimmed = F.transform(F.split("text", BREAK), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_BLANK)).alias("line")))
    return F.filter(trimmed, lambda x: x["line"] != "")


def line_ids(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc, place, long, x, y) of each non-blank line.

    White space at a line's ends does not count. Blank lines have no place in
    the sequence: they are no part of a run and do not break one. ``long`` marks
    lines of ``min_words`` words or more; ``doc`` is the doc_id, a null one last.
    """
    lines = docs.where(F.col("text").isNotNull()).select(
        _row().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.posexplode(_sequence()).alias("place", "line"))
    # Words are counted only in lines with room for so many.
    words = F.size(F.split("line.line", r"[\x09-\x0D\x20]+"))
    long = F.when(F.length("line.line") >= 2 * min_words - 1, words >= min_words).otherwise(F.lit(False))
    return lines.select("row", "doc", "place", long.alias("long"), F.xxhash64("line.line").alias("x"), F.xxhash64(F.lit("second"), "line.line").alias("y"))


def _ranked(suffixes: DataFrame) -> DataFrame:
    """Replace (x, y) by the rank of the pair, for suffixes whose pair some other suffix has too.

    The distinct shared pairs are range-sorted, and the position is the rank, so ranks keep the order.
    """
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = suffixes.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ranks = keep(shared.repartitionByRange(parts, "x", "y").sortWithinPartitions("x", "y").withColumn("rank", F.monotonically_increasing_id()))
    ranked = keep(suffixes.join(ranks, ["x", "y"]).drop("x", "y"))
    drop(ranks)
    return ranked


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS) -> list[DataFrame]:
    """For k = 0, 1, ... (row, place, rank) of each suffix that shares its first 2^k lines with another; the first also has doc and long.

    Suffixes of equal rank are one interval of the suffix array, and ranks keep
    its order. The list ends where no two suffixes share so many lines.
    """
    lines = keep(line_ids(docs, min_words).dropDuplicates(["row", "place"]))
    out = [_ranked(lines)]
    drop(lines)
    while not out[-1].isEmpty():
        half = out[-1].select("row", "place", "rank")
        later = half.select("row", (F.col("place") - (1 << (len(out) - 1))).alias("place"), F.col("rank").alias("y"))
        out.append(_ranked(half.withColumnRenamed("rank", "x").join(later, ["row", "place"])))
    drop(out.pop())
    return out


_HERE = "struct<doc:bigint,row:bigint,place:int>"


def copied_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, place, lines, source) of each suffix whose longest run that also starts earlier has ``min_run`` lines, or begins with a long line.

    ``source`` (doc, row, place) is the first place in the corpus where the same
    ``lines`` lines start: in a document with a smaller doc_id, or earlier in the same one.
    """
    ranks = suffix_ranks(docs, min_words)
    if not ranks:
        return docs.sparkSession.createDataFrame([], f"row long, place int, lines int, source {_HERE}")
    # State of a suffix: the interval it is in (group), its common prefix (lines) and the interval's first suffix (source).
    # Runs of fewer than min_run lines do not count unless their line is long, so the others need not be followed.
    base = ranks[0].select("row", "doc", "place", "long")
    state = base
    if min_run > 1:
        enough = ranks[min(len(ranks), min_run.bit_length()) - 1].select("row", "place", F.lit(True).alias("enough"))
        state = base.join(enough, ["row", "place"], "left").where("long OR enough")
    state = keep(state.select("row", "doc", "place", F.lit(0).alias("lines"), F.lit(0).cast("long").alias("group"), F.lit(None).cast(_HERE).alias("source")))
    here = F.struct("doc", "row", "place")
    for k in range(len(ranks) - 1, -1, -1):
        ahead = ranks[k].select("row", F.col("place").alias("ahead"), "rank")
        # A suffix that shares no 2^k lines more with any other gets a rank of its own, below zero, and stays as it is.
        alone = -1 - F.pmod(F.xxhash64("row", "place", "lines"), F.lit(1 << 62))
        seen = keep(state.withColumn("ahead", F.col("place") + F.col("lines")).join(ahead, ["row", "ahead"], "left").drop("ahead").withColumn("rank", F.coalesce("rank", alone)))
        first = keep(seen.where("rank >= 0").groupBy("group", "rank").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
        both = seen.join(first, ["group", "rank"], "left")
        stays = F.struct("lines", "group", "source")
        goes = F.struct((F.col("lines") + (1 << k)).alias("lines"), F.xxhash64("group", "rank", F.lit(k)).alias("group"), F.col("first").alias("source"))
        moves = F.when(F.col("first").isNull(), F.array(stays)).when(F.col("first") == here, F.array(stays, goes)).otherwise(F.array(goes))
        after = keep(both.select("row", "doc", "place", F.explode(moves).alias("s")).select("row", "doc", "place", "s.*"))
        for old in (state, seen, first, *ranks[max(1, k) : k + 1]):
            drop(old)
        state = after
    # As a source a suffix is the first of its interval; what is left is its own longest copy.
    best = state.where(F.col("source").isNotNull() & (F.col("source") != here)).groupBy("row", "place").agg(F.max(F.struct("lines", "source")).alias("s"))
    best = best.select("row", "place", F.col("s.lines").alias("lines"), F.col("s.source").alias("source"))
    if min_run > 1:
        best = best.join(base.where("long").select("row", "place", "long"), ["row", "place"], "left").where((F.col("lines") >= min_run) | F.col("long")).withColumn("lines", F.when(F.col("lines") >= min_run, F.col("lines")).otherwise(1)).drop("long")
    return keep(best)


def maximal_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Those of :func:`copied_runs` that lie in no other run of their document."""
    end = F.col("place") + F.col("lines")
    before = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    runs = copied_runs(docs, min_run, min_words)
    return runs.withColumn("reach", F.max(end).over(before)).where(F.col("reach").isNull() | (end > F.col("reach"))).drop("reach")


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated line runs cut from ``text``, and n_lines, n_deleted, runs.

    A run is a copy if it also starts earlier, in a document with a smaller
    doc_id (null last) or earlier in its own, and has ``min_run`` lines or more;
    a single line of ``min_words`` words or more is a run too. ``runs`` has the
    maximal ones as structs (start, lines, source_doc, source_start), in order;
    starts count non-blank lines from 0, source_doc is null for rows without
    doc_id. n_lines counts non-blank lines, n_deleted those in runs.

    Rows equal in doc_id and text are one document and are cut alike; different
    texts under one doc_id are ordered by a hash. A text without copies stays as
    it is to the byte; a null text stays null with 0 lines and no runs. An input
    column named n_lines, n_deleted or runs is replaced; all others stay.
    """
    found = maximal_runs(docs.select("doc_id", "text"), min_run, min_words)
    doc = F.when(F.col("source.doc") != _LAST, F.col("source.doc"))
    per_row = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("start"), "lines", doc.alias("source_doc"), F.col("source.place").alias("source_start")))).alias("runs"))
    results = ["n_lines", "n_deleted", "runs"]
    base = docs.drop(*results)
    row, runs = free("row", base.columns), free("found", base.columns)
    at, gone = free("at", base.columns), free("gone", base.columns)
    named = base.withColumn(row, _row()).join(keep(per_row).toDF(row, runs), row, "left")
    places = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1))))
    named = named.withColumn(at, F.when(F.col("text").isNotNull(), F.transform(_sequence(), lambda x: x["at"])))
    named = named.withColumn(gone, F.transform(places, lambda p: F.get(F.col(at), p)))
    cut = F.array_join(F.filter(F.split("text", BREAK), lambda x, i: ~F.array_contains(gone, i)), BREAK)
    columns = [F.when(F.col(runs).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns]
    none = F.array().cast("array<struct<start:int,lines:int,source_doc:bigint,source_start:int>>")
    return named.select(
        *columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(at)).cast("long").alias("n_lines"),
        F.when(F.col(runs).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_deleted"), F.coalesce(runs, none).alias("runs"),
    )
