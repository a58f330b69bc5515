"""Half-open intervals [start, end): overlap joins, merging, masks, densities, precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], start: str = "start", end: str = "end", bin_size: int = 1000, how: str = "inner") -> DataFrame:
    """Pairs with left.start < right.end and left.end > right.start and equal ``on`` columns.

    Both sides are dealt to the bins they touch, so the join is an equi join on
    (keys, bin). A pair that shares several bins is taken in the first of them
    only, so nothing is listed twice and no distinct is needed. Right columns
    get the prefix ``r_``. Choose ``bin_size`` near the usual interval length.
    Empty intervals overlap nothing. ``how`` is inner, left_semi or left_anti
    (the last two need a unique ``_id`` column in left).
    """
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))
    r = right.where(F.col(end) > F.col(start)).select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("_bin", F.explode(bins(f"r_{start}", f"r_{end}")))
    l = left.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins(start, end)))  # noqa: E741
    keys = [l[c] == r[f"r_{c}"] for c in on] + [l["_bin"] == r["_bin"]]
    hit = (F.col(start) < F.col(f"r_{end}")) & (F.col(end) > F.col(f"r_{start}"))
    first = l["_bin"] == F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / bin_size)
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    pairs = l.join(r, cond & hit & first, "inner").drop("_bin")
    if how == "inner":
        return pairs
    return left.join(pairs.select("_id").distinct(), "_id", how)


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: Sequence[str], pos: str, start: str = "start", end: str = "end", bin_size: int = 1000) -> DataFrame:
    """Points with start <= pos < end of each interval they fall in (a point may fall in many). Interval columns keep their names."""
    i = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    p = points.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    return p.join(i, [*on, "_bin"]).where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_bin")


def overlap_length(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(e1), F.col(e2)) - F.greatest(F.col(s1), F.col(s2)))


def clusters(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", order: Sequence[str] = (), touching: bool = True) -> DataFrame:
    """Merge overlapping (and touching, if set) intervals: by, start, end, members."""
    w = Window.partitionBy(*by).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | ((F.col(start) > reach) if touching else (F.col(start) >= reach)), 1).otherwise(0)
    marked = df.withColumn("_new", new)
    marked = marked.withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_cluster").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_cluster")


def union_length(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Length of the union, each interval clipped to [low, high) first."""
    s = F.greatest(F.col(start), low) if low is not None else F.col(start)
    e = F.least(F.col(end), high) if high is not None else F.col(end)
    clipped = df.withColumn("_s", s).withColumn("_e", e).where("_e > _s")
    merged = clusters(clipped.select(*by, F.col("_s").alias(start), F.col("_e").alias(end)), by, start, end)
    return merged.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("length"))


def coverage(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Sweep line: (by, start, end, depth) pieces of constant positive depth."""
    edges = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.*")
    steps = edges.groupBy(*by, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("pos")
    depth = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("depth", depth).withColumn("end", F.lead("pos").over(w)).where("depth > 0").select(*by, F.col("pos").alias("start"), "end", "depth")


def merge_adjacent(df: DataFrame, by: Sequence[str], place: str, sign: Column, step: int = 1) -> DataFrame:
    """Runs of consecutive places with one sign: by, sign, first, last, n. Rows of sign 0 or null are in no run."""
    d = df.withColumn("_sign", sign).where("_sign <> 0")
    w = Window.partitionBy(*by).orderBy(place)
    new = F.when((F.col(place) - F.lag(place).over(w) == step) & (F.col("_sign") == F.lag("_sign").over(w)), 0).otherwise(1)
    d = d.withColumn("_new", new)
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_run", "_sign").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).drop("_run").withColumnRenamed("_sign", "sign")


def overlay(points: DataFrame, layers: DataFrame, on: Sequence[str], pos: str, key: Sequence[str], priority: str, label: str, default: str, bin_size: int = 1000) -> DataFrame:
    """Label of the covering interval with the least ``priority``; ``default`` where none covers."""
    hit = points_in_intervals(points.select(*key, *[c for c in (*on, pos) if c not in key]), layers, on, pos, bin_size=bin_size)
    best = hit.groupBy(*key).agg(F.min_by(label, F.struct(priority, label)).alias("label"))
    return points.join(best, list(key), "left").withColumn("label", F.coalesce("label", F.lit(default)))


def promoter(start: str, end: str, strand: str, length: str, up: int = 2000, down: int = 500) -> tuple[Column, Column]:
    """Strand-aware window around the transcript start, clipped to [0, length]."""
    plus = F.col(strand) == "+"
    low = F.when(plus, F.col(start) - up).otherwise(F.col(end) - down)
    high = F.when(plus, F.col(start) + down).otherwise(F.col(end) + up)
    return F.greatest(F.lit(0), low), F.least(F.col(length), high)


def local_density(anchors: DataFrame, points: DataFrame, on: Sequence[str], anchor: str, pos: str, radius: int) -> DataFrame:
    """Number of points within ``radius`` of each anchor, both ends included: a range join by bins of the radius."""
    a = anchors.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(anchor) - radius) / radius), F.floor((F.col(anchor) + radius) / radius))))
    p = points.select(*on, F.col(pos).alias("_pos")).withColumn("_bin", F.floor(F.col("_pos") / radius))
    hit = a.join(p, [*on, "_bin"], "left")
    near = F.count_if(F.abs(F.col("_pos") - F.col(anchor)) <= radius)
    return hit.groupBy(*anchors.columns).agg(near.alias("density"))
