"""Ranks, false-discovery control, ordered picks, keyed subsets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import draw_order


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties share their mean; nulls have none."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*by, known)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, known, F.col(value))) - 1) / F.lit(2.0)
    return df.withColumn(name, F.when(known, rank.cast("double")))


def bh(df: DataFrame, by: Sequence[str], p: str, name: str = "q", policy: str = "exclude", family: int | None = None) -> DataFrame:
    """Benjamini-Hochberg q values in each family.

    policy for null p: 'exclude' (null q, not in n), 'count' (null q, in n),
    'one' (treated as p = 1). ``family`` fixes n instead of counting it.
    """
    value = F.coalesce(F.col(p), F.lit(1.0)) if policy == "one" else F.col(p)
    d = df.withColumn("_p", value.cast("double"))
    known = F.col("_p").isNotNull()
    everything = Window.partitionBy(*by)
    n = F.lit(family) if family else (F.count("_p").over(everything) if policy == "exclude" else F.count("*").over(everything))
    # The largest rank among ties gives the least quotient, which the running minimum would reach anyway.
    rank = F.rank().over(Window.partitionBy(*by, known).orderBy("_p")) + F.count("*").over(Window.partitionBy(*by, known, "_p")) - 1
    d = d.withColumn("_x", F.when(known, F.col("_p") * n / rank))
    down = Window.partitionBy(*by).orderBy(F.col("_p").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.when(known, F.least(F.lit(1.0), F.min("_x").over(down)))).drop("_p", "_x")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def keyed_subset(df: DataFrame, by: Sequence[str], key: Sequence[Column], k: int) -> DataFrame:
    """``k`` rows of each stratum in the order of a digest of ``key``: the same rows on every run and engine."""
    return top_k(df, by, [draw_order(*key)], k)


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Median of rows that stand for ``weight`` (a whole number) equal ones: with an even total the mean of the two in the middle.

    Null values and rows without weight do not count.
    """
    upto = F.sum(weight).over(Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*by))
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("_u", upto).withColumn("_t", total).where(F.col("_u") * 2 >= F.col("_t"))
    upper = F.min(F.when(F.col("_u") * 2 >= F.col("_t") + 1, F.col(value)))
    return d.groupBy(*by).agg(((F.min(value) + upper) / 2).alias("weighted_median"))


def local_minima(df: DataFrame, by: Sequence[str], x: str, y: str, value: str) -> DataFrame:
    """Cells of a grid that are least in their 3 x 3 neighbourhood: two range windows, no self join."""
    rows = Window.partitionBy(*by, y).orderBy(x).rangeBetween(-1, 1)
    d = df.withColumn("_m", F.min(value).over(rows))
    cols = Window.partitionBy(*by, x).orderBy(y).rangeBetween(-1, 1)
    return d.withColumn("_m", F.min("_m").over(cols)).where(F.col(value) == F.col("_m")).drop("_m")


def greedy_spaced(df: DataFrame, by: Sequence[str], rank: str, place: str, apart: float, most: int, shortlist: int | None = None) -> DataFrame:
    """In rank order take a row if it is at least ``apart`` from all taken before, up to ``most``.

    The choice is sequential, so each group's ranked list goes to one task; groups
    must be short, or ``shortlist`` rows of each are ranked first.
    """
    d = top_k(df, by, [F.col(rank)], shortlist) if shortlist else df

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[float] = []
        rows = []
        for i, p in pdf.sort_values(rank)[place].items():
            if len(taken) == most:
                break
            if all(abs(p - t) >= apart for t in taken):
                taken.append(p)
                rows.append(i)
        return pdf.loc[rows].assign(pick=range(1, len(rows) + 1))

    return d.groupBy(*by).applyInPandas(pick, StructType([*d.schema.fields]).add("pick", "long"))
