"""From reads and calls to counts: rejection, deduplication, states, support, equal-weight means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reject(df: DataFrame, rules: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Add ``reason``: the name of the first rule that holds, in order, else ``kept``. A null rule does not hold."""
    reason = F.lit(kept)
    for name, rule in reversed(rules):
        reason = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def mark_repeats(df: DataFrame, keys: Sequence[str], order: Sequence, among: Column, name: str = "duplicate") -> DataFrame:
    """Rows where ``among`` holds and an earlier such row has the same keys get reason ``name``."""
    first = F.row_number().over(Window.partitionBy(*keys, among.alias("_among")).orderBy(*order))
    return df.withColumn("_n", first).withColumn("reason", F.when(among & (F.col("_n") > 1), F.lit(name)).otherwise(F.col("reason"))).drop("_n")


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in a total order, over all files of a sample."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def reason_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "reason").agg(F.count("*").alias("n"))


def end_trim(df: DataFrame, place: str, length: str, margin: int = 100) -> DataFrame:
    return df.where((F.col(place) >= margin) & (F.col(place) < F.col(length) - margin))


def guard_sum(df: DataFrame, one: str, two: str, most: int = 256) -> DataFrame:
    """Fail if two quantised probabilities add up to more than ``most``."""
    bad = F.col(one) + F.col(two) > most
    return df.withColumn(one, F.when(bad, F.raise_error(F.lit(f"{one} + {two} is over {most}")).cast("int")).otherwise(F.col(one)))


def state_counts(df: DataFrame, by: Sequence[str], state: str, names: dict) -> DataFrame:
    """One count column for each state value; one exchange on ``by``, combined before it."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(state) == value).alias(name) for name, value in names.items()))


def threshold_counts(df: DataFrame, by: Sequence[str], confidence: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts of rows at or above each threshold. Rows are counted once per threshold group, not copied first."""
    flags = [F.count_if(F.col(confidence) >= t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    wide = df.groupBy(*by).agg(*flags)
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n")) for i, t in enumerate(thresholds)))
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, "p.threshold", "p.n").where("n > 0")


def common_support(df: DataFrame, site: str, sample: str, depth: Column, least: int, n_samples: int | Column) -> DataFrame:
    """Sites with at least ``least`` depth in every sample; a sample without the site counts as 0. One row per (site, sample) in."""
    n = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    return df.groupBy(site).agg(F.count_if(depth >= least).alias("_ok")).where(F.col("_ok") == n).drop("_ok")


def percents(df: DataFrame, counts: Sequence[str], out: Sequence[str], total: Column) -> DataFrame:
    """``out[i]`` = 100 * counts[i] / total, null where the total is 0."""
    return df.withColumns({o: F.try_divide(F.col(c) * F.lit(100.0), total.cast("double")) for c, o in zip(counts, out)})


def equal_weight_mean(df: DataFrame, by: Sequence[str], values: Sequence[str], least: int = 1) -> DataFrame:
    """Mean of per-site values, every site with the same weight whatever its depth; groups under ``least`` sites go."""
    means = [F.avg(v).alias(v) for v in values]
    return df.groupBy(*by).agg(F.count("*").alias("n_sites"), *means).where(F.col("n_sites") >= least)


def cigar_blocks(df: DataFrame, key: Sequence[str], cigar: str, start: str) -> DataFrame:
    """Aligned blocks (query_start, ref_start, length) of reads from an array of struct<op, len>.

    M, = and X move along read and reference, I and S along the read, D and N
    along the reference.
    """
    both, read, ref = F.col("c.op").isin("M", "=", "X"), F.col("c.op").isin("M", "=", "X", "I", "S"), F.col("c.op").isin("M", "=", "X", "D", "N")
    before = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    ops = df.select(*key, start, F.posexplode(cigar).alias("_i", "c"))
    ops = ops.withColumn("query_start", F.coalesce(F.sum(F.when(read, F.col("c.len")).otherwise(0)).over(before), F.lit(0)))
    ops = ops.withColumn("ref_start", F.col(start) + F.coalesce(F.sum(F.when(ref, F.col("c.len")).otherwise(0)).over(before), F.lit(0)))
    return ops.where(both).select(*key, "query_start", "ref_start", F.col("c.len").alias("length"))


def sites_in_blocks(blocks: DataFrame, sites: DataFrame, key: Sequence[str], pos: str, reverse: str | None = None, bin_size: int = 1000) -> DataFrame:
    """Read place of each reference site inside an aligned block; on the reverse strand the base one on.

    Blocks and sites must share a column, the contig; blocks are dealt to bins of positions, so the join is an equi join.
    """
    shift = F.col(reverse).cast("int") if reverse else F.lit(0)
    at = F.col(pos) + shift
    on = [c for c in sites.columns if c in blocks.columns]
    if not on:
        raise ValueError("blocks and sites share no column, such as the contig, to join on")
    span = blocks.where(F.col("length") > 0).withColumn("_bin", F.explode(F.sequence(F.floor((F.col("ref_start") - shift) / F.lit(bin_size)), F.floor((F.col("ref_start") + F.col("length") - 1 - shift) / F.lit(bin_size)))))
    joined = span.join(sites.withColumn("_bin", F.floor(F.col(pos) / F.lit(bin_size))), [*on, "_bin"]).drop("_bin")
    inside = joined.where((at >= F.col("ref_start")) & (at < F.col("ref_start") + F.col("length")))
    return inside.withColumn("query_place", F.col("query_start") + at - F.col("ref_start"))


def strand_opportunity(df: DataFrame, sequence: str, place: str, reverse: str) -> DataFrame:
    """Add ``opportunity`` and ``intact`` for the read base at the 0-based ``place``.

    An opportunity is a C, on the reverse strand a G; it is intact if its pair is
    there too: a G after it, on the reverse strand a C before it.
    """
    base = lambda shift: F.upper(F.col(sequence)).substr(F.col(place) + 1 + shift, F.lit(1))
    here = F.when(F.col(reverse), base(0) == "G").otherwise(base(0) == "C")
    pair = F.when(F.col(reverse), (F.col(place) > 0) & (base(-1) == "C")).otherwise(base(1) == "G")
    return df.withColumn("opportunity", F.coalesce(here, F.lit(False))).withColumn("intact", F.col("opportunity") & F.coalesce(pair, F.lit(False)))
