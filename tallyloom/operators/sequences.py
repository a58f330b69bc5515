"""Consecutive-site patterns of molecules: codes, entropy, discordance, pair association."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_codes(df: DataFrame, by: Sequence[str], order: Sequence[str], index: str, state: str, length: int = 4, base: int = 3) -> DataFrame:
    """(by, index, code) of each run of ``length`` consecutive indices without a missing state; code is base-``base``."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df
    for k in range(1, length):
        d = d.withColumn(f"_i{k}", F.lead(index, k).over(w)).withColumn(f"_s{k}", F.lead(state, k).over(w))
    ok = (F.col(f"_i{length - 1}") - F.col(index) == length - 1) & F.col(state).isNotNull()
    code = F.col(state) * base ** (length - 1)
    for k in range(1, length):
        ok = ok & F.col(f"_s{k}").isNotNull()
        code = code + F.col(f"_s{k}") * base ** (length - 1 - k)
    return d.where(ok).select(*by, F.col(index).alias("index"), code.cast("int").alias("code"))


def _digit(code: str, k: int, base: int = 3):
    return F.pmod(F.floor(F.col(code) / base**k), F.lit(base))


def pattern_metrics(df: DataFrame, by: Sequence[str], code: str = "code", n: str = "n") -> DataFrame:
    """From counts of four-site ternary codes (0 none, 1 and 2 two kinds): depth, discordance, entropies, composition.

    pdr is the share of molecules with both empty and filled sites;
    binary_entropy (bits / 4) is over the 16 on/off patterns, three_state_entropy
    (bits / log2 81) over all 81, delta_entropy their difference, hidden_bits the
    unscaled one. one_only, two_only and mixed split pdr by the kinds present,
    full_mixed has all sites filled with both. top2_share and
    discordant_entropy (over ln 14) are of the 14 discordant on/off patterns.
    pdr_excess is pdr less its value for independent sites. 0 log 0 is 0.
    """
    digits = [_digit(code, k) for k in range(4)]
    on = [F.when(d > 0, 1).otherwise(0) for d in digits]
    filled = on[0] + on[1] + on[2] + on[3]
    has = lambda v: (digits[0] == v) | (digits[1] == v) | (digits[2] == v) | (digits[3] == v)
    d = df.groupBy(*by, code).agg(F.sum(n).alias("n"))
    d = d.withColumn("binary", on[0] + on[1] * 2 + on[2] * 4 + on[3] * 8).withColumn("filled", filled)
    d = d.withColumn("one", has(1)).withColumn("two", has(2)).withColumn("some", (F.col("filled") > 0) & (F.col("filled") < 4))
    w = Window.partitionBy(*by)
    d = d.withColumn("depth", F.sum("n").over(w)).withColumn("nb", F.sum("n").over(Window.partitionBy(*by, "binary")))
    d = d.withColumn("lead", F.row_number().over(Window.partitionBy(*by, "binary").orderBy(code)) == 1)
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.first("depth")
    p = [F.sum(F.col("n") * o) / F.first("depth") for o in on]
    p3, p2 = F.col("n") / F.col("depth"), F.col("nb") / F.col("depth")
    out = d.groupBy(*by).agg(
        F.first("depth").alias("depth"), share(F.col("some")).alias("pdr"),
        (-F.sum(p3 * F.log2(p3))).alias("h3"), (-F.sum(p3 * F.log2(p2))).alias("h2"),
        share(F.col("some") & F.col("one") & ~F.col("two")).alias("one_only"),
        share(F.col("some") & F.col("two") & ~F.col("one")).alias("two_only"),
        share(F.col("some") & F.col("one") & F.col("two")).alias("mixed"),
        share((F.col("filled") == 4) & F.col("one") & F.col("two")).alias("full_mixed"),
        F.sort_array(F.collect_list(F.when(F.col("some") & F.col("lead"), F.col("nb"))), asc=False).alias("groups"),  # at most 14
        *(x.alias(f"p{k}") for k, x in enumerate(p)),
    )
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda x: x / F.col("discordant")
    out = out.withColumn("discordant", total)
    top2 = F.aggregate(F.slice("groups", 1, 2), F.lit(0).cast("long"), lambda a, x: a + x)
    entropy = F.aggregate("groups", F.lit(0.0), lambda a, x: a - part(x) * F.log(part(x))) / math.log(14)
    alone = F.lit(1.0) - F.col("p0") * F.col("p1") * F.col("p2") * F.col("p3") - (1 - F.col("p0")) * (1 - F.col("p1")) * (1 - F.col("p2")) * (1 - F.col("p3"))
    return out.select(
        *by, "depth", "pdr", (F.col("h2") / 4).alias("binary_entropy"), (F.col("h3") / math.log2(81)).alias("three_state_entropy"),
        (F.col("h3") / math.log2(81) - F.col("h2") / 4).alias("delta_entropy"), (F.col("h3") - F.col("h2")).alias("hidden_bits"),
        "one_only", "two_only", "mixed", "full_mixed",
        F.when(F.col("discordant") > 0, top2 / F.col("discordant")).otherwise(0.0).alias("top2_share"),
        F.when(F.col("discordant") > 0, entropy).otherwise(0.0).alias("discordant_entropy"), (F.col("pdr") - alone).alias("pdr_excess"),
    )


def rarefaction_parts(pairs: DataFrame, depth: int) -> DataFrame:
    """(total, n, part) for distinct (total, n): expected -p log2 p of a pattern seen n of total times in a draw of ``depth``.

    Hypergeometric without replacement, from log factorials. Far fewer pairs
    than counts exist, so this is a lookup table made for the data at hand.
    """

    def run(batches):
        ln = math.lgamma
        choose = lambda a, b: ln(a + 1) - ln(b + 1) - ln(a - b + 1)
        for pdf in batches:
            parts = []
            for total, n in zip(pdf["total"].tolist(), pdf["n"].tolist()):
                part = 0.0
                for k in range(max(1, depth - (total - n)), min(n, depth) + 1):
                    p = math.exp(choose(n, k) + choose(total - n, depth - k) - choose(total, depth))
                    part -= p * (k / depth) * math.log2(k / depth)
                parts.append(part)
            yield pdf.assign(part=parts)

    return pairs.select("total", "n").distinct().mapInPandas(run, "total long, n long, part double")


def rarefied_entropy(counts: DataFrame, by: Sequence[str], code: str, n: str, depth: int) -> DataFrame:
    """Expected entropy (bits) of the pattern counts at a common depth; groups under it have none."""
    d = counts.withColumn("total", F.sum(n).over(Window.partitionBy(*by))).withColumnRenamed(n, "n").where(F.col("total") >= depth)
    joined = d.join(rarefaction_parts(d, depth), ["total", "n"])
    return joined.groupBy(*by).agg(F.max("total").alias("total"), F.sum("part").alias("entropy"))


def pair_counts(df: DataFrame, by: Sequence[str], molecule: str, site: str, value: str) -> DataFrame:
    """(by, i, j, n, a, b, ab) over all site pairs i < j of complete molecules, value 0/1; null is missing.

    A molecule's sites meet in one array, so the pairs are made inside a row and
    only counts are exchanged; there is no self join on the site.
    """
    sites = df.where(F.col(value).isNotNull()).groupBy(*by, molecule).agg(F.sort_array(F.collect_list(F.struct(F.col(site).alias("s"), F.col(value).alias("v")))).alias("_x"))
    first = sites.select(*by, F.posexplode("_x").alias("_k", "_p"), "_x")
    pairs = first.select(*by, "_p", F.explode(F.slice("_x", F.col("_k") + 2, F.size("_x"))).alias("_q")).where("_p.s < _q.s")
    return pairs.groupBy(*by, F.col("_p.s").alias("i"), F.col("_q.s").alias("j")).agg(
        F.count("*").alias("n"), F.sum("_p.v").alias("a"), F.sum("_q.v").alias("b"), F.sum(F.col("_p.v") * F.col("_q.v")).alias("ab"))


def covariance_phi(pairs: DataFrame, least: int = 12) -> DataFrame:
    """Add covariance (percent points, small-sample scaled) and phi; null under ``least`` molecules, phi null without variance."""
    p, q, r = F.col("a") / F.col("n"), F.col("b") / F.col("n"), F.col("ab") / F.col("n")
    v = r - p * q
    enough = F.col("n") >= least
    scale = F.try_divide(F.col("n").cast("double"), F.col("n") - 1) * F.lit(11.0 / 12.0 * 100.0)
    spread = F.sqrt(p * (1 - p) * q * (1 - q))
    return pairs.withColumn("covariance", F.when(enough, v * scale)).withColumn("phi", F.when(enough, F.try_divide(v, spread)))


def site_blocks(df: DataFrame, by: Sequence[str], site: str, size: int = 3, most: int = 12) -> DataFrame:
    """Non-overlapping blocks of ``size`` sites, at most ``most`` evenly spread: (by, block, sites)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(site)) - 1
    blocks = df.select(*by, site).distinct().withColumn("_n", n).withColumn("block", F.floor(F.col("_n") / size))
    blocks = blocks.groupBy(*by, "block").agg(F.sort_array(F.collect_list(site)).alias("sites")).where(F.size("sites") == size)
    blocks = blocks.withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    k = F.least(F.col("_m"), F.lit(most))
    spots = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.when(k > 1, F.rint(i * (F.col("_m") - 1) / F.greatest(k - 1, F.lit(1)))).otherwise(0.0).cast("bigint"))
    return blocks.where(F.array_contains(spots, F.col("block"))).drop("_m")


def quartets(df: DataFrame, by: Sequence[str], pos: str) -> DataFrame:
    """(by, first, midpoint, span) of every four neighbouring places; a place is two bases wide."""
    last = F.lead(pos, 3).over(Window.partitionBy(*by).orderBy(pos))
    d = df.select(*by, F.col(pos).alias("first"), last.alias("_last")).where("_last IS NOT NULL")
    return d.select(*by, "first", F.floor((F.col("first") + F.col("_last")) / 2).alias("midpoint"), (F.col("_last") - F.col("first") + 2).alias("span"))


def pair_metrics(df: DataFrame, by: Sequence[str], molecule: str, one: str, two: str, n: int = 12, repeats: int = 64, least: int = 3, valid: int = 32, seed: str = "phi") -> DataFrame:
    """Association of two sites' states (0, 1, 2) over the molecules that know both.

    by, molecules, one, two (shares of state 2), joint_excess (percentage points,
    at ``n`` molecules), phi and phi_valid, h_minus_m (covariance of +1 for state
    2 and -1 for state 1). phi is the mean over those of ``repeats`` subsamples of
    ``n`` molecules in which both sites vary, if ``valid`` of them do and each site
    has ``least`` molecules with and without state 2.
    """
    from .resampling import subsample

    sign = lambda c: F.when(F.col(c) == 2, 1).when(F.col(c) == 1, -1).otherwise(0)
    d = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).select(*by, molecule, (F.col(one) == 2).cast("int").alias("_a"), (F.col(two) == 2).cast("int").alias("_b"), sign(one).alias("_s"), sign(two).alias("_t"))
    k, a, b, ab = F.count("*"), F.avg("_a"), F.avg("_b"), F.avg(F.col("_a") * F.col("_b"))
    whole = d.groupBy(*by).agg(
        k.alias("molecules"), a.alias("one"), b.alias("two"), F.when(k > 1, (ab - a * b) * k / F.when(k > 1, k - 1) * ((n - 1) / n * 100)).alias("joint_excess"),
        F.least(F.sum("_a"), F.sum("_b"), k - F.sum("_a"), k - F.sum("_b")).alias("_least"), (F.covar_samp("_s", "_t") * ((n - 1) / n)).alias("h_minus_m"))
    drawn = subsample(d, by, molecule, n, repeats, seed).groupBy(*by, "rep").agg(F.count("*").alias("_n"), a.alias("_x"), b.alias("_y"), ab.alias("_xy")).where(F.col("_n") == n)
    spread = F.col("_x") * (1 - F.col("_x")) * F.col("_y") * (1 - F.col("_y"))
    phis = drawn.where(spread > 0).groupBy(*by).agg(F.avg((F.col("_xy") - F.col("_x") * F.col("_y")) / F.sqrt(spread)).alias("_phi"), F.count("*").alias("_valid"))
    eligible = F.col("_least") >= least
    found = F.when(eligible, F.coalesce("_valid", F.lit(0).cast("long"))).otherwise(0)
    return whole.join(phis, list(by), "left").select(*by, "molecules", "one", "two", "joint_excess", F.when(eligible & (F.col("_valid") >= valid), F.col("_phi")).alias("phi"), found.alias("phi_valid"), "h_minus_m")
