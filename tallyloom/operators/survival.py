"""Proportional hazards over groups of any size: sums over risk sets, Newton's rounds and ordered pairs as Spark aggregates.

A risk set is all rows of a group with the same or a later time. Sums over risk
sets are taken in two levels: the times of a group are cut at its quantiles into
cells; sums run within a cell, and over the few cells of a group. So no task
meets a whole group, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided
from . import statistics
from .rounds import passed_on
from .statistics import STATUS

CELLS = 64
_PIECE = 10_000  # tied deaths that one row's terms go over


def with_cells(df: DataFrame, by: Sequence[str], order: str, cells: int = CELLS) -> DataFrame:
    """Add ``_cell``: the number of the group's quantiles of ``order`` below it."""
    shares = F.array(*(F.lit(k / cells) for k in range(1, cells)))
    bounds = df.groupBy(*by).agg(F.percentile_approx(order, shares, F.lit(20 * cells)).alias("_bounds"))
    return df.join(bounds, list(by)).withColumn("_cell", F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")


def later(df: DataFrame, by: Sequence[str], order: str, values: dict[str, tuple[str, Column]], same: bool) -> DataFrame:
    """(by, _cell, order, values): sums, maxima or minima over the rows of the group that come later, or at the same place too if ``same``.

    ``df`` comes from :func:`with_cells`, by these groups or by larger ones.
    ``values`` maps a name to ("sum", "max" or "min", what is aggregated).
    """
    of = {"sum": F.sum, "max": F.max, "min": F.min}
    place = df.groupBy(*by, "_cell", order).agg(*(of[kind](value).alias(n) for n, (kind, value) in values.items()))
    cell = place.groupBy(*by, "_cell").agg(*(of[kind](n).alias(n) for n, (kind, _) in values.items()))
    after = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.select(*by, "_cell", *(of[kind](n).over(after).alias(f"_{n}") for n, (kind, _) in values.items()))
    within = Window.partitionBy(*by, "_cell").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0 if same else -1)
    place = place.select(*by, "_cell", order, *(of[kind](n).over(within).alias(n) for n, (kind, _) in values.items()))
    both = {
        "sum": lambda n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)),
        "max": lambda n: F.greatest(n, f"_{n}"), "min": lambda n: F.least(n, f"_{n}"),
    }
    return place.join(cell, [*by, "_cell"]).select(*by, "_cell", order, *(both[kind](n).alias(n) for n, (kind, _) in values.items()))


def _likelihood(d: DataFrame, by: Sequence[str], trial: DataFrame) -> DataFrame:
    """(by, t_ll, t_score, t_info) at the coefficient ``trial`` of each group, ties by Efron's method.

    The k-th of a time's d deaths takes k / d of the deaths' own sums off the
    risk set's. Weights are taken relative to the group's largest.
    """
    top = F.greatest(F.col("trial") * F.col("x_low"), F.col("trial") * F.col("x_high"))
    d = d.join(trial, list(by)).withColumn("_top", top).withColumn("_w", F.col("_k") * F.exp(F.col("trial") * F.col("_x") - top))
    dead = F.col("_e") == 1
    sums = {f"s{i}": ("sum", F.col("_w") * F.pow("_x", F.lit(i))) for i in range(3)}
    risk = later(d, by, "_t", sums, same=True)
    own = d.where(dead).groupBy(*by, "_cell", "_t").agg(*(F.sum(v).alias(f"e{n[1]}") for n, (_, v) in sums.items()), F.sum("_k").alias("d"), F.sum(F.col("_k") * F.col("_x")).alias("ex"), F.max("_top").alias("_top"), F.max("trial").alias("trial"))
    at = own.join(risk, [*by, "_cell", "_t"])
    pieces = at.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1, F.lit(_PIECE).cast("long"))))
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread"))

    def add(a: Column, k: Column) -> Column:
        part = k / F.col("d")
        s0, s1, s2 = (F.col(f"s{i}") - part * F.col(f"e{i}") for i in range(3))
        return F.struct((a["log"] + F.log(s0)).alias("log"), (a["mean"] + s1 / s0).alias("mean"), (a["spread"] + s2 / s0 - (s1 / s0) * (s1 / s0)).alias("spread"))

    last = F.least(F.col("d") - 1, F.col("_from") + _PIECE - 1)
    pieces = pieces.withColumn("_sum", F.aggregate(F.sequence(F.col("_from"), last), zero, add))
    whole = F.col("_from") == 0
    per = F.when(whole, F.col("trial") * F.col("ex") - F.col("d") * F.col("_top")).otherwise(0.0)
    return pieces.groupBy(*by).agg(F.sum(per - F.col("_sum.log")).alias("t_ll"), F.sum(F.when(whole, F.col("ex")).otherwise(0.0) - F.col("_sum.mean")).alias("t_score"), F.sum("_sum.spread").alias("t_info"))


def _newton(score: str, info: str) -> Column:
    return F.when(F.col(info) > 0, F.col(score) / F.col(info)).otherwise(F.signum(score))


def _maxima(d: DataFrame, by: Sequence[str], groups: DataFrame, rounds: int, farthest: float) -> DataFrame:
    """(by, beta, ll, ll0, score, info, lost) where each group's likelihood is greatest; ``lost`` if that is beyond ``farthest``.

    The log likelihood is concave. Newton's step points uphill and is halved until
    it does not lead down. One number a round comes to the driver: how many
    groups still move.
    """
    start = groups.select(*by, F.lit(0.0).alias("trial"), "x_low", "x_high")
    state = start.join(_likelihood(d, by, start), list(by))
    state = passed_on(state.select(*by, "x_low", "x_high", F.lit(0.0).alias("beta"), F.col("t_ll").alias("ll"), F.col("t_ll").alias("ll0"), F.col("t_score").alias("score"), F.col("t_info").alias("info"), _newton("t_score", "t_info").alias("step"), F.lit(True).alias("live"), F.lit(False).alias("lost")))
    for _ in range(rounds):
        if not state.where("live").limit(1).count():
            break
        trial = state.where("live").select(*by, (F.col("beta") + F.col("step")).alias("trial"), "x_low", "x_high")
        s = state.join(_likelihood(d, by, trial), list(by), "left")
        # A trial far out may end in no number at all; that is no step up.
        up = F.col("live") & F.coalesce(~F.isnan("t_ll") & (F.abs("t_ll") < math.inf) & (F.col("t_ll") >= F.col("ll") - 1e-13 * F.abs("ll")), F.lit(False))
        s = s.withColumn("_up", up).withColumn("_beta", F.when(F.col("_up"), F.col("beta") + F.col("step")).otherwise(F.col("beta")))
        moves = F.when(F.col("_up"), (F.abs("step") > 1e-12 * F.greatest(F.lit(1.0), F.abs("_beta"))) & (F.abs("_beta") <= farthest)).otherwise(F.abs(F.col("step") / 2) >= 1e-15)
        pick = lambda n: F.when(F.col("_up"), F.col(f"t_{n}")).otherwise(F.col(n))
        s = s.withColumns({"_score": pick("score"), "_info": pick("info")})
        state = passed_on(s.select(
            *by, "x_low", "x_high", F.col("_beta").alias("beta"), pick("ll").alias("ll"), "ll0", F.col("_score").alias("score"), F.col("_info").alias("info"),
            F.when(F.col("_up"), _newton("_score", "_info")).otherwise(F.col("step") / 2).alias("step"), (F.col("live") & moves).alias("live"), (F.col("lost") | (F.abs("_beta") > farthest)).alias("lost")))
    return state


def ordered_pairs(d: DataFrame, by: Sequence[str], cells: int = CELLS) -> DataFrame:
    """(by, pairs, higher, level): pairs of a death and a later time; those in which the death has the higher x; those of equal x.

    Times and values of x are cut at their quantiles, and a value that is a cut
    is a slab of its own. Pairs apart in both are counted from the numbers of
    rows in each field of that grid. A pair in one slab of times meets in that
    slab, one in a single slab of x in that; so a row goes to two groups at most.
    """
    for name, order in (("_when", "_t"), ("_size", "_x")):
        shares = F.array(*(F.lit(k / cells) for k in range(1, cells)))
        bounds = d.groupBy(*by).agg(F.percentile_approx(order, shares, F.lit(20 * cells)).alias("_bounds"))
        slab = F.size(F.array_distinct(F.filter("_bounds", lambda b: b < F.col(order)))) * 2 + F.array_contains("_bounds", F.col(order)).cast("int")  # noqa: B023
        d = d.join(bounds, list(by)).withColumn(name, slab).drop("_bounds")
    d = passed_on(d.select(*by, "_t", "_x", "_when", "_size", F.when(F.col("_e") == 1, F.col("_k")).otherwise(0).alias("_d"), "_k"))
    kinds = dict(d.dtypes)
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["pairs long, higher long, level long"])
    grid = d.groupBy(*by, "_when", "_size").agg(F.sum("_d").alias("_d"), F.sum("_k").alias("_k"))

    def fields(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dead, rows = np.zeros((2, 2 * cells, 2 * cells), np.int64)
        at = pdf["_when"].to_numpy(), pdf["_size"].to_numpy()
        dead[at], rows[at] = pdf["_d"], pdf["_k"]
        after = rows[::-1].cumsum(0)[::-1] - rows  # later slabs of times
        below = after.cumsum(1) - after
        cut = np.arange(2 * cells) % 2 == 1
        return pd.DataFrame([(*key, int((dead * after.sum(1, keepdims=True)).sum()), int((dead * below).sum()), int((dead * after)[:, cut].sum()))], columns=[*by, "pairs", "higher", "level"])

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, higher, level = statistics.ordered_pairs(pdf["_time"].to_numpy(), pdf["_d"].to_numpy(), pdf["_x"].to_numpy(), pdf["_k"].to_numpy())
        return pd.DataFrame([(*key[: len(by)], pairs if key[-2] else 0, higher, level)], columns=[*by, "pairs", "higher", "level"])

    # Slabs between cuts only: a cut's slab of times has no later time, one of x has its pairs in the grid.
    sides = [d.where(F.col(slab) % 2 == 0).select(*by, F.lit(own).alias("_own"), F.col(slab).alias("_slab"), F.col(time).cast("double").alias("_time"), "_x", "_d", "_k") for own, slab, time in ((True, "_when", "_t"), (False, "_size", "_when"))]
    met = sides[0].unionByName(sides[1]).groupBy(*by, "_own", "_slab").applyInPandas(inside, schema)
    return grid.groupBy(*by).applyInPandas(fields, schema).unionByName(met).groupBy(*by).agg(*(F.sum(n).alias(n) for n in ("pairs", "higher", "level")))


def cox_by_group(df: DataFrame, by: Sequence[str], time: str, event: str, x: str, weight: str | None = None, rounds: int = 100) -> DataFrame:
    """One-covariate proportional hazards for each group, ties by Efron's method: status, estimate, tests, concordance.

    ``weight`` is a whole number of copies of a row. Rows with a null or NaN are
    left out; null groups too. Groups without a fit have one of the fixed
    statuses and null figures.
    """
    kept = df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(x).isNotNull())
    k = F.sum(F.col(weight)) if weight else F.count("*")
    rows = kept.dropna(subset=list(by)).groupBy(*by, F.col(time).cast("double").alias("_t"), F.col(event).cast("int").alias("_e"), F.col(x).cast("double").alias("_x")).agg(k.cast("long").alias("_k")).where("_k > 0")
    rows = passed_on(rows)
    facts = rows.groupBy(*by).agg(F.sum("_k").alias("n"), F.sum(F.when(F.col("_e") == 1, F.col("_k")).otherwise(0)).alias("events"), (F.sum(F.col("_x") * F.col("_k")) / F.sum("_k")).alias("mean"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    facts = passed_on(facts)
    fit = facts.where("events > 0 AND high - low >= 1e-10").select(*by, "mean")
    d = with_cells(rows.join(fit, list(by)).withColumn("_x", F.col("_x") - F.col("mean")).drop("mean"), by, "_t")
    d = passed_on(d)
    # If every death has the highest x of its risk set, or every one the lowest, the likelihood grows for ever.
    risk = later(d, by, "_t", {"x_most": ("max", F.col("_x")), "x_least": ("min", F.col("_x"))}, same=True)
    deaths = d.where("_e = 1").select(*by, "_cell", "_t", F.col("_x").alias("_own"))
    ends = deaths.join(risk, [*by, "_cell", "_t"]).groupBy(*by).agg((F.bool_and(F.col("_own") == F.col("x_most")) | F.bool_and(F.col("_own") == F.col("x_least"))).alias("endless"))
    ends = passed_on(ends)
    bounds = d.groupBy(*by).agg(F.min("_x").alias("x_low"), F.max("_x").alias("x_high"))
    found = _maxima(d, by, bounds.join(ends.where("NOT endless"), list(by)).drop("endless"), rounds, 64.0)
    pairs = ordered_pairs(d, by)
    out = facts.join(ends, list(by), "left").join(found.select(*by, "beta", "ll", "ll0", "score", "info", "lost"), list(by), "left").join(pairs, list(by), "left")
    se = 1 / F.sqrt(F.col("info"))
    status = (
        F.when(F.col("events") == 0, STATUS[0]).when(F.col("high") - F.col("low") < 1e-10, STATUS[1]).when(F.col("endless") | F.coalesce("lost", F.lit(True)), STATUS[2])
        .when((F.col("info") <= 1e-8) | (F.abs("score") > 1e-6), STATUS[3]).when((F.abs("beta") > 30) | (se > 100), STATUS[4]).otherwise(STATUS[5])
    )
    out = out.withColumn("status", status)
    ok = F.col("status") == STATUS[5]
    out = out.withColumns({"log_hr": F.when(ok, F.col("beta")), "se": F.when(ok, se), "lr": F.when(ok, F.greatest(F.lit(0.0), 2 * (F.col("ll") - F.col("ll0"))))})
    edge = 1.959963984540054 * F.col("se")
    agreed = F.when(F.col("beta") > 0, F.col("higher")).when(F.col("beta") < 0, F.col("pairs") - F.col("higher") - F.col("level")).otherwise((F.col("pairs") - F.col("level")) / 2)
    return out.select(
        *by, "n", "events", "status", "log_hr", "se", F.exp("log_hr").alias("hr"), F.exp(F.col("log_hr") - edge).alias("low"), F.exp(F.col("log_hr") + edge).alias("high"),
        "lr", F.when(ok, normal_two_sided(F.sqrt("lr"))).alias("p"), F.when(ok, normal_two_sided(F.col("log_hr") / F.col("se"))).alias("wald_p"),
        F.when(ok & (F.col("pairs") > 0), (agreed + F.col("level") / 2) / F.col("pairs")).alias("concordance"), F.when(ok, F.col("pairs")).alias("pairs"), F.when(ok, F.col("ll")).alias("log_likelihood"),
    )
