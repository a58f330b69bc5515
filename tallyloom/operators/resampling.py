"""Resampling whose draws come from SHA-256 keys, so any engine gets the same ones."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import draw, draw_order
from .rounds import passed_on


def bootstrap_means(df: DataFrame, by: Sequence[str], unit: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(by, rep, mean): means of n draws with replacement of a group's units (n is its size).

    A group's values are gathered in one array (it is a set of samples, not of
    rows), so a replicate is an expression and not a join.
    """
    groups = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(unit), F.col(value).alias("v")))).alias("x"))
    reps = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    slots = F.sequence(F.lit(0), F.size("x") - 1)
    picked = F.transform(slots, lambda s: F.get(F.col("x"), (draw(F.lit(seed), F.col("rep"), s) % F.size("x")).cast("int"))["v"])
    return reps.withColumn("d", picked).select(*by, "rep", (F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / F.size("d")).alias("mean"))


def replicate_counts(units: DataFrame, by: Sequence[str], unit: str, replicates: int, seed: str) -> DataFrame:
    """(by, unit, counts): how often each unit of a set is drawn in each of ``replicates`` draws of n with replacement.

    One array of replicates a unit instead of a row a replicate: whatever is
    measured at the units joins it once. Places are drawn, so sets of one size
    share their draws. ``units`` is a set of samples, one array by group.
    """
    sets = units.groupBy(*by).agg(F.sort_array(F.collect_set(unit)).alias("_u"))
    places = F.transform(F.sequence(F.lit(0), F.size("_u") - 1), lambda s: (draw(F.lit(seed), F.col("rep"), s) % F.size("_u")).cast("int"))
    picks = sets.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_p", places)
    each = picks.select(*by, "rep", F.posexplode("_u").alias("_k", unit), "_p").select(*by, "rep", unit, F.size(F.filter("_p", lambda q: q == F.col("_k"))).alias("n"))
    return each.groupBy(*by, unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "n"))), lambda x: x["n"]).alias("counts"))


def bootstrap_contrast(df: DataFrame, by: Sequence[str], unit: str, in_group: Column, value: str, replicates: int = 2000, seed: str = "contrast", low: float = 0.025, high: float = 0.975, bundles: int = 96) -> DataFrame:
    """(by, low, high): percentile interval of the mean of one group of units minus that of the other, both drawn anew with replacement.

    The units of all keys are drawn together, so a replicate is one drawing of
    samples. A drawn unit without a value at a key counts for nothing there; a
    replicate without any value of a group is left out of the key's interval.
    """
    d = df.where(F.col(value).isNotNull()).withColumn("_g", in_group.cast("int")).where("_g IS NOT NULL").select(*by, "_g", F.col(unit).alias("_unit"), F.col(value).cast("double").alias("_v"))
    counts = replicate_counts(d.select("_g", "_unit").distinct(), ["_g"], "_unit", replicates, seed).select(F.col("_g").alias("_side"), F.col("_unit").alias("_of"), "counts")
    # Keys and the units' counts meet in bundles, so no row a (key, replicate) exists.
    bundle = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))
    keys = d.withColumn("_bundle", F.pmod(F.xxhash64(*by), F.lit(bundles)).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["low double, high double"])

    def run(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            places = {key: k for k, key in enumerate(zip(drawn["_side"], drawn["_of"]))}
            every = np.stack(drawn["counts"].to_numpy()).astype(float)
            rows = rows.assign(_at=[places[key] for key in zip(rows["_g"], rows["_unit"])])
            for name, g in rows.groupby(list(by), dropna=False, sort=False):
                n, v, own = every[g["_at"].to_numpy()], g["_v"].to_numpy(), g["_g"].to_numpy() == 1
                with np.errstate(invalid="ignore", divide="ignore"):
                    side = lambda on: (np.where(n[on] > 0, n[on] * v[on][:, None], 0.0).sum(0), n[on].sum(0))
                    (s1, n1), (s0, n0) = side(own), side(~own)
                    gap = np.sort((s1 / n1 - s0 / n0)[(n1 > 0) & (n0 > 0)])
                    if len(gap):
                        out.append((*name, _percentile(gap, low), _percentile(gap, high)))
        return pd.DataFrame(out, columns=[*by, "low", "high"])

    return keys.groupBy("_bundle").cogroup(counts.withColumn("_bundle", bundle).groupBy("_bundle")).applyInPandas(run, schema)


def _percentile(ordered: np.ndarray, share: float) -> float:
    """The percentile of sorted values as SQL interpolates it."""
    at = share * (len(ordered) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    return float(ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high])


def interval(draws: DataFrame, by: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return draws.groupBy(*by).agg(F.expr(f"percentile({value}, {low}D)").alias("low"), F.expr(f"percentile({value}, {high}D)").alias("high"))


def permute(df: DataFrame, by: Sequence[str], unit: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(by, rep, unit, value): each replicate deals a group's values to its units in the order of a digest."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy(*by, "rep")
    ids = d.select(*by, "rep", unit, F.row_number().over(w.orderBy(unit)).alias("_k"))
    dealt = d.select(*by, "rep", F.col(value), F.row_number().over(w.orderBy(draw_order(F.lit(seed), F.col("rep"), F.col(unit)))).alias("_k"))
    return ids.join(dealt, [*by, "rep", "_k"]).drop("_k")


def permutation_p(null: DataFrame, by: Sequence[str], value: str, observed: str, slack: float = 1e-12) -> DataFrame:
    """(1 + number of |null| >= |observed| - slack) / (1 + number)."""
    extreme = F.count_if(F.abs(value) >= F.abs(observed) - slack)
    return null.groupBy(*by).agg(F.first(observed).alias(observed), ((1 + extreme) / (1 + F.count(value))).alias("p"))


def subsample(df: DataFrame, by: Sequence[str], unit: str, k: int, replicates: int, seed: str) -> DataFrame:
    """``k`` of each group's units without replacement in each replicate: those of least digest.

    Digests are even, so all but a few units of a large group are left out where
    they are read: by a bound under which some four times ``k`` digests are
    expected. A replicate that has too few below it takes all of its group.
    """
    groups = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_size"))
    expected = 4 * k + 40
    bound = F.when(F.col("_size") <= expected, F.lit("g")).otherwise(F.lpad(F.lower(F.hex((F.lit(expected * float(2**52)) / F.col("_size")).cast("long"))), 13, "0"))
    own = F.lit(True)
    for i, b in enumerate(by):
        own = own & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    digest = draw_order(F.lit(seed), F.col("rep"), F.col(unit))
    w = Window.partitionBy(*by, "rep").orderBy("_digest")
    least = lambda d: d.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k).drop("_digest")
    near = df.join(sizes.withColumn("_bound", bound), own).withColumn("rep", reps).withColumn("_digest", digest).where(F.col("_digest") < F.col("_bound"))
    found = passed_on(least(near.select(*df.columns, "rep", "_digest")))
    same = own & (F.col("rep") == F.col("_rep"))
    got = found.groupBy(*groups, F.col("rep").alias("_rep")).agg(F.count("*").alias("_got"))
    few = sizes.withColumn("_rep", reps).join(got.withColumnsRenamed({g: f"_g{g}" for g in got.columns}), _met(len(by)), "left")
    few = passed_on(few.where(F.coalesce("_g_got", F.lit(0)) < F.least(F.lit(k), F.col("_size"))).select(*(f"_by{i}" for i in range(len(by))), "_rep"))
    if few.isEmpty():
        return found
    whole = df.join(few, own).withColumnRenamed("_rep", "rep").withColumn("_digest", digest)
    return found.join(few, same, "left_anti").unionByName(least(whole.select(*df.columns, "rep", "_digest")))


def _met(n: int) -> Column:
    met = F.col("_rep") == F.col("_g_rep")
    for i in range(n):
        met = met & F.col(f"_by{i}").eqNullSafe(F.col(f"_g_by{i}"))
    return met


def sign_flips(df: DataFrame, by: Sequence[str], unit: str, value: str, flips: int, seed: str) -> DataFrame:
    """(by, rep, mean) of values with signs from the digest's lowest bit."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(flips))))
    sign = F.when(draw(F.lit(seed), F.col("rep"), F.col(unit)) % 2 == 0, 1.0).otherwise(-1.0)
    return d.groupBy(*by, "rep").agg(F.avg(sign * F.col(value)).alias("mean"))


#: Numbers over 2^32 from which a Poisson(1) weight is at least 1, 2, ... 8, by its cumulative probabilities.
_POISSON = np.ceil(np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(8)]) * 4294967296.0 - 0.5).astype(np.uint32)


def poisson_of(numbers: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of 32-bit numbers, by the cumulative probabilities of number plus a half over 2^32."""
    out = np.zeros(numbers.shape, np.int8)
    for bound in _POISSON:
        out += numbers >= bound
    return out


def unit_bootstrap(df: DataFrame, by: Sequence[str], unit: str, value: str, replicates: int, seed: str, keep: Column | None = None, low: float = 0.025, high: float = 0.975, tasks: int = 192) -> DataFrame:
    """(by, units, mean, low, mid, high, empty): the mean of all rows' values with every unit reweighed in each replicate.

    Weights are Poisson(1), or with ``keep`` (a probability by group) 1 with that
    probability and else 0. A unit's rows are added up first, and its weights are
    one array, which a task adds to its group's sums: no row a unit and replicate
    exists, and what is exchanged is an array a (task, group). A replicate in
    which all weights of a group are 0 takes the plain mean, and is counted in ``empty``.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.sum(value).cast("double").alias("_s"), F.count("*").cast("double").alias("_n"), (F.max(keep) if keep is not None else F.lit(None)).cast("double").alias("_p"))
    # Few bytes for much work, so a fixed number of tasks.
    d = d.repartition(tasks, *by, unit).select(*by, F.concat(F.concat_ws("|", F.lit(seed), F.col(unit).cast("string")), F.lit("|")).cast("binary").alias("_key"), "_s", "_n", "_p")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    groups = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    held_columns = [*by, "_part", "_units", "_sum", "_rows"]
    poisson = keep is None

    def weights(g: pd.DataFrame) -> np.ndarray:
        # A digest holds eight numbers.
        blocks = [str(b).encode() for b in range(-(-replicates // 8))]
        digests = b"".join([hashlib.sha256(key + b).digest() for key in map(bytes, g["_key"]) for b in blocks])
        numbers = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(g), -1)[:, :replicates]
        if poisson:
            return poisson_of(numbers)
        bound = np.ceil(g["_p"].to_numpy(float) * 4294967296.0 - 0.5)  # u + 0.5 is below p times 2^32 where u is below this
        return numbers < np.where(np.isnan(bound), np.inf, bound)[:, None]

    def add(batches):
        part, held = TaskContext.get().partitionId(), {}

        def out():
            return pd.DataFrame([(*name, part, n, total[0], total[1]) for name, (n, total) in held.items()], columns=held_columns)

        for pdf in batches:
            for name, rows in pdf.groupby(list(by), dropna=False, sort=False):
                for at in range(0, len(rows), 256):
                    g = rows.iloc[at : at + 256]
                    # The last column is the plain sum.
                    w = np.concatenate([weights(g), np.ones((len(g), 1), np.int8)], axis=1).astype(float)
                    n, total = held.get(name, (0, 0.0))
                    held[name] = (n + len(g), total + g[["_s", "_n"]].to_numpy().T @ w)
                if len(held) * replicates > 4_000_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part", kind="stable")
        s, n = (np.sum(np.stack(pdf[c].to_numpy()), axis=0) for c in ("_sum", "_rows"))
        some = n[:-1] > 0
        mean = float(s[-1] / n[-1])
        means = np.sort(np.where(some, s[:-1] / np.where(some, n[:-1], 1.0), mean))
        return pd.DataFrame([(*(pdf[b].iloc[0] for b in by), int(pdf["_units"].sum()), mean, *(_percentile(means, q) for q in (low, 0.5, high)), int((~some).sum()))], columns=[*by, "units", "mean", "low", "mid", "high", "empty"])

    sums = d.mapInPandas(add, f"{groups}, _part int, _units long, _sum array<double>, _rows array<double>")
    return sums.groupBy(*by).applyInPandas(finish, f"{groups}, units long, mean double, low double, mid double, high double, empty long")


def label_permutation(df: DataFrame, by: Sequence[str], unit: str, in_group: Column, value: str, permutations: int, seed: str, bundles: int = 96) -> DataFrame:
    """(by, seen, p): difference of group means, and how often it is as large when the labels are dealt to the units at random.

    A permutation deals the labels of all units once, for every key. Units are a
    set of samples, gathered as one array a permutation; keys fall into ``bundles``,
    each a task that takes its keys one after another.
    """
    d = df.where(F.col(value).isNotNull()).withColumn("_g", in_group.cast("int")).where("_g IS NOT NULL")
    units = d.select(F.col(unit).alias("u"), "_g").distinct().agg(F.sort_array(F.collect_list(F.struct("u", "_g"))).alias("_u"))
    dealt = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    order = F.array_sort(F.transform("_u", lambda x: F.struct(draw_order(F.lit(seed), F.col("rep"), x["u"]).alias("h"), x["u"].alias("u"))))
    # A permutation as a row's array of (unit, label); permutations and keys meet in bundles, so no row a (key, permutation) exists.
    labels = dealt.select("rep", F.transform(order, lambda x: x["u"]).alias("_order"), F.transform("_u", lambda x: x["_g"]).alias("_dealt"))
    bundle = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = d.select(*by, F.col(unit).alias("_unit"), "_g", F.col(value).cast("double").alias("_v"), F.pmod(F.xxhash64(*by), F.lit(bundles)).cast("int").alias("_bundle"))
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["seen double, p double"])

    def run(rows: pd.DataFrame, perms: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or perms.empty:
            return pd.DataFrame(columns=[*by, "seen", "p"])
        every = np.sort(np.array(perms["_order"].iloc[0]))
        places = np.searchsorted(every, np.stack(perms["_order"].to_numpy()))
        label = np.empty(places.shape, bool)
        np.put_along_axis(label, places, np.stack(perms["_dealt"].to_numpy()) == 1, axis=1)
        out = []
        for name, g in rows.groupby(list(by), dropna=False, sort=False):
            at, v = np.searchsorted(every, g["_unit"].to_numpy()), g["_v"].to_numpy()
            own = g["_g"].to_numpy() == 1
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = lambda on: (on @ v) / on.sum(-1)
                seen = mean(own.astype(float)) - mean((~own).astype(float))
                mine = label[:, at].astype(float)
                null = mean(mine) - mean(1 - mine)
            null = null[~np.isnan(null)]
            extreme = int((np.abs(null) >= abs(seen) - 1e-12).sum())
            out.append((*name, None if np.isnan(seen) else float(seen), (1 + extreme) / (1 + len(null))))
        return pd.DataFrame(out, columns=[*by, "seen", "p"])

    return keys.groupBy("_bundle").cogroup(labels.withColumn("_bundle", bundle).groupBy("_bundle")).applyInPandas(run, schema)


def welch(df: DataFrame, by: Sequence[str], in_group: Column, value: str, least_in: int, least_out: int) -> DataFrame:
    """|Welch statistic| per key; unsupported keys are 0 and stay; no variance gives infinity if the means differ, else 0."""
    d = df.withColumn("_g", in_group)
    a, b = F.when(F.col("_g"), F.col(value)), F.when(~F.col("_g"), F.col(value))
    s = d.groupBy(*by).agg(F.count(a).alias("n_in"), F.count(b).alias("n_out"), F.avg(a).alias("m_in"), F.avg(b).alias("m_out"), F.var_samp(a).alias("v_in"), F.var_samp(b).alias("v_out"))
    effect = F.col("m_in") - F.col("m_out")
    se = F.sqrt(F.col("v_in") / F.col("n_in") + F.col("v_out") / F.col("n_out"))
    ok = (F.col("n_in") >= least_in) & (F.col("n_out") >= least_out)
    stat = F.when(~ok, 0.0).when(se == 0, F.when(effect == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.abs(effect) / F.when(se == 0, None).otherwise(se))
    return s.select(*by, "n_in", "n_out", effect.alias("effect"), stat.alias("statistic"), ok.alias("eligible"))


def curveball(z: np.ndarray, rng: np.random.Generator, trades: int) -> int:
    """Randomise a 0/1 matrix in place by curveball trades (Strona et al. 2014); -1 is missing and never traded.

    Two rows put the columns that only one of them holds into a pool, shuffle it,
    and each takes back as many as it gave. Columns that either row does not know
    stay out of the pool. So row sums, column sums and missing places stay.
    Rows are paired at random and all pairs of a round trade at once (global
    trades, Carstens et al. 2018), the last round with as many pairs as are left.
    Returns the number of trades after which a row held something else.
    """
    changed, left = 0, trades if len(z) > 1 else 0
    columns = np.ascontiguousarray(z.T)
    while left > 0:
        pairs = min(left, len(z) // 2)
        order = rng.permutation(len(z))
        for at in range(0, pairs, 1 << 14):
            n = min(1 << 14, pairs - at)
            i, j = order[at : at + n], order[pairs + at : pairs + at + n]
            mine, yours = columns.take(i, 1), columns.take(j, 1)
            pool = (mine ^ yours) == 1
            gave = pool & (mine == 1)
            u, count = rng.random((n, len(columns))), gave.sum(0, dtype=np.int32)
            # A row that gave nothing or all of the pool gets the same back.
            live = np.flatnonzero((count > 0) & (count < pool.sum(0, dtype=np.int32)))
            i, j, u, count = i[live], j[live], np.ascontiguousarray(u[live].T), count[live]
            mine, yours, pool, gave = (x.take(live, 1) for x in (mine, yours, pool, gave))
            # Pool columns in random order; the first ones, as many as the first row gave, come back to it.
            u += ~pool
            if len(columns) <= 16:
                rank = np.zeros(u.shape, np.uint8)
                for a, b in combinations(range(len(columns)), 2):
                    less = (u[a] < u[b]).view(np.uint8)
                    rank[b] += less
                    rank[a] += less ^ 1
            else:
                rank = u.argsort(axis=0).argsort(axis=0)
            turned = (pool & (rank < count)) ^ gave
            changed += int(np.count_nonzero(turned.any(0)))
            for c, m, y, t in zip(columns, mine, yours, turned.view(np.int8)):
                c[i], c[j] = m ^ t, y ^ t
        left -= pairs
    z[:] = columns.T
    return changed


def _mean_covariance(z: np.ndarray) -> float:
    """Mean over the column pairs that at least twelve rows know of their covariance; -1 is missing."""
    n = sums = both = 0
    for at in range(0, len(z), 1 << 16):
        part = z[at : at + (1 << 16)]
        k, x = (part >= 0).astype(float), (part == 1).astype(float)
        n, sums, both = n + k.T @ k, sums + x.T @ k, both + x.T @ x
    if not len(z):
        return np.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        a = sums / n
        c = both / n - a * a.T
    i, j = np.triu_indices(z.shape[1], 1)
    ok = n[i, j] >= 12
    return float(c[i, j][ok].mean()) if ok.any() else np.nan


def _as_matrix(rows: pa.Array, cells: pa.ListArray) -> np.ndarray:
    """The matrix of lists of (column c, value v), one a row, in the order of rows and columns. Of two values in one place the first counts."""
    flat, sizes = cells.flatten(), pc.list_value_length(cells).to_numpy(zero_copy_only=False)
    place = np.empty(len(rows), np.int64)
    place[pc.sort_indices(rows).to_numpy()] = np.arange(len(rows))
    place = (np.cumsum((sizes > 0)[np.argsort(place)]) - 1)[place]
    codes = flat.field("c").dictionary_encode()
    rank = np.empty(len(codes.dictionary), np.int64)
    rank[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(rank))
    z = np.full((int((sizes > 0).sum()), len(rank)), -1, np.int8)
    z[np.repeat(place, sizes)[::-1], rank[codes.indices.to_numpy()][::-1]] = flat.field("v").to_numpy()[::-1]
    return z


def fixed_margin_null(df: DataFrame, by: Sequence[str], row: str, column: str, value: str, chains: int = 2, draws: int = 32, burn_in: int = 50, apart: int = 5, least_moves: int = 64, seed: int = 7) -> DataFrame:
    """Mean pair covariance of a 0/1 matrix against its fixed-margin null, one row per group.

    by, rows, columns, moves, eligible, observed, null_mean, residual,
    chain_difference. Each chain runs burn_in x rows trades, then keeps ``draws``
    states apart x rows trades from each other. A chain is sequential, so a group's
    chain is a task; what it holds is a byte an entry, and entries come a row of the matrix at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", _chain int, n_rows long, n_columns long, moves long, observed double, _mean double"

    def run(t: pa.Table) -> pa.Table:
        cells = t.column("_x").combine_chunks()
        z0 = _as_matrix(t.column("_row").combine_chunks(), cells)
        chain, z, states = t.column("_chain")[0].as_py(), z0.copy(), []
        rng = np.random.default_rng([seed, chain])
        moved = curveball(z, rng, burn_in * len(z))
        for _ in range(draws):
            moved += curveball(z, rng, apart * len(z))
            states.append(_mean_covariance(z))
        same = all(((z == 1).sum(k) == (z0 == 1).sum(k)).all() for k in (0, 1)) and ((z < 0) == (z0 < 0)).all()
        assert same, "margins or missing places changed"
        found = {"_chain": pa.array([chain], pa.int32())} | {k: pa.array([v], pa.int64()) for k, v in (("n_rows", len(z0)), ("n_columns", z0.shape[1]), ("moves", moved))}
        found |= {k: pa.array([v], pa.float64(), from_pandas=True) for k, v in (("observed", _mean_covariance(z0)), ("_mean", float(np.mean(states))))}
        return pa.table({b: t.column(b).slice(0, 1) for b in by} | found)

    known = F.col(row).isNotNull() & F.col(column).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    cell = F.when(known, F.struct(F.col(column).alias("c"), F.col(value).cast("tinyint").alias("v")))
    rows = df.select(*by, F.col(row).alias("_row"), cell.alias("_x")).groupBy(*by, "_row").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    # Few chains and little data are much work, so they are dealt to tasks whatever their size.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).repartition(n, *by, "_chain")
    each = dealt.groupBy(*by, "_chain").applyInArrow(run, schema)
    out = each.groupBy(*by).agg(F.first("n_rows").alias("n_rows"), F.first("n_columns").alias("n_columns"), F.min("moves").alias("moves"), (F.min("moves") >= least_moves).alias("eligible"), F.first("observed").alias("observed"), F.avg("_mean").alias("null_mean"),
                                F.abs(F.min_by("_mean", "_chain") - F.max_by("_mean", "_chain")).alias("chain_difference"))
    return out.select(*by, "n_rows", "n_columns", "moves", "eligible", "observed", "null_mean", (F.col("observed") - F.col("null_mean")).alias("residual"), "chain_difference")


def coupled_quantiles(df: DataFrame, by: Sequence[str], value: str, n: int = 1000) -> DataFrame:
    """Centred mid-quantiles of each null distribution as one array."""
    at = ", ".join(f"{(k + 0.5) / n}D" for k in range(n))
    q = df.groupBy(*by).agg(F.expr(f"percentile({value}, array({at}))").alias("q"))
    mean = F.aggregate("q", F.lit(0.0), lambda a, x: a + x) / n
    return q.withColumn("q", F.transform("q", lambda x: x - mean))
