"""Contrasts, gated rollups, quantiles and zero-filled tables over long-form measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_contrast(df: DataFrame, by: Sequence[str], sample: str, in_group: Column, values: Sequence[str]) -> DataFrame:
    """Mean difference of the groups with leave-one-out extremes and pairwise agreement, for each value.

    For value v: v (contrast), v_stable (same sign under every omission),
    v_min_abs (least absolute leave-one-out contrast), v_median (difference of
    medians), v_agree (share of cross-group pairs with the contrast's sign).
    Leave-one-out uses sums, not recomputation; agreement
    counts pairs inside two arrays, so none is listed. Groups are small sets of
    samples, and a key's values are one array of at most that size.
    """
    g = df.select(*by, F.col(sample), in_group.alias("_g"), *values)
    w = Window.partitionBy(*by)
    for v in values:
        for name, cond in (("a", F.col("_g")), ("b", ~F.col("_g"))):
            g = g.withColumn(f"_s{name}_{v}", F.sum(F.when(cond, F.col(v))).over(w)).withColumn(f"_n{name}_{v}", F.count(F.when(cond, F.col(v))).over(w))
    aggs = []
    for v in values:
        sa, na, sb, nb = (F.col(f"_{k}_{v}") for k in ("sa", "na", "sb", "nb"))
        full = F.try_divide(sa, na) - F.try_divide(sb, nb)
        left = F.when(F.col("_g"), F.try_divide(sa - F.col(v), na - 1) - F.try_divide(sb, nb)).otherwise(F.try_divide(sa, na) - F.try_divide(sb - F.col(v), nb - 1))
        g = g.withColumn(f"_c_{v}", full).withColumn(f"_l_{v}", left)
        c = F.first(f"_c_{v}")
        aggs += [
            c.alias(v),
            F.bool_and(F.coalesce(F.signum(f"_l_{v}") == F.signum(f"_c_{v}"), F.lit(False)) & (F.col(f"_c_{v}") != 0)).alias(f"{v}_stable"),
            F.min(F.abs(f"_l_{v}")).alias(f"{v}_min_abs"),
            (F.expr(f"percentile(CASE WHEN _g THEN {v} END, 0.5)") - F.expr(f"percentile(CASE WHEN NOT _g THEN {v} END, 0.5)")).alias(f"{v}_median"),
            F.collect_list(F.when(F.col("_g"), F.col(v))).alias(f"_a_{v}"),
            F.collect_list(F.when(~F.col("_g"), F.col(v))).alias(f"_b_{v}"),
        ]
    out = g.groupBy(*by).agg(*aggs)
    for v in values:
        agree = _agreeing(f"_a_{v}", f"_b_{v}", v)
        out = out.withColumn(f"{v}_agree", F.try_divide(agree.cast("double"), (F.size(f"_a_{v}") * F.size(f"_b_{v}")).cast("double"))).drop(f"_a_{v}", f"_b_{v}")
    return out


def _agreeing(a: str, b: str, contrast: str) -> Column:
    """Number of pairs of two arrays whose difference has the contrast's sign."""
    return F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: F.signum(x - y) == F.signum(F.col(contrast)))))


def opposing(df: DataFrame, one: str, two: str, least: float = 2.0, most_sum: float = 1.0) -> DataFrame:
    """Add candidate (|two| large and stable) and opposing (candidate, opposite signs, near-zero sum)."""
    candidate = (F.abs(two) >= least) & F.col(f"{two}_stable")
    return df.withColumn("candidate", candidate).withColumn("opposing", candidate & (F.col(one) * F.col(two) < 0) & (F.abs(F.col(one) + F.col(two)) <= most_sum))


def gated(column: str | Column, count: Column, least: int) -> Column:
    """The value where ``count`` reaches ``least``, else null: rows stay, values go."""
    return F.when(count >= least, F.col(column) if isinstance(column, str) else column)


def gated_rollup(df: DataFrame, levels: Sequence[tuple[Sequence[str], int]], value: str) -> DataFrame:
    """Nested means: each level averages the one below and is null under its least count of non-null values."""
    out = df
    for by, least in levels:
        out = out.groupBy(*by).agg(gated(F.avg(value), F.count(value), least).alias(value), F.count(value).alias("n"))
    return out


def zero_filled(df: DataFrame, by: str, categories: DataFrame) -> DataFrame:
    """Counts by category with zeros for those that do not occur."""
    return categories.join(df.groupBy(by).agg(F.count("*").alias("n")), by, "left").na.fill(0, ["n"])


def empirical_cdf(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Share of values at or below each point, one pass: counts per cell between points, then a running sum of at most len(points) rows."""
    p = sorted(points)
    cell = F.size(F.filter(F.array(*map(F.lit, p)), lambda x: x < F.col(value)))
    total = F.sum("_n").over(Window.partitionBy(*by))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_n")).withColumn("_total", total)
    keys = counts.select(*by, "_total").distinct()
    grid = keys.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(len(p) - 1))))
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    filled = grid.join(counts.drop("_total"), [*by, "_cell"], "left").withColumn("share", upto / F.col("_total"))
    return filled.select(*by, F.element_at(F.array(*map(F.lit, p)), F.col("_cell") + 1).alias("point"), "share")


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column q<percent> each."""
    return df.groupBy(*by).agg(*(F.expr(f"percentile({value}, {q}D)").alias(f"q{round(q * 1000)}") for q in at))


def influence(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """What leaving each row out does to its group's mean: mean_without and influence."""
    w = Window.partitionBy(*by)
    s, n = F.sum(value).over(w), F.count(value).over(w)
    without = F.try_divide(s - F.col(value), n - 1)
    return df.withColumn("mean_without", without).withColumn("influence", F.try_divide(s, n) - without)


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], kind: str = "one_to_one", how: str = "inner") -> DataFrame:
    """Join that fails at run time if a side that must be unique on the keys is not."""
    def unique(df, side):
        n = F.count("*").over(Window.partitionBy(*on))
        checked = df.withColumn("_n", n)
        fail = F.raise_error(F.lit(f"{side} side is not unique on {', '.join(on)}"))
        return checked.where(F.when(F.col("_n") > 1, fail.cast("boolean")).otherwise(F.lit(True))).drop("_n")

    if kind in ("one_to_one", "one_to_many"):
        left = unique(left, "left")
    if kind in ("one_to_one", "many_to_one"):
        right = unique(right, "right")
    return left.join(right, list(on), how)


def complete_cases(df: DataFrame, key: str, column: str, names: Sequence[str], value: str) -> DataFrame:
    """Wide table of ``value`` by ``column``; only keys with every name."""
    wide = df.groupBy(key).pivot(column, list(names)).agg(F.first(value))
    return wide.dropna(subset=list(names))


def segments(df: DataFrame, by: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """First start, last end, row count and whether the value is constant."""
    return df.groupBy(*by).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), (F.min(value) == F.max(value)).alias("constant"))


def paired_differences(pairs: DataFrame, target: str, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, targets, target_mean, control_mean, difference) over rows of (target, control) pairs.

    ``metrics`` names the target's and the control's column of each metric. A
    target counts for a metric only if it has it itself and some of its controls
    has it; its control value is the mean of those.
    """
    aggs = []
    for name, (mine, theirs) in metrics.items():
        aggs += [F.max(mine).alias(f"_t_{name}"), F.avg(theirs).alias(f"_c_{name}")]
    each = pairs.groupBy(target).agg(*aggs)
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_t_{m}").cast("double").alias("t"), F.col(f"_c_{m}").cast("double").alias("c")) for m in metrics))
    both = each.select(F.explode(rows).alias("x")).select("x.*").where("t IS NOT NULL AND c IS NOT NULL")
    return both.groupBy("metric").agg(F.count("*").alias("targets"), F.avg("t").alias("target_mean"), F.avg("c").alias("control_mean"), F.avg(F.col("t") - F.col("c")).alias("difference"))


def joined_by_pattern(left: DataFrame, right: DataFrame, column: str, pattern: str, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` on the first group of ``pattern`` in ``column``, read as the type of ``right``'s ``key``; no match joins nothing."""
    kind = right.schema[key].dataType
    found = F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    return left.withColumn(key, found.try_cast(kind)).join(right, key, how)
