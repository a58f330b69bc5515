"""Plans from calls to supported, equal-weight window means and their contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counting, intervals, resampling, rollups
from .registry import BASE, CELLS, DEEP, N_SAMPLES, SUPPORT, cells, plan, rounded, sample_count, supported, table, windows


@plan(f"WITH {CELLS} SELECT * FROM cells")
def site_state_counts(spark, sf_dir):
    return cells(spark, sf_dir)


@plan("""
WITH x AS (SELECT floor((l_suppkey - 1) / 10)::BIGINT AS win, l_returnflag AS state, l_discount FROM lineitem),
t AS (SELECT unnest([0.02, 0.05, 0.08, 0.1]::DOUBLE[]) AS threshold)
SELECT win, state, threshold, count(*)::BIGINT AS n FROM x JOIN t ON l_discount >= threshold GROUP BY ALL
""")
def threshold_fanout_counts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.floor((F.col("l_suppkey") - 1) / 10).alias("win"), F.col("l_returnflag").alias("state"), "l_discount")
    return counting.threshold_counts(line, ["win", "state"], "l_discount", [0.02, 0.05, 0.08, 0.1])


_REASON = """CASE WHEN (l_linenumber & 4) <> 0 THEN 'flag' WHEN l_quantity < 5 OR l_quantity >= 50 THEN 'quality'
  WHEN l_tax > 0.07 THEN 'contig' WHEN l_extendedprice < 5000 THEN 'score' WHEN l_linestatus IS NULL THEN 'tags' ELSE 'kept' END"""


@plan(f"""
WITH r AS (SELECT *, {_REASON} AS reason FROM lineitem),
d AS (SELECT CASE WHEN reason = 'kept' AND row_number() OVER (PARTITION BY l_orderkey, l_linenumber, reason = 'kept'
  ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r)
SELECT reason, count(*)::BIGINT AS n FROM d GROUP BY 1
""")
def reject_cascade_qc(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    out = counting.reject(line, [
        ("flag", scalars.has_flag("l_linenumber", 4)), ("quality", (F.col("l_quantity") < 5) | (F.col("l_quantity") >= 50)),
        ("contig", F.col("l_tax") > 0.07), ("score", F.col("l_extendedprice") < 5000), ("tags", F.col("l_linestatus").isNull()),
    ])
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    return counting.reason_counts(counting.mark_repeats(out, ["l_orderkey", "l_linenumber"], order, F.col("reason") == "kept"))


_FIRST = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag"


@plan(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_FIRST}) = 1
""")
def first_occurrence_dedup(spark, sf_dir):
    out = counting.first_occurrence(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _FIRST.split(", "))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@plan(f"""WITH {CELLS} SELECT site, 5 AS least FROM cells GROUP BY site HAVING count(*) FILTER (c + m + h >= 5) = {N_SAMPLES}
UNION ALL SELECT site, 10 AS least FROM cells GROUP BY site HAVING count(*) FILTER (c + m + h >= 10) = {N_SAMPLES}""")
def common_support_mask(spark, sf_dir):
    cell = cells(spark, sf_dir)
    return supported(cell, 5).withColumn("least", F.lit(5)).unionByName(supported(cell, 10).withColumn("least", F.lit(10)))


@plan(f"{BASE} SELECT sample, win, n_sites, round(m, 6) AS m, round(h, 6) AS h FROM windows")
def equal_weight_window_mean(spark, sf_dir):
    return rounded(windows(spark, sf_dir))


@plan(f"""WITH {CELLS}, {SUPPORT}, p AS (SELECT sample, 100.0 * m::DOUBLE / (c + m + h) AS pm, 100.0 * h::DOUBLE / (c + m + h) AS ph, c + m + h AS depth FROM cells JOIN support USING (site))
SELECT sample, count(*)::BIGINT AS n_sites, round(avg(pm), 6) AS m, round(avg(ph), 6) AS h, sum(depth)::BIGINT AS depth FROM p GROUP BY 1""")
def sample_global_means(spark, sf_dir):
    cell = cells(spark, sf_dir).withColumn("depth", F.col("c") + F.col("m") + F.col("h"))
    pct = counting.percents(cell.join(supported(cell), "site"), ["m", "h"], ["pm", "ph"], F.col("depth"))
    return rounded(pct.groupBy("sample").agg(F.count("*").alias("n_sites"), F.avg("pm").alias("m"), F.avg("ph").alias("h"), F.sum("depth").alias("depth")))


@plan(f"""WITH {CELLS}, f AS (SELECT range AS feature, 7 * range AS s, 7 * range + 20 AS e FROM range(0, 14))
SELECT sample, feature, count(*)::BIGINT AS n_sites, round(avg(100.0 * h::DOUBLE / (c + m + h)), 6) AS h FROM cells JOIN f ON site >= s AND site < e GROUP BY 1, 2 HAVING count(*) >= 10""")
def overlapping_feature_mean(spark, sf_dir):
    features = spark.range(14).select(F.col("id").alias("feature"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 20).alias("end"))
    cell = counting.percents(cells(spark, sf_dir), ["h"], ["h_pct"], F.col("c") + F.col("m") + F.col("h"))
    hit = intervals.points_in_intervals(cell, features, [], "site", bin_size=20)
    return rounded(counting.equal_weight_mean(hit.select("sample", "feature", F.col("h_pct").alias("h")), ["sample", "feature"], ["h"], least=10))


_CONTRAST = """
, g AS (SELECT *, sample < 15 AS g FROM windows),
t AS (SELECT win, sum(m) FILTER (g) AS sma, sum(m) FILTER (NOT g) AS smb, sum(h) FILTER (g) AS sha, sum(h) FILTER (NOT g) AS shb, count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb,
  avg(m) FILTER (g) - avg(m) FILTER (NOT g) AS cm, avg(h) FILTER (g) - avg(h) FILTER (NOT g) AS ch, quantile_cont(m, 0.5) FILTER (g) - quantile_cont(m, 0.5) FILTER (NOT g) AS m_median,
  quantile_cont(h, 0.5) FILTER (g) - quantile_cont(h, 0.5) FILTER (NOT g) AS h_median FROM g GROUP BY win),
l AS (SELECT win, cm, ch, CASE WHEN g THEN (sma - m) / (na - 1) - smb / nb ELSE sma / na - (smb - m) / (nb - 1) END AS lm,
  CASE WHEN g THEN (sha - h) / (na - 1) - shb / nb ELSE sha / na - (shb - h) / (nb - 1) END AS lh FROM g JOIN t USING (win)),
s AS (SELECT win, bool_and(sign(lm) = sign(cm) AND cm <> 0) AS m_stable, min(abs(lm)) AS m_min_abs, bool_and(sign(lh) = sign(ch) AND ch <> 0) AS h_stable, min(abs(lh)) AS h_min_abs FROM l GROUP BY win),
a AS (SELECT x.win, avg((sign(x.m - y.m) = sign(t.cm))::INT) AS m_agree, avg((sign(x.h - y.h) = sign(t.ch))::INT) AS h_agree FROM g x JOIN g y ON x.win = y.win AND x.g AND NOT y.g JOIN t ON t.win = x.win GROUP BY x.win),
contrast AS (SELECT win, cm AS m, m_stable, m_min_abs, m_median, m_agree, ch AS h, h_stable, h_min_abs, h_median, h_agree FROM t JOIN s USING (win) JOIN a USING (win))
"""


def contrasts(spark, sf_dir):
    return rollups.group_contrast(windows(spark, sf_dir), ["win"], "sample", F.col("sample") < 15, ["m", "h"])


@plan(f"""{BASE}{_CONTRAST} SELECT win, round(m, 6) AS m, m_stable, round(m_min_abs, 6) AS m_min_abs, round(m_median, 6) AS m_median, round(m_agree, 6) AS m_agree,
round(h, 6) AS h, h_stable, round(h_min_abs, 6) AS h_min_abs, round(h_median, 6) AS h_median, round(h_agree, 6) AS h_agree,
abs(h) >= 0.5 AND h_stable AS candidate, abs(h) >= 0.5 AND h_stable AND m * h < 0 AND abs(m + h) <= 1 AS opposing FROM contrast""")
def group_contrast_loo(spark, sf_dir):
    return rounded(rollups.opposing(contrasts(spark, sf_dir), "m", "h", least=0.5))


_DRAWS = f"""
, u AS (SELECT DISTINCT sample, sample < 15 AS side FROM windows), z AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY sample) - 1 AS place, count(*) OVER (PARTITION BY side) AS size FROM u), rep AS (SELECT range AS rep FROM range(0, 2000)),
dr AS (SELECT side, rep, ('0x' || substr(sha256(concat_ws('|', 'contrast', rep::VARCHAR, place::VARCHAR)), 1, 8))::BIGINT % size AS place FROM z, rep), dn AS (SELECT z.side, z.sample, rep, count(*) AS k FROM dr JOIN z ON dr.side = z.side AND dr.place = z.place GROUP BY 1, 2, 3),
dm AS (SELECT win, rep, sum(h * k) FILTER (side) / sum(k) FILTER (side) - sum(h * k) FILTER (NOT side) / sum(k) FILTER (NOT side) AS d FROM windows JOIN dn USING (sample) GROUP BY 1, 2),
ci AS (SELECT win, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM dm WHERE d IS NOT NULL GROUP BY win)"""


def contrast_intervals(spark, sf_dir):
    """Intervals of the difference between both groups of samples at each window, 2000 drawings of samples."""
    return resampling.bootstrap_contrast(windows(spark, sf_dir), ["win"], "sample", F.col("sample") < 15, "h")


@plan(f"{BASE}{_DRAWS} SELECT win, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def bootstrap_contrast_ci(spark, sf_dir):
    return rounded(contrast_intervals(spark, sf_dir))


@plan(f"""{BASE}{_CONTRAST}{_DRAWS}, {DEEP}, deep_c AS (SELECT win, avg(h) FILTER (sample < 15) - avg(h) FILTER (sample >= 15) AS deep FROM deep GROUP BY win)
SELECT win, round(h, 6) AS h, coalesce(deep * h > 0, false) AS same_when_deep, h_agree >= 0.8 AS agrees, h_median * h > 0 AS median_agrees, coalesce(low * high > 0, false) AS without_zero,
coalesce(deep * h > 0, false) AND h_agree >= 0.8 AND h_median * h > 0 AND coalesce(low * high > 0, false) AS stronger FROM contrast LEFT JOIN deep_c USING (win) LEFT JOIN ci USING (win)""")
def stronger_consistency(spark, sf_dir):
    """Windows whose contrast keeps its sign at a depth of ten and in the medians, in 0.8 of all pairs of samples, with an interval that leaves out 0."""
    deep = windows(spark, sf_dir, least=10).groupBy("win").agg((F.avg(F.when(F.col("sample") < 15, F.col("h"))) - F.avg(F.when(F.col("sample") >= 15, F.col("h")))).alias("deep"))
    c = contrasts(spark, sf_dir).join(deep, "win", "left").join(contrast_intervals(spark, sf_dir), "win", "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    c = c.select("win", "h", no(F.col("deep") * F.col("h") > 0).alias("same_when_deep"), (F.col("h_agree") >= 0.8).alias("agrees"), (F.col("h_median") * F.col("h") > 0).alias("median_agrees"), no(F.col("low") * F.col("high") > 0).alias("without_zero"))
    return rounded(c.withColumn("stronger", F.col("same_when_deep") & F.col("agrees") & F.col("median_agrees") & F.col("without_zero")))


@plan(f"""{BASE}{_CONTRAST}, x AS (SELECT win, sign(h)::INT AS s FROM contrast WHERE h <> 0),
n AS (SELECT *, CASE WHEN win - lag(win) OVER w = 1 AND s = lag(s) OVER w THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (ORDER BY win)),
r AS (SELECT *, sum(fresh) OVER (ORDER BY win) AS run FROM n)
SELECT s AS sign, min(win) AS first, max(win) AS last, count(*)::BIGINT AS n FROM r GROUP BY run, s""")
def adjacent_block_merge(spark, sf_dir):
    c = contrasts(spark, sf_dir).withColumn("chrom", F.lit(1))
    return intervals.merge_adjacent(c, ["chrom"], "win", F.signum("h").cast("int")).select("sign", "first", "last", "n")


@plan(f"""{BASE}{_CONTRAST}, x AS (SELECT win, sample, g, h, sum(h) OVER (PARTITION BY win, g) AS s, count(*) OVER (PARTITION BY win, g) AS n FROM g)
SELECT win, sample, round((s - h) / (n - 1), 6) AS mean_without, round(s / n - (s - h) / (n - 1), 6) AS influence FROM x""")
def pair_influence(spark, sf_dir):
    w = windows(spark, sf_dir).withColumn("g", F.col("sample") < 15)
    return rounded(rollups.influence(w, ["win", "g"], "h").select("win", "sample", "mean_without", "influence"))


@plan(f"""{BASE}, x AS (SELECT sample, win, h, sum(h) OVER (PARTITION BY sample) AS s, count(*) OVER (PARTITION BY sample) AS n FROM windows),
y AS (SELECT win, sample < 15 AS g, avg((s - h) / (n - 1)) AS a, avg(s / n) AS b FROM x GROUP BY 1, 2)
SELECT win, round(max(b) FILTER (g) - max(b) FILTER (NOT g) - max(a) FILTER (g) + max(a) FILTER (NOT g), 6) AS influence FROM y GROUP BY win""")
def locus_influence(spark, sf_dir):
    x = rollups.influence(windows(spark, sf_dir), ["sample"], "h").withColumn("g", F.col("sample") < 15)
    # One locus left out everywhere: the group means move by the mean of the samples' own influences.
    y = x.groupBy("win").agg(F.avg(F.when(F.col("g"), F.col("influence"))).alias("a"), F.avg(F.when(~F.col("g"), F.col("influence"))).alias("b"))
    return rounded(y.select("win", (F.col("a") - F.col("b")).alias("influence")))


@plan(f"""{BASE}, b AS (SELECT sample, win, (win % 4)::BIGINT AS bin, h FROM windows),
d AS (SELECT x.sample, x.win AS a, y.win AS b, x.h - y.h AS d FROM windows x JOIN windows y ON x.sample = y.sample AND y.win = x.win + 1),
p AS (SELECT sample, floor(a / 2)::BIGINT AS pair, avg(d) AS d FROM d GROUP BY 1, 2)
SELECT sample, CASE WHEN count(*) >= 3 THEN round(avg(d), 6) END AS score, count(*)::BIGINT AS pairs FROM p GROUP BY sample""")
def bins_to_patient_mean(spark, sf_dir):
    w = windows(spark, sf_dir).select("sample", "win", "h")
    n = w.select("sample", (F.col("win") - 1).alias("win"), F.col("h").alias("other"))
    d = w.join(n, ["sample", "win"]).withColumn("d", F.col("h") - F.col("other")).withColumn("pair", F.floor(F.col("win") / 2))
    out = rollups.gated_rollup(d, [(["sample", "pair"], 1), (["sample"], 3)], "d")
    return rounded(out.select("sample", F.col("d").alias("score"), F.col("n").alias("pairs")))


@plan("""
WITH b AS (SELECT c_nationkey AS sample, l_suppkey AS locus, floor(l_partkey / 50)::BIGINT AS block, avg(l_discount) AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
g AS (SELECT sample, locus, CASE WHEN count(*) >= 3 THEN avg(v) END AS v FROM b GROUP BY 1, 2),
s AS (SELECT sample, CASE WHEN count(v) >= 6 THEN avg(v) END AS v, count(v) AS n FROM g GROUP BY 1)
SELECT sample, round(v, 6) AS v, n::BIGINT AS n FROM s
""")
def block_rollup_gated(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("locus"), F.floor(F.col("l_partkey") / 50).alias("block"), F.col("l_discount").alias("v"))
    j = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sample")), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(rollups.gated_rollup(j, [(["sample", "locus", "block"], 1), (["sample", "locus"], 3), (["sample"], 6)], "v").select("sample", "v", "n"))


@plan(f"""WITH {CELLS}, s AS (SELECT site, count(*) FILTER (c + m + h >= 10) AS n10, count(*) FILTER (c + m + h >= 20) AS n20 FROM cells GROUP BY site),
k AS (SELECT CASE WHEN count(*) FILTER (n10 = {N_SAMPLES}) >= 50 THEN {N_SAMPLES} ELSE 16 END AS need FROM s)
SELECT site, n10::BIGINT AS n10, n20::BIGINT AS n20, n10 >= (SELECT need FROM k) AS in_panel FROM s""")
def support_panel_gate(spark, sf_dir):
    cell = cells(spark, sf_dir).withColumn("depth", F.col("c") + F.col("m") + F.col("h"))
    s = cell.groupBy("site").agg(F.count_if(F.col("depth") >= 10).alias("n10"), F.count_if(F.col("depth") >= 20).alias("n20"))
    n = sample_count(cell)
    full = s.crossJoin(F.broadcast(n)).agg(F.count_if(F.col("n10") == F.col("n_samples")).alias("full"), F.max("n_samples").alias("n_samples"))
    need = full.select(F.when(F.col("full") >= 50, F.col("n_samples")).otherwise(16).alias("need"))
    return s.crossJoin(F.broadcast(need)).select("site", "n10", "n20", (F.col("n10") >= F.col("need")).alias("in_panel"))
