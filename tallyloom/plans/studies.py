"""Composite plans: reselection under random labels, two-level bootstraps, sensitivity, variants, stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import draw_order
from ..operators import intervals, matching, ranking, resampling, rollups, sequences, statistics, studies
from .inference import points
from ..operators.rounds import passed_on
from .molecules import _MATRIX, matrix
from .registry import BASE, CELLS, SUPPORT, cells, plan, rounded, supported, table, windows

_LABELS = """lab AS (SELECT alloc, sample, CASE WHEN alloc = 0 THEN sample < 10 ELSE row_number() OVER (PARTITION BY alloc ORDER BY sha256(concat_ws('|', 'sel', alloc::VARCHAR, sample::VARCHAR))) <= 10 END AS inside
FROM (SELECT range AS alloc FROM range(0, 500)), (SELECT DISTINCT sample FROM windows))"""


@plan(f"""{BASE}, {_LABELS}, e AS (SELECT alloc, win, avg(h) FILTER (inside) - avg(h) FILTER (NOT inside) AS d FROM windows JOIN lab USING (sample) GROUP BY 1, 2),
b AS (SELECT alloc, win, d, row_number() OVER (PARTITION BY alloc ORDER BY abs(d) DESC, win) AS k FROM e), t AS (SELECT alloc, win, abs(d) AS stat FROM b WHERE k = 1)
SELECT max(win) FILTER (alloc = 0) AS win, round(max(stat) FILTER (alloc = 0), 6) AS statistic, round((1 + count(*) FILTER (alloc > 0 AND stat >= (SELECT stat FROM t WHERE alloc = 0) - 1e-12)) / 500.0, 6) AS p FROM t""")
def label_reselection(spark, sf_dir):
    """The whole selection is repeated under every random labelling, and the best window is compared with the best of each."""
    w = windows(spark, sf_dir)
    samples = w.select("sample").distinct().withColumn("alloc", F.explode(F.sequence(F.lit(0), F.lit(499))))
    n = F.row_number().over(Window.partitionBy("alloc").orderBy(draw_order(F.lit("sel"), F.col("alloc"), F.col("sample"))))
    labels = samples.withColumn("inside", F.when(F.col("alloc") == 0, F.col("sample") < 10).otherwise(n <= 10))
    e = w.join(labels, "sample").groupBy("alloc", "win").agg((F.avg(F.when(F.col("inside"), F.col("h"))) - F.avg(F.when(~F.col("inside"), F.col("h")))).alias("d"))
    best = ranking.top_k(e, ["alloc"], [F.desc(F.abs("d")), F.asc("win")], 1).withColumn("stat", F.abs("d"))
    seen = best.where("alloc = 0").select(F.col("win").alias("w0"), F.col("stat").alias("s0"))
    out = best.crossJoin(F.broadcast(seen)).agg(F.max("w0").alias("win"), F.max("s0").alias("statistic"), ((1 + F.count_if((F.col("alloc") > 0) & (F.col("stat") >= F.col("s0") - 1e-12))) / F.lit(500.0)).alias("p"))
    return rounded(out)


_NESTED = f"""{_LABELS}, x AS (SELECT w.sample, w.win, w.win % 3 AS stratum, w.h, lab.alloc, lab.inside FROM windows w JOIN lab USING (sample)),
y AS (SELECT *, coalesce(sum(h) FILTER (inside) OVER g, 0) AS s1, count(*) FILTER (inside) OVER g AS n1, coalesce(sum(h) FILTER (NOT inside) OVER g, 0) AS s0, count(*) FILTER (NOT inside) OVER g AS n0 FROM x WINDOW g AS (PARTITION BY alloc, win)),
d AS (SELECT alloc, sample AS fold, win, stratum, round(abs((s1 - CASE WHEN inside THEN h ELSE 0 END) / (n1 - inside::INT) - (s0 - CASE WHEN inside THEN 0 ELSE h END) / (n0 - (NOT inside)::INT)), 9) AS size FROM y WHERE n1 > inside::INT AND n0 > (NOT inside)::INT),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY alloc, fold ORDER BY size DESC, win) <= 3), k AS (SELECT alloc, fold, stratum, arg_min(win, (size, win)) AS other FROM d GROUP BY 1, 2, 3),
p AS (SELECT b.alloc, b.fold, b.win, k.other FROM b JOIN k USING (alloc, fold, stratum) WHERE NOT EXISTS (SELECT 1 FROM b t WHERE t.alloc = k.alloc AND t.fold = k.fold AND t.win = k.other)),
v AS (SELECT sample AS fold, floor((site - 1) / 10)::BIGINT AS win, (site - 1) % 10 % 8 AS part, avg(100.0 * h::DOUBLE / (c + m + h)) AS v FROM cells JOIN support USING (site) GROUP BY 1, 2, 3),
g AS (SELECT p.alloc, p.fold, p.win, a.part, a.v - o.v AS gap FROM p JOIN v a ON a.fold = p.fold AND a.win = p.win JOIN v o ON o.fold = p.fold AND o.win = p.other AND o.part = a.part),
r AS (SELECT a.range AS first, b.range AS last FROM range(0, 8) a, range(0, 8) b WHERE a.range <= b.range), e AS (SELECT alloc, fold, win, first, last, avg(gap) AS gap FROM g JOIN r ON part BETWEEN first AND last GROUP BY ALL),
z AS (SELECT alloc, fold, first, last, avg(gap) AS score FROM e GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT z.*, lab.inside FROM z JOIN lab ON lab.alloc = z.alloc AND lab.sample = z.fold),
w1 AS (SELECT alloc, first, last, avg(score) FILTER (inside) - avg(score) FILTER (NOT inside) AS effect, CASE WHEN count(*) FILTER (inside) >= 3 AND count(*) FILTER (NOT inside) >= 10 THEN round(abs(avg(score) FILTER (inside) - avg(score) FILTER (NOT inside))
  / sqrt(var_samp(score) FILTER (inside) / count(*) FILTER (inside) + var_samp(score) FILTER (NOT inside) / count(*) FILTER (NOT inside)), 9) ELSE 0 END AS statistic FROM u GROUP BY ALL),
mo AS (SELECT a.alloc, coalesce(max(statistic), 0) AS most FROM (SELECT DISTINCT alloc FROM lab) a LEFT JOIN w1 USING (alloc) GROUP BY 1)"""


@plan(f"""{BASE}, {_NESTED} SELECT first, last, round(effect, 6) AS effect, round(statistic, 6) AS statistic, round((1 + (SELECT count(*) FROM mo WHERE alloc <> 0 AND most >= w1.statistic)) / 500.0, 6) AS p FROM w1 WHERE alloc = 0""")
def nested_reselection(spark, sf_dir):
    """500 labellings, every sample held out in turn, 36 ranges of eight parts of a window."""
    w = passed_on(windows(spark, sf_dir).select("sample", "win", "h"))
    samples = w.select("sample").distinct().withColumn("alloc", F.explode(F.sequence(F.lit(0), F.lit(499))))
    n = F.row_number().over(Window.partitionBy("alloc").orderBy(draw_order(F.lit("sel"), F.col("alloc"), F.col("sample"))))
    labels = samples.withColumn("inside", F.when(F.col("alloc") == 0, F.col("sample") < 10).otherwise(n <= 10))
    cell = cells(spark, sf_dir)
    sites = cell.join(supported(cell), "site").select("sample", F.floor((F.col("site") - 1) / 10).alias("win"), ((F.col("site") - 1) % 10 % 8).cast("int").alias("part"), (100.0 * F.col("h") / (F.col("c") + F.col("m") + F.col("h"))).alias("h"))
    return rounded(studies.nested_reselection(w, sites, labels, "sample", "win", "h", F.col("win") % 3, "part", 8))


_H = lambda *k: "('0x' || substr(sha256(concat_ws('|', " + ", ".join(k) + ")), 1, 8))::BIGINT"


@plan(f"""{BASE}, mol AS (SELECT sample, (win % 3)::BIGINT AS rep, avg(h) AS v FROM windows GROUP BY 1, 2), pat AS (SELECT sample < 15 AS grp, sample, row_number() OVER (PARTITION BY sample < 15 ORDER BY sample) - 1 AS k, count(*) OVER (PARTITION BY sample < 15) AS n FROM (SELECT DISTINCT sample FROM windows)),
d AS (SELECT grp, draw, k AS slot, {_H("'two'", "draw::VARCHAR", "k::VARCHAR")} % n AS pick, {_H("'two'", "'r'", "draw::VARCHAR", "k::VARCHAR")} % 3 AS rep FROM pat, (SELECT range AS draw FROM range(0, 10000))),
m AS (SELECT d.grp, d.draw, avg(mol.v) AS mean FROM d JOIN pat p ON p.grp = d.grp AND p.k = d.pick JOIN mol ON mol.sample = p.sample AND mol.rep = d.rep GROUP BY 1, 2)
SELECT grp, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY grp""")
def two_level_bootstrap(spark, sf_dir):
    w = windows(spark, sf_dir)
    mol = w.groupBy("sample", (F.col("win") % 3).alias("rep")).agg(F.avg("h").alias("v"))
    pat = w.select("sample").distinct().withColumn("grp", F.col("sample") < 15)
    return rounded(resampling.interval(studies.two_level_bootstrap(pat, mol, "grp", "sample", "rep", "v", 10_000, 3, "two"), ["grp"], "mean"))


@plan(f"""{BASE}, q AS (SELECT sample, win % 2 AS locus, unnest(quantile_cont(h, {[(2 * k + 1) / 2000 for k in range(1000)]})) AS q, unnest(range(0, 1000)) AS k FROM windows GROUP BY 1, 2),
c AS (SELECT sample, locus, k, q - avg(q) OVER (PARTITION BY sample, locus) AS q FROM q) SELECT locus, k, round(avg(q), 6) AS q FROM c GROUP BY 1, 2""")
def coupled_null_quantiles(spark, sf_dir):
    """Comonotone null of a cohort: centred mid-quantiles of each sample, averaged at equal rank."""
    q = resampling.coupled_quantiles(windows(spark, sf_dir).withColumn("locus", F.col("win") % 2), ["sample", "locus"], "h", 1000)
    return rounded(q.select("locus", F.posexplode("q").alias("k", "q")).groupBy("locus", F.col("k").cast("long").alias("k")).agg(F.avg("q").alias("q")))


@plan(f"""{BASE}, s AS (SELECT scale FROM (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) t(scale)), v AS (SELECT win, stddev_pop(m) AS sm, stddev_pop(h) AS sh FROM windows GROUP BY win),
l AS (SELECT win, scale, CASE WHEN greatest(sm, sh) < 2.5 * scale THEN 'LOW' WHEN sh >= 1.1 * sm * scale THEN 'SECOND' WHEN sm >= 1.1 * sh * scale THEN 'FIRST' ELSE 'UNRESOLVED' END AS label FROM v, s)
SELECT win, max(label) FILTER (scale = 1.0) AS label, count(DISTINCT label) = 1 AS stable FROM l GROUP BY win""")
def threshold_sensitivity(spark, sf_dir):
    """An ordered label ladder at three scales of its thresholds; stable if all agree."""
    v = windows(spark, sf_dir).groupBy("win").agg(F.stddev_pop("m").alias("sm"), F.stddev_pop("h").alias("sh")).withColumn("scale", F.explode(F.array(F.lit(0.8), F.lit(1.0), F.lit(1.2))))
    s, sm, sh = F.col("scale"), F.col("sm"), F.col("sh")
    label = F.when(F.greatest(sm, sh) < 2.5 * s, "LOW").when(sh >= 1.1 * sm * s, "SECOND").when(sm >= 1.1 * sh * s, "FIRST").otherwise("UNRESOLVED")
    d = v.withColumn("label", label)
    return d.groupBy("win").agg(F.max(F.when(s == 1.0, F.col("label"))).alias("label"), (F.countDistinct("label") == 1).alias("stable"))


_PILE = """pile AS (SELECT p_size AS pos, substr(p_type, 1, 1) AS base, count(*) AS n FROM part GROUP BY 1, 2)"""


@plan("""WITH s AS (SELECT p_partkey % 7 AS start, upper(p_brand) AS seq FROM part), b AS (SELECT start + i - 1 AS pos, substr(seq, i::INTEGER, 1) AS base FROM s, unnest(range(1, length(seq) + 1)) t(i)) SELECT pos, base, count(*)::BIGINT AS n FROM b GROUP BY 1, 2""")
def pileup_counts(spark, sf_dir):
    return studies.pileup(table(spark, sf_dir, "part"), "p_partkey", "p_brand", F.col("p_partkey") % 7)


@plan(f"""WITH {_PILE}, r AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS depth, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS k FROM pile),
g AS (SELECT pos, max(depth) AS depth, max(base) FILTER (k = 1) AS ref, max(base) FILTER (k = 2) AS alt, max(n) FILTER (k = 1) AS r, max(n) FILTER (k = 2) AS a FROM r WHERE k <= 2 GROUP BY pos)
SELECT pos, ref, alt, depth::BIGINT AS depth, round(a::DOUBLE / depth, 6) AS fraction FROM g WHERE depth >= 16 AND a >= 4 AND (r + a)::DOUBLE / depth >= 0.3 AND a::DOUBLE / depth BETWEEN 0.1 AND 0.75""")
def variant_filter(spark, sf_dir):
    pile = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("pos"), F.substring("p_type", 1, 1).alias("base")).agg(F.count("*").alias("n"))
    return rounded(studies.variants(pile, ["pos"], each=4, covered=0.3, low=0.1))


@plan(f"""WITH {_MATRIX}, al AS (SELECT l_orderkey AS mol, CASE max(l_linestatus) WHEN 'O' THEN 'ref' WHEN 'F' THEN 'alt' END AS allele FROM lineitem GROUP BY 1),
s AS (SELECT locus, site, avg(v) FILTER (allele = 'ref') - avg(v) FILTER (allele = 'alt') AS d FROM mx JOIN al USING (mol) GROUP BY 1, 2 HAVING count(*) FILTER (allele = 'ref') >= 5 AND count(*) FILTER (allele = 'alt') >= 5)
SELECT locus, count(*)::BIGINT AS sites, round(avg(d), 6) AS difference, round(greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0))::DOUBLE / count(*), 6) AS agreement FROM s GROUP BY locus""")
def allele_comparison(spark, sf_dir):
    """Molecules are assigned to an allele by id; sites weigh the same whatever their depth."""
    allele = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol")).agg(F.max("l_linestatus").alias("s")).select("mol", F.when(F.col("s") == "O", "ref").when(F.col("s") == "F", "alt").alias("allele"))
    d = matrix(spark, sf_dir).join(allele, "mol", "left")
    ref, alt = F.when(F.col("allele") == "ref", F.col("v")), F.when(F.col("allele") == "alt", F.col("v"))
    s = d.groupBy("locus", "site").agg((F.avg(ref) - F.avg(alt)).alias("d"), F.count(ref).alias("r"), F.count(alt).alias("a")).where("r >= 5 AND a >= 5")
    return rounded(s.groupBy("locus").agg(F.count("*").alias("sites"), F.avg("d").alias("difference"), (F.greatest(F.count_if(F.col("d") > 0), F.count_if(F.col("d") < 0)) / F.count("*")).alias("agreement")))


@plan(f"""{BASE}, t AS (SELECT sample, win, h - avg(h) OVER (PARTITION BY sample) AS v FROM windows), s AS (SELECT a.win, o.sample AS omit, avg(a.v) AS mean, stddev_samp(a.v) AS sd, count(*) AS n FROM t a JOIN (SELECT DISTINCT sample FROM t) o ON a.sample <> o.sample GROUP BY 1, 2),
p AS (SELECT win, omit, least(1.0, 1.0 / (1 + (mean / (sd / sqrt(n))) ** 2)) AS p FROM s), r AS (SELECT *, p * count(*) OVER (PARTITION BY omit) / (rank() OVER (PARTITION BY omit ORDER BY p) + count(*) OVER (PARTITION BY omit, p) - 1) AS x FROM p),
q AS (SELECT win, omit, least(1, min(x) OVER (PARTITION BY omit ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r) SELECT win, round(max(q), 6) AS worst_q, round(avg((q < 0.05)::INT), 6) AS share FROM q GROUP BY win""")
def leave_one_out_fdr(spark, sf_dir):
    w = windows(spark, sf_dir)
    t = w.withColumn("v", F.col("h") - F.avg("h").over(Window.partitionBy("sample")))
    z = F.col("mean") / (F.col("sd") / F.sqrt("n"))
    return rounded(studies.leave_one_out_fdr(t.select("win", "sample", "v"), "win", "sample", "v", F.least(F.lit(1.0), 1 / (1 + z * z))))


@plan(f"""WITH {CELLS}, {SUPPORT} SELECT sample, count(*)::BIGINT AS loci, round(avg(h::DOUBLE / (c + m + h)), 6) AS mean FROM cells JOIN support USING (site) GROUP BY sample""")
def loci_in_every_sample(spark, sf_dir):
    cell = cells(spark, sf_dir)
    k = cell.join(supported(cell), "site")
    return rounded(k.groupBy("sample").agg(F.count("*").alias("loci"), F.avg(F.col("h") / (F.col("c") + F.col("m") + F.col("h"))).alias("mean")))


@plan(f"""WITH {_MATRIX}, p AS (SELECT a.locus, b.site - a.site AS dist, avg(a.v * b.v) AS ab, count(*) AS n FROM mx a JOIN mx b ON a.locus = b.locus AND a.mol = b.mol AND a.site < b.site GROUP BY 1, 2, a.site),
l AS (SELECT locus, CASE WHEN dist < 2 THEN 0 WHEN dist < 4 THEN 1 ELSE 2 END AS bin, CASE WHEN count(*) >= 3 THEN avg(ab) END AS v FROM p GROUP BY 1, 2)
SELECT bin, CASE WHEN count(v) >= 30 THEN round(avg(v), 6) END AS v, count(v)::BIGINT AS n FROM l GROUP BY bin""")
def background_curve(spark, sf_dir):
    """Distance bins with half-open edges; a locus needs three pairs, a bin thirty loci."""
    pairs = sequences.pair_counts(matrix(spark, sf_dir), ["locus"], "mol", "site", "v")
    d = pairs.withColumn("dist", F.col("j") - F.col("i")).withColumn("bin", F.when(F.col("dist") < 2, 0).when(F.col("dist") < 4, 1).otherwise(2)).withColumn("v", F.col("ab") / F.col("n"))
    return rounded(rollups.gated_rollup(d, [(["locus", "bin"], 3), (["bin"], 30)], "v").select("bin", "v", "n"))


@plan("""WITH b AS (SELECT p_partkey AS block, [p_partkey * 37 % 50000, p_partkey * 37 % 50000 + 3 + p_size, p_partkey * 37 % 50000 + 9 + 2 * p_size] AS sites FROM part),
r AS (SELECT s_suppkey * 53 % 50000 AS s, s_suppkey * 53 % 50000 + 4 + s_nationkey AS e FROM supplier), x AS (SELECT block, unnest(sites) AS p FROM b)
SELECT block FROM b WHERE block NOT IN (SELECT block FROM x JOIN r ON p < e AND p + 2 > s)""")
def repeat_exclusion(spark, sf_dir):
    """Blocks none of whose three two-base sites touches a repeat: parts' sites, suppliers' repeats."""
    at = F.col("p_partkey") * 37 % 50_000
    sites = F.array(at, at + 3 + F.col("p_size"), at + 9 + 2 * F.col("p_size"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), F.explode(sites).alias("start")).withColumn("end", F.col("start") + 2)
    start = F.col("s_suppkey") * 53 % 50_000
    r = table(spark, sf_dir, "supplier").select(start.alias("start"), (start + 4 + F.col("s_nationkey")).alias("end"))
    return intervals.overlap_join(b, r, [], bin_size=64, how="left_anti").select(F.col("_id").alias("block")).distinct()


@plan("""WITH g AS (SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS id, max(p_size) AS size FROM part GROUP BY 1) SELECT p_brand, id, greatest(0, size * 500 - 10000)::BIGINT AS low, (size * 500 + 10000)::BIGINT AS high FROM g""")
def group_representative(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("id"), F.max("p_size").cast("long").alias("size"))
    return g.select("p_brand", "id", F.greatest(F.lit(0), F.col("size") * 500 - 10000).cast("long").alias("low"), (F.col("size") * 500 + 10000).alias("high"))


@plan("""WITH p AS (SELECT *, p_retailprice AS w, p_size::DOUBLE AS depth FROM part) SELECT t.p_partkey, c.p_partkey AS control FROM p t JOIN p c ON t.p_partkey % 20 = 0 AND c.p_partkey % 20 <> 0 AND t.p_brand = c.p_brand
AND c.w / t.w BETWEEN 0.8 AND 1.25 AND c.depth / t.depth BETWEEN 2.0 / 3 AND 1.5""")
def caliper_pools(spark, sf_dir):
    """Every admissible control of each target: ratio bands around weight and depth within a context."""
    targets, controls = pool_sides(spark, sf_dir)
    return matching.caliper_pairs(targets, controls, ["p_brand"], {"p_retailprice": (0.8, 1.25), "depth": (2.0 / 3, 1.5)}, "p_partkey")


_PLACE = ["p_brand", "p_retailprice", "depth"]


def pool_sides(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("depth"))
    return p.where("p_partkey % 20 = 0"), p.where("p_partkey % 20 <> 0")


def pool_places(targets, controls):
    """Admissible pairs of distinct (context, weight, depth): those of a target and those of a control, so parts of equal values are compared once."""
    a, b = (d.select(*_PLACE).distinct().withColumn("side", F.lit(k)) for k, d in enumerate((targets, controls)))
    m = matching.caliper_matches(a, b, ["p_brand"], {"p_retailprice": 1.2501, "depth": 1.5001}, "side", None)
    ok = (F.col("c_p_retailprice") / F.col("p_retailprice")).between(0.8, 1.25) & (F.col("c_depth") / F.col("depth")).between(2.0 / 3, 1.5)
    return m.where(ok).select(*_PLACE, "c_p_retailprice", "c_depth")


_POOL = """p AS (SELECT p_partkey, p_brand, p_retailprice AS w, p_size::DOUBLE AS depth FROM part),
pool AS (SELECT t.p_partkey AS target, c.p_partkey AS control FROM p t JOIN p c ON t.p_partkey % 20 = 0 AND c.p_partkey % 20 <> 0 AND t.p_brand = c.p_brand AND c.w / t.w BETWEEN 0.8 AND 1.25 AND c.depth / t.depth BETWEEN 2.0 / 3 AND 1.5),
five AS (SELECT DISTINCT target FROM pool ORDER BY target LIMIT 5)"""


@plan(f"""WITH {_POOL}, r AS (SELECT range AS rep FROM range(0, 10000)), k AS (SELECT rep, target, arg_min(control, sha256(concat_ws('|', 'set', rep::VARCHAR, target::VARCHAR, control::VARCHAR))) AS control FROM pool JOIN five USING (target), r GROUP BY 1, 2),
s AS (SELECT rep, sum(control % 97)::DOUBLE AS score FROM k GROUP BY rep HAVING count(DISTINCT control) = count(*)), o AS (SELECT sum(target % 97)::DOUBLE AS seen FROM five)
SELECT (SELECT seen FROM o) AS observed, count(*)::BIGINT AS sets, round((1 + count(*) FILTER (score >= (SELECT seen FROM o))) / (1.0 + count(*)), 6) AS p FROM s""")
def matched_set_null(spark, sf_dir):
    """Sets of one control per target of a five-target design; a set that takes a control twice is rejected.

    Pools are made of the first targets alone, of as many as it takes to find five with a control. A draw is the pool
    member with the least digest: the least of each part of about 256 members in its row, then a grouped minimum.
    """
    targets, controls = pool_sides(spark, sf_dir)
    n, all_targets = 64, targets.count()
    while True:
        first = passed_on(targets.orderBy("p_partkey").limit(n))
        pairs = pool_places(first, controls).join(first.select(F.col("p_partkey").alias("target"), *_PLACE), _PLACE)
        five = passed_on(pairs.select("target").distinct().orderBy("target").limit(5))
        if five.count() == 5 or n >= all_targets:
            break
        n *= 16
    c = controls.select(F.col("p_partkey").alias("control"), "p_brand", F.col("p_retailprice").alias("c_p_retailprice"), F.col("depth").alias("c_depth"))
    pool = passed_on(pairs.join(F.broadcast(five), "target", "left_semi").join(c, ["p_brand", "c_p_retailprice", "c_depth"]).select("target", "control"))
    parts = pool.count() // (5 * 256) + 1
    members = pool.groupBy("target", F.pmod(F.xxhash64("control"), F.lit(parts)).alias("_part")).agg(F.collect_list("control").alias("_c"))
    # A hundred replicates at a time, so the few parts spread over all tasks.
    dealt = members.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(99)))).repartition(min(2000, 96 + parts // 4), "target", "_part", "_block")
    dealt = dealt.withColumn("rep", F.explode(F.sequence(F.col("_block") * 100, F.col("_block") * 100 + 99)))
    best = F.array_min(F.transform("_c", lambda x: F.struct(draw_order(F.lit("set"), F.col("rep"), F.col("target"), x).alias("h"), x.alias("c"))))
    k = dealt.select("rep", "target", best.alias("_b")).groupBy("rep", "target").agg(F.min("_b")["c"].alias("control"))
    sets = k.groupBy("rep").agg(F.sum(F.col("control") % 97).cast("double").alias("score"), F.countDistinct("control").alias("d"), F.count("*").alias("n")).where("d = n")
    seen = five.agg(F.sum(F.col("target") % 97).cast("double").alias("observed"))
    counted = sets.crossJoin(F.broadcast(seen)).agg(F.count("*").alias("sets"), ((1 + F.count_if(F.col("score") >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))
    return rounded(counted.crossJoin(F.broadcast(seen)).select("observed", "sets", "p"))  # one row by one row


_MIDDLE = "(min(v) FILTER (u >= (t + 1) // 2) + min(v) FILTER (u >= (t + 2) // 2)) / 2"


@plan(f"""WITH pt AS (SELECT c_custkey // 1500 AS block, c_nationkey AS nation, c_custkey AS id, (c_custkey % 50)::DOUBLE AS x, c_acctbal AS y FROM customer),
z AS (SELECT block, id, x, y, row_number() OVER (PARTITION BY block ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY block) AS n FROM pt WHERE nation < 5), sl AS (SELECT a.block, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM z a JOIN z b ON a.block = b.block AND a.id < b.id AND a.x <> b.x GROUP BY 1),
line AS (SELECT block, any_value(slope) AS slope, quantile_cont(y - slope * x, 0.5) AS intercept, min(x) AS lo, max(x) AS hi FROM z JOIN sl USING (block) GROUP BY 1), reps AS (SELECT range AS rep FROM range(0, 200)),
d AS (SELECT block, rep, ('0x' || substr(sha256(concat_ws('|', 'dev', rep::VARCHAR, place::VARCHAR)), 1, 8))::BIGINT % n AS place FROM z, reps), k AS (SELECT block, rep, place, count(*) AS k FROM d GROUP BY ALL), s AS (SELECT block, rep, id, x, y, k FROM k JOIN z USING (block, place)),
p AS (SELECT a.block, a.rep, (b.y - a.y) / (b.x - a.x) AS v, a.k * b.k AS w FROM s a JOIN s b ON a.block = b.block AND a.rep = b.rep AND a.id < b.id AND a.x <> b.x), c AS (SELECT block, rep, v, sum(w) OVER (PARTITION BY block, rep ORDER BY v RANGE UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY block, rep) AS t FROM p),
m AS (SELECT block, rep, {_MIDDLE} AS slope FROM c GROUP BY ALL), e AS (SELECT block, rep, slope, y - slope * x AS v, k AS w FROM s JOIN m USING (block, rep)), f AS (SELECT *, sum(w) OVER (PARTITION BY block, rep ORDER BY v RANGE UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY block, rep) AS t FROM e),
refit AS (SELECT block, rep, any_value(slope) AS slope, {_MIDDLE} AS intercept FROM f GROUP BY ALL),
g AS (SELECT block, nation, id, x, y, slope, intercept, row_number() OVER (PARTITION BY block, nation ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY block, nation) AS n FROM pt JOIN line USING (block) WHERE nation >= 5 AND x BETWEEN lo AND hi),
h AS (SELECT block, nation, n, rep, ('0x' || substr(sha256(concat_ws('|', 'devd', rep::VARCHAR, place::VARCHAR)), 1, 8))::BIGINT % n AS place FROM g, reps),
b AS (SELECT h.block, h.nation, h.rep, avg(g.x) AS x, avg(g.y) AS y FROM h JOIN g ON g.block = h.block AND g.nation = h.nation AND g.place = h.place GROUP BY 1, 2, 3),
v AS (SELECT block, nation, quantile_cont(b.y - slope * b.x - intercept, 0.025) AS low, quantile_cont(b.y - slope * b.x - intercept, 0.975) AS high FROM b JOIN refit USING (block, rep) GROUP BY 1, 2)
SELECT block, nation, count(*)::BIGINT AS n, round(avg(y - slope * x - intercept), 6) AS deviation, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM g LEFT JOIN v USING (block, nation) GROUP BY block, nation""")
def trajectory_deviation(spark, sf_dir):
    """Mean distance from the reference cohort's line, inside its range only, with an interval of joint draws of both.

    Cohorts are customers that follow each other, 1500 at a time; the reference in each are its first five nations.
    """
    p = points(spark, sf_dir).withColumn("block", F.floor(F.col("id") / 1500))
    return rounded(statistics.line_deviation(p.where("nation >= 5"), p.where("nation < 5").drop("nation"), ["block"], ["nation"], "x", "y", "id", 200, "dev"))


@plan(f"""{BASE}, f AS (SELECT w.sample, win, h, m, c.bal FROM windows w JOIN (SELECT c_nationkey AS sample, avg(c_acctbal) AS bal FROM customer GROUP BY 1) c USING (sample)),
u AS (SELECT win, sample, 'h' AS feature, h AS v, bal FROM f UNION ALL SELECT win, sample, 'm', m, bal FROM f),
r AS (SELECT win, feature, rank() OVER (PARTITION BY win, feature ORDER BY v) + (count(*) OVER (PARTITION BY win, feature, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY win, feature ORDER BY bal) + (count(*) OVER (PARTITION BY win, feature, bal) - 1) / 2.0 AS ry FROM u)
SELECT win, feature, count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2""")
def association_scan(spark, sf_dir):
    """Rank correlation of every (locus, feature) with one covariate, all groups in one pass."""
    bal = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("sample")).agg(F.avg("c_acctbal").alias("bal"))
    u = windows(spark, sf_dir).select("win", "sample", F.expr("stack(2, 'h', h, 'm', m) AS (feature, v)")).join(bal, "sample")
    return rounded(statistics.spearman(u, ["win", "feature"], "v", "bal"))


def _rank_sql(c: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)::DOUBLE"


@plan(f"""{BASE}, k AS (SELECT sample, win, h, m, (h - m) / 10 AS part FROM windows), o AS (SELECT sample, sum(part) AS whole FROM k GROUP BY 1), ring AS (SELECT sample, lead(sample, 1, first) OVER (ORDER BY sample) AS other FROM (SELECT DISTINCT sample, min(sample) OVER () AS first FROM k)),
u AS (SELECT k.sample, k.win, o.whole AS raw, round(o.whole - k.part, 9) AS y, round(o2.whole - k2.part, 9) AS control, unnest(['balance', 'h', 'm', 'total']) AS feature, unnest([CASE WHEN k.h + k.m >= 10 THEN k.m / (k.h + k.m) END, k.h, k.m, k.h + k.m]) AS x
 FROM k JOIN o USING (sample) JOIN ring USING (sample) JOIN o o2 ON o2.sample = ring.other JOIN k k2 ON k2.sample = ring.other AND k2.win = k.win),
g AS (SELECT * FROM u WHERE x IS NOT NULL QUALIFY count(*) OVER (PARTITION BY win, feature) >= 18 AND stddev_pop(x) OVER (PARTITION BY win, feature) >= 0.02),
r AS (SELECT win, feature, sample, x, {_rank_sql('x', 'win, feature')} AS rx, {_rank_sql('y', 'win, feature')} AS ry, {_rank_sql('raw', 'win, feature')} AS rr, {_rank_sql('control', 'win, feature')} AS rc, y FROM g),
s AS (SELECT win, feature, count(*)::BIGINT AS n, corr(rx, ry) AS rho, corr(rx, rr) AS raw_rho, corr(rx, rc) AS control_rho FROM r GROUP BY 1, 2), reps AS (SELECT range AS rep FROM range(1, 5000)),
d AS (SELECT win, feature, rep, rx, ry, rc, row_number() OVER (PARTITION BY win, feature, rep ORDER BY sample) AS k, row_number() OVER (PARTITION BY win, feature, rep ORDER BY sha256(concat_ws('|', 'scan', rep::VARCHAR, sample::VARCHAR))) AS t FROM r, reps),
n AS (SELECT a.win, a.feature, a.rep, corr(a.rx, b.ry) AS null_rho, corr(a.rx, b.rc) AS other FROM d a JOIN d b ON a.win = b.win AND a.feature = b.feature AND a.rep = b.rep AND a.k = b.t GROUP BY 1, 2, 3),
p AS (SELECT win, feature, (1 + count(*) FILTER (abs(null_rho) >= abs(rho) - 1e-12)) / 5000.0 AS p, (1 + count(*) FILTER (rep <= 999 AND abs(other) >= abs(control_rho) - 1e-12)) / 1000.0 AS control_p FROM n JOIN s USING (win, feature) GROUP BY 1, 2),
l0 AS (SELECT a.win, a.feature, a.sample AS gone, {_rank_sql('b.x', 'a.win, a.feature, a.sample')} AS rx, {_rank_sql('b.y', 'a.win, a.feature, a.sample')} AS ry FROM r a JOIN r b ON a.win = b.win AND a.feature = b.feature AND a.sample <> b.sample),
l1 AS (SELECT win, feature, gone, corr(rx, ry) AS l FROM l0 GROUP BY 1, 2, 3), l AS (SELECT win, feature, min(l) AS loo_min, max(l) AS loo_max, min(abs(l)) AS min_abs_loo, bool_and(sign(l) = sign(rho)) AS loo_same_sign FROM l1 JOIN s USING (win, feature) GROUP BY 1, 2),
b AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k1, rank() OVER (ORDER BY control_p) + count(*) OVER (PARTITION BY control_p) - 1 AS k2, count(*) OVER () AS tests FROM s JOIN p USING (win, feature) JOIN l USING (win, feature)),
q AS (SELECT *, least(1, min(p * tests / k1) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q, least(1, min(control_p * tests / k2) OVER (ORDER BY control_p DESC RANGE UNBOUNDED PRECEDING)) AS control_q FROM b)
SELECT win, feature, n, round(rho, 6) AS rho, round(raw_rho, 6) AS raw_rho, round(p, 6) AS p, round(q, 6) AS q, round(control_p, 6) AS control_p, round(control_q, 6) AS control_q, round(loo_min, 6) AS loo_min, round(loo_max, 6) AS loo_max, round(min_abs_loo, 6) AS min_abs_loo, loo_same_sign,
coalesce(abs(rho) >= 0.5 AND q <= 0.05 AND min_abs_loo >= 0.4 AND loo_same_sign, false) AS highlight FROM q""")
def locus_scan(spark, sf_dir):
    """Four features of every window against the sum of all other windows' parts; the control family takes the next sample's outcome."""
    k = windows(spark, sf_dir).select("sample", "win", "h", "m", ((F.col("h") - F.col("m")) / 10).alias("part"))
    whole = k.groupBy("sample").agg(F.sum("part").alias("raw"))
    order = Window.orderBy("sample")  # a set of samples
    first = whole.agg(F.min("sample").alias("first"))
    ring = whole.crossJoin(F.broadcast(first)).select("sample", F.coalesce(F.lead("sample").over(order), "first").alias("other"))
    y = k.join(whole, "sample").select("sample", "win", "h", "m", "raw", F.round(F.col("raw") - F.col("part"), 9).alias("y"))
    control = y.select(F.col("sample").alias("other"), "win", F.col("y").alias("control"))
    u = y.join(ring, "sample").join(control, ["other", "win"])
    total = F.col("h") + F.col("m")
    kinds = F.array(*(F.struct(F.lit(n).alias("feature"), v.alias("x")) for n, v in (("balance", F.when(total >= 10, F.col("m") / total)), ("h", F.col("h")), ("m", F.col("m")), ("total", total))))
    u = u.select("sample", "win", "y", "raw", "control", F.explode(kinds).alias("f")).select("sample", "win", "y", "raw", "control", "f.feature", "f.x")
    return rounded(studies.locus_scan(u, "win", "feature", "sample", "x", "y", "raw", "control"))


_SEGMENT = """seg AS (SELECT s_nationkey AS chrom, count(*)::DOUBLE AS length, avg(l_discount) * 20 AS ratio FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_suppkey % 5)"""


_SURFACE = f"""{_SEGMENT}, g AS (SELECT a.range / 10.0::DOUBLE AS purity, b.range / 4.0::DOUBLE AS ploidy FROM range(2, 11) a, range(6, 21) b), c AS (SELECT chrom, purity, ploidy, length, (ratio * (purity * ploidy + 2 * (1 - purity)) - 2 * (1 - purity)) / purity AS x FROM seg, g),
e AS (SELECT chrom, purity, ploidy, sum((x - round_even(x, 0)) ** 2 * length) AS off, sum(length) AS length FROM c GROUP BY 1, 2, 3)"""


def _surface(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    seg = line.groupBy(F.col("s_nationkey").alias("chrom"), (F.col("l_suppkey") % 5).alias("k")).agg(F.count("*").cast("double").alias("length"), (F.avg("l_discount") * 20).alias("ratio"))
    return studies.fit_grid(seg, "chrom", "length", "ratio", [k / 10 for k in range(2, 11)], [k / 4 for k in range(6, 21)])


@plan(f"WITH {_SURFACE} SELECT purity, ploidy, round(sum(off) / sum(length), 6) AS distance FROM e GROUP BY 1, 2")
def fit_grid(spark, sf_dir):
    return rounded(_surface(spark, sf_dir).groupBy("purity", "ploidy").agg((F.sum("off") / F.sum("length")).alias("distance")))


_LEFT_OUT = f"""WITH {_SURFACE}, o AS (SELECT DISTINCT chrom AS left_out FROM e UNION ALL SELECT -1), s AS (SELECT left_out, purity, ploidy, round(sum(off) / sum(length), 9) AS d FROM e JOIN o ON e.chrom <> o.left_out GROUP BY 1, 2, 3)"""


@plan(f"""{_LEFT_OUT}, m AS (SELECT a.left_out, a.purity, a.ploidy, a.d, min(b.d) AS low FROM s a JOIN s b ON a.left_out = b.left_out AND abs(a.purity - b.purity) <= 0.1001 AND abs(a.ploidy - b.ploidy) <= 0.2501 GROUP BY ALL)
SELECT left_out, purity, ploidy, round(d, 6) AS distance FROM m WHERE d = low""")
def grid_local_minima(spark, sf_dir):
    """Points of the fitted surface that are least in their neighbourhood: of all chromosomes (-1), and with each left out.

    What a chromosome adds to a point is known, so leaving it out is a difference of sums.
    """
    each = _surface(spark, sf_dir)
    whole = each.groupBy("purity", "ploidy").agg(F.sum("off").alias("all_off"), F.sum("length").alias("all_length"))
    all_of = whole.select(F.lit(-1).cast(dict(each.dtypes)["chrom"]).alias("left_out"), "purity", "ploidy", (F.col("all_off") / F.col("all_length")).alias("d"))
    without = each.join(whole, ["purity", "ploidy"]).select(F.col("chrom").alias("left_out"), "purity", "ploidy", ((F.col("all_off") - F.col("off")) / (F.col("all_length") - F.col("length"))).alias("d"))
    s = all_of.unionByName(without).withColumns({"d": F.round("d", 9), "x": F.round(F.col("purity") * 10).cast("int"), "y": F.round(F.col("ploidy") * 4).cast("int")})
    return rounded(ranking.local_minima(s, ["left_out"], "x", "y", "d").select("left_out", "purity", "ploidy", F.col("d").alias("distance")))


@plan("""WITH t AS (SELECT user_id % 10 AS grp, event_id AS mol, event_id % 3 % 3 AS x0, event_id % 5 % 3 AS x1, event_id % 7 % 3 AS x2 FROM events), r AS (SELECT range AS rep FROM range(0, 64)),
s AS (SELECT *, row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'pick', rep::VARCHAR, mol::VARCHAR))) AS slot FROM t, r QUALIFY slot <= 12),
q AS (SELECT *, row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'c0', rep::VARCHAR, mol::VARCHAR))) AS k0, row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'c1', rep::VARCHAR, mol::VARCHAR))) AS k1,
 row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'c2', rep::VARCHAR, mol::VARCHAR))) AS k2 FROM s),
n AS (SELECT a.grp, a.rep, a.x0, b.x1, c.x2, 1 AS shuffled FROM q a JOIN q b ON a.grp = b.grp AND a.rep = b.rep AND a.k0 = b.k1 JOIN q c ON a.grp = c.grp AND a.rep = c.rep AND a.k0 = c.k2
 UNION ALL SELECT grp, rep, x0, x1, x2, 0 FROM s),
m AS (SELECT grp, rep, shuffled, x0, x1, x2, count(*)::DOUBLE AS n, ((x0 = 2)::INT + (x1 = 2)::INT + (x2 = 2)::INT) AS twos FROM n GROUP BY ALL),
e AS (SELECT grp, rep, shuffled, -sum(n / 12 * log2(n / 12)) AS h, sum(n * twos * (twos - 1)) / 72 AS pairs, sum(n * (twos >= 2)::INT) / 12 AS several FROM m GROUP BY 1, 2, 3),
d AS (SELECT a.grp, a.h, b.h AS null_h, a.pairs - b.pairs AS pairs, a.several - b.several AS several FROM e a JOIN e b ON a.grp = b.grp AND a.rep = b.rep AND a.shuffled = 0 AND b.shuffled = 1)
SELECT grp, (SELECT count(*) FROM t WHERE t.grp = d.grp)::BIGINT AS molecules, round(avg(h), 6) AS entropy, round(avg(null_h), 6) AS null_entropy, round(avg(h - null_h), 6) AS entropy_excess, round(avg(pairs) * 100, 6) AS joint_excess, round(avg(several) * 100, 6) AS multi_excess FROM d GROUP BY grp""")
def block_pattern_excess(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), F.col("event_id").alias("mol"), F.explode(F.array(*(F.struct(F.lit(k).alias("site"), (F.col("event_id") % m % 3).alias("state")) for k, m in enumerate((3, 5, 7))))).alias("x"))
    return rounded(studies.block_patterns(e.select("grp", "mol", "x.site", "x.state"), ["grp"], "mol", "site", "state"))


@plan()
def survival_stability(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date"))).alias("days"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("event"))
    # Cohorts of customers that follow each other: the table's growth is that of their number.
    d = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select((F.floor(F.col("c_custkey") / 1500) * 5 + F.col("c_nationkey") % 5).alias("cohort"), F.col("c_custkey").alias("id"), "days", "event", (F.col("c_acctbal") / 1000).alias("x"))
    return rounded(studies.survival_stability(d, ["cohort"], "id", "days", "event", "x"))


@plan()
def cluster_stability(spark, sf_dir):
    w = passed_on(windows(spark, sf_dir).select("sample", "win", "h"))
    return rounded(studies.cluster_stability(w.select("sample", "win", "h"), "sample", "win", "h"))

