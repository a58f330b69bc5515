"""Smaller plans: support over several encodings, ordered picks, quality rows, intervals of estimates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counting, ranking, resampling, rollups, sequences, statistics
from .inference import _NATION, _RANK, nations
from .molecules import _COUNTS, pattern_counts
from .registry import BASE, CELLS, cells, plan, rounded, table, windows

_STATES = """st AS (SELECT o_custkey % 40 AS locus, l_orderkey AS mol, l_linenumber AS site, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) = 1)"""


@plan(f"""WITH {_STATES}, e AS (SELECT locus, mol, site, 'two' AS kind, (s = 2)::INT AS v FROM st UNION ALL SELECT locus, mol, site, 'one', (s = 1)::INT FROM st UNION ALL SELECT locus, mol, site, 'any', (s > 0)::INT FROM st),
p AS (SELECT a.kind, a.locus, a.site AS i, b.site AS j, count(*) AS n, sum(a.v) AS a, sum(b.v) AS b FROM e a JOIN e b ON a.kind = b.kind AND a.locus = b.locus AND a.mol = b.mol AND a.site < b.site GROUP BY 1, 2, 3, 4)
SELECT locus, i, j FROM p GROUP BY 1, 2, 3 HAVING count(*) FILTER (n >= 12 AND a BETWEEN 3 AND n - 3 AND b BETWEEN 3 AND n - 3) = 3""")
def joint_informative_pairs(spark, sf_dir):
    """Pairs with enough molecules and both values at both sites in all three encodings."""
    line = counting.first_occurrence(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate l_partkey l_suppkey l_extendedprice l_quantity l_discount l_tax l_returnflag".split())
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("locus"))
    state = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    d = line.withColumn("s", state).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), scalars.encode("s", k).alias("v")) for k in ("two", "one", "any"))))
    e = d.select("locus", F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("site"), kinds.alias("x")).select("locus", "mol", "site", "x.*")
    p = sequences.pair_counts(e, ["kind", "locus"], "mol", "site", "v")
    ok = (F.col("n") >= 12) & F.col("a").between(3, F.col("n") - 3) & F.col("b").between(3, F.col("n") - 3)
    return p.groupBy("locus", "i", "j").agg(F.count_if(ok).alias("k")).where("k = 3").drop("k")


@plan("""WITH q AS (SELECT event_type, quantile_cont(abs(value), 0.98) AS cap FROM events GROUP BY 1) SELECT event_id, round(greatest(-cap, least(cap, value)), 6) AS shown FROM events JOIN q USING (event_type)""")
def percentile_clip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    cap = e.groupBy("event_type").agg(F.expr("percentile(abs(value), 0.98D)").alias("cap"))
    return rounded(e.join(cap, "event_type").select("event_id", F.greatest(-F.col("cap"), F.least(F.col("cap"), F.col("value"))).alias("shown")))


@plan("""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 1000, 1), p_size, p_partkey) = 1""")
def rounded_plateau_pick(spark, sf_dir):
    """The best of a plateau: a rounded key first, then the simpler parameter."""
    p = table(spark, sf_dir, "part")
    return ranking.top_k(p, ["p_brand"], [F.round(F.col("p_retailprice") / 1000, 1), F.col("p_size"), F.col("p_partkey")], 1).select("p_brand", "p_partkey")


@plan("""SELECT c_nationkey AS nation, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = (count(*) OVER (PARTITION BY c_nationkey) + 1) // 2""")
def middle_rank_pick(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    d = table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w.orderBy("c_acctbal", "c_custkey"))).withColumn("n", F.count("*").over(w))
    return d.where(F.col("k") == F.floor((F.col("n") + 1) / 2)).select(F.col("c_nationkey").alias("nation"), "c_custkey")


@plan(f"""WITH {CELLS} SELECT sample, count(*)::BIGINT AS sites, sum(c + m + h)::BIGINT AS calls, round(sum(m)::DOUBLE / sum(c + m + h), 6) AS one, round(sum(h)::DOUBLE / sum(c + m + h), 6) AS two,
round(count(*) FILTER (c + m + h < 10)::DOUBLE / greatest(1, count(*)), 6) AS shallow FROM cells GROUP BY sample""")
def sample_quality_rows(spark, sf_dir):
    n = F.col("c") + F.col("m") + F.col("h")
    return rounded(cells(spark, sf_dir).groupBy("sample").agg(
        F.count("*").alias("sites"), F.sum(n).alias("calls"), (F.sum("m") / F.sum(n)).alias("one"), (F.sum("h") / F.sum(n)).alias("two"), (F.count_if(n < 10) / F.greatest(F.lit(1), F.count("*"))).alias("shallow")))


@plan(f"""WITH {_NATION}, lo AS (SELECT o.nation AS omit, x.nation, {_RANK.format(c='x.coarse').replace('OVER (', 'OVER (PARTITION BY o.nation ', 1).replace('PARTITION BY x.coarse', 'PARTITION BY o.nation, x.coarse')} AS rx,
{_RANK.format(c='x.n').replace('OVER (', 'OVER (PARTITION BY o.nation ', 1).replace('PARTITION BY x.n)', 'PARTITION BY o.nation, x.n)')} AS ry FROM nat x JOIN nat o ON x.nation <> o.nation)
SELECT omit, round(corr(rx, ry), 6) AS rho FROM lo GROUP BY omit""")
def leave_one_out_correlation(spark, sf_dir):
    """Rank correlation without each sample in turn; ranks are made anew every time."""
    n = nations(spark, sf_dir).select("nation", "coarse", "n")
    omit = n.select(F.col("nation").alias("omit"))
    left = n.join(F.broadcast(omit), F.col("nation") != F.col("omit"))  # a cohort of samples, not of rows
    return rounded(statistics.spearman(left, ["omit"], "coarse", "n").select("omit", "rho"))


@plan(f"""{BASE}, s AS (SELECT sample < 15 AS g, sample, avg(h) AS v FROM windows GROUP BY 2), v AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sample) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM s),
d AS (SELECT v.g, rep, k AS slot, ('0x' || substr(sha256(concat_ws('|', 'diff', rep::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % n AS pick FROM v, (SELECT range AS rep FROM range(0, 2000))),
m AS (SELECT d.g, d.rep, avg(v.v) AS mean FROM d JOIN v ON v.g = d.g AND v.k = d.pick GROUP BY 1, 2), x AS (SELECT rep, max(mean) FILTER (g) - max(mean) FILTER (NOT g) AS diff FROM m GROUP BY rep)
SELECT round((SELECT avg(v) FILTER (g) - avg(v) FILTER (NOT g) FROM s), 6) AS difference, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM x""")
def group_difference_interval(spark, sf_dir):
    """Difference of two group means with an interval from draws stratified by group."""
    s = windows(spark, sf_dir).groupBy("sample").agg(F.avg("h").alias("v")).withColumn("g", F.col("sample") < 15)
    m = resampling.bootstrap_means(s, ["g"], "sample", "v", 2000, "diff")
    x = m.groupBy("rep").agg((F.max(F.when(F.col("g"), F.col("mean"))) - F.max(F.when(~F.col("g"), F.col("mean")))).alias("diff")).withColumn("k", F.lit(0))
    seen = s.agg((F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("difference"))
    return rounded(resampling.interval(x, ["k"], "diff").crossJoin(F.broadcast(seen)).select("difference", "low", "high"))


@plan(f"""{_COUNTS}, a AS (SELECT win, win % 2 = 0 AS target, code, n::DOUBLE / sum(n) OVER (PARTITION BY win) AS f FROM pc), k AS (SELECT range AS code FROM range(0, 81)), w AS (SELECT DISTINCT win, target FROM a),
z AS (SELECT w.win, w.target, k.code, coalesce(a.f, 0) AS f FROM w CROSS JOIN k LEFT JOIN a ON a.win = w.win AND a.code = k.code) SELECT target, code, round(avg(f), 6) AS frequency FROM z GROUP BY 1, 2""")
def pattern_frequency_by_arm(spark, sf_dir):
    """Zero-filled pattern frequencies, averaged within each arm."""
    pc = pattern_counts(spark, sf_dir)
    f = pc.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("win"))).withColumn("target", F.col("win") % 2 == 0)
    arms = f.select("win", "target").distinct().groupBy("target").agg(F.count("*").alias("wins"))
    grid = arms.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(80))))
    sums = f.groupBy("target", "code").agg(F.sum("f").alias("s"))
    return rounded(grid.join(sums, ["target", "code"], "left").select("target", F.col("code").cast("long").alias("code"), (F.coalesce("s", F.lit(0.0)) / F.col("wins")).alias("frequency")))


@plan("""SELECT s.b AS bin, count(p_partkey)::BIGINT AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS b) s LEFT JOIN part ON CASE WHEN p_size < 5 THEN 0 WHEN p_size < 12 THEN 1 WHEN p_size < 25 THEN 2 WHEN p_size < 45 THEN 3 ELSE 4 END = s.b GROUP BY 1""")
def edge_bins(spark, sf_dir):
    """Half-open bins between sorted edges, zeros kept."""
    b = F.size(F.filter(F.array(*map(F.lit, (5, 12, 25, 45))), lambda e: e <= F.col("p_size")))
    return rollups.zero_filled(table(spark, sf_dir, "part").withColumn("bin", b), "bin", spark.range(5).select(F.col("id").cast("int").alias("bin")))
