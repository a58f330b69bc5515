"""Plans over reads and calls, ordered lookups and adjusted association."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counting, guards, rollups, sequences, statistics, studies
from .inference import _NATION, _RANK, nations
from .registry import plan, rounded, table
from .studies import pool_places, pool_sides

# A read of 64 bases for each part, every second one on the reverse strand.
_READS = """reads AS (SELECT p_partkey AS id, p_partkey % 10 AS grp, p_partkey % 2 = 1 AS rev, translate(sha256(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
bases AS (SELECT *, unnest(range(0, 64)) AS pos FROM reads)"""


def reads(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("grp"), (F.col("p_partkey") % 2 == 1).alias("rev"), F.translate(F.sha2(F.col("p_partkey").cast("string"), 256), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


def bases(spark, sf_dir):
    return reads(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("length", F.lit(64))


@plan(f"""WITH {_READS}, o AS (SELECT *, substr(seq, pos::INTEGER + 1, 1) = CASE WHEN rev THEN 'G' ELSE 'C' END AS opportunity,
  CASE WHEN rev THEN pos > 0 AND substr(seq, pos::INTEGER, 1) = 'C' ELSE substr(seq, pos::INTEGER + 2, 1) = 'G' END AS pair FROM bases WHERE pos >= 8 AND pos < 56)
SELECT grp, rev, count(*)::BIGINT AS bases, count(*) FILTER (opportunity)::BIGINT AS opportunities, count(*) FILTER (opportunity AND pair)::BIGINT AS intact FROM o GROUP BY 1, 2""")
def strand_opportunities(spark, sf_dir):
    """Bases away from the read's ends, those that could carry a call on their strand, and those with their pair."""
    inner = counting.end_trim(bases(spark, sf_dir), "pos", "length", 8)
    d = counting.strand_opportunity(inner, "seq", "pos", "rev")
    return d.groupBy("grp", "rev").agg(F.count("*").alias("bases"), F.count_if("opportunity").alias("opportunities"), F.count_if("intact").alias("intact"))


@plan("""SELECT l_linenumber AS line, count(*)::BIGINT AS calls, count(*) FILTER (l_partkey % 129 + l_suppkey % 129 > 255)::BIGINT AS saturated FROM lineitem GROUP BY 1""")
def saturation_counts(spark, sf_dir):
    """Two quantised probabilities may add up to 256 at most, or the query fails; those over 255 are counted."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 129).alias("one"), (F.col("l_suppkey") % 129).alias("two"))
    return counting.guard_sum(d, "one", "two").groupBy("line").agg(F.count("*").alias("calls"), F.count_if(F.col("one") + F.col("two") > 255).alias("saturated"))


@plan(f"""WITH {_READS}, n AS (SELECT *, substr(seq, pos::INTEGER + 1, 1) AS b, CASE WHEN pos > 0 THEN substr(seq, pos::INTEGER, 1) ELSE '' END AS p, substr(seq, pos::INTEGER + 2, 1) AS q,
  substr(seq, greatest(pos - 5, 0)::INTEGER + 1, (pos + 6 - greatest(pos - 5, 0))::INTEGER) AS around FROM bases)
SELECT grp, pos::INTEGER AS pos, count(*) FILTER (NOT (b = 'C' AND q = 'G') AND NOT (b = 'G' AND p = 'C') AND NOT regexp_matches(around, 'AAAA|CCCC|GGGG|TTTT'))::BIGINT AS allowed FROM n GROUP BY 1, 2""")
def marker_sites(spark, sf_dir):
    """Places that may serve as a marker: not in a pair that carries calls, and no run of one base around."""
    d = bases(spark, sf_dir).withColumn("ok", scalars.marker_allowed("seq", "pos"))
    return d.groupBy("grp", "pos").agg(F.count_if("ok").alias("allowed"))


@plan(f"""WITH {_READS}, f AS (SELECT grp, substr(seq, pos::INTEGER - 1, 2) || substr(seq, pos::INTEGER + 3, 2) AS flank FROM bases WHERE pos >= 2 AND pos < 60 AND substr(seq, pos::INTEGER + 1, 2) = 'CG'),
c AS (SELECT grp, length(regexp_replace(flank, '[^GC]', '', 'g')) AS n FROM f) SELECT grp, CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 END AS bin, count(*)::BIGINT AS sites FROM c GROUP BY 1, 2""")
def flank_bins(spark, sf_dir):
    """Sites by the G and C among the two bases on each side."""
    s = bases(spark, sf_dir).where("pos >= 2 AND pos < 60")
    at = lambda shift: F.col("seq").substr(F.col("pos") + 1 + shift, F.lit(2))
    s = s.where(at(0) == "CG").select("grp", at(-2).alias("up"), at(2).alias("down"))
    return s.groupBy("grp", scalars.flank_bin("up", "down").alias("bin")).agg(F.count("*").alias("sites"))


@plan("""WITH o AS (SELECT n_nationkey, row_number() OVER (ORDER BY sha256(n_name)) AS place FROM nation) SELECT place::INTEGER AS place, n_nationkey, n_name FROM o JOIN nation USING (n_nationkey)""")
def ordered_select(spark, sf_dir):
    """Rows by a list of keys, in its order; a listed key without a row fails the query."""
    n = table(spark, sf_dir, "nation")
    order = n.select("n_nationkey", F.row_number().over(Window.orderBy(F.sha2("n_name", 256))).alias("place"))
    return guards.select_in_order(n.select("n_nationkey", "n_name"), order, "n_nationkey", "place").select("place", "n_nationkey", "n_name")


@plan("""WITH k AS (SELECT try_cast(nullif(regexp_extract(c_name, '(\\d+)$', 1), '') AS BIGINT) AS o_custkey, c_mktsegment FROM customer)
SELECT c_mktsegment, count(*)::BIGINT AS orders, count(DISTINCT o_custkey)::BIGINT AS customers FROM k JOIN orders USING (o_custkey) GROUP BY 1""")
def pattern_key_join(spark, sf_dir):
    """Labels join by the number inside a name."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    j = rollups.joined_by_pattern(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), o, "c_name", r"(\d+)$", "o_custkey")
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@plan("""WITH s AS (SELECT s_nationkey AS chrom, s_suppkey * 37 AS pos FROM supplier), q AS (SELECT chrom, pos AS first, lead(pos, 3) OVER (PARTITION BY chrom ORDER BY pos) AS last FROM s)
SELECT chrom, first, ((first + last) // 2)::BIGINT AS midpoint, (last - first + 2)::BIGINT AS span FROM q WHERE last IS NOT NULL""")
def quartet_spans(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("chrom"), (F.col("s_suppkey") * 37).alias("pos"))
    return sequences.quartets(s, ["chrom"], "pos")


_PAIRS = """pr AS (SELECT t.p_partkey AS target, c.p_partkey AS control FROM part t JOIN part c ON t.p_partkey % 20 = 0 AND c.p_partkey % 20 <> 0 AND t.p_brand = c.p_brand
AND c.p_retailprice / t.p_retailprice BETWEEN 0.8 AND 1.25 AND c.p_size::DOUBLE / t.p_size BETWEEN 2.0 / 3 AND 1.5)"""


@plan(f"""WITH {_PAIRS}, e AS (SELECT target, any_value(t.p_retailprice) AS t1, avg(c.p_retailprice) AS c1, any_value(CASE WHEN t.p_partkey % 3 = 0 THEN t.p_size::DOUBLE END) AS t2, avg(CASE WHEN c.p_partkey % 4 = 0 THEN c.p_size::DOUBLE END) AS c2
  FROM pr JOIN part t ON t.p_partkey = target JOIN part c ON c.p_partkey = control GROUP BY target),
u AS (SELECT 'price' AS metric, t1 AS t, c1 AS c FROM e UNION ALL SELECT 'conditional', t2, c2 FROM e)
SELECT metric, count(*)::BIGINT AS targets, round(avg(t), 6) AS target_mean, round(avg(c), 6) AS control_mean, round(avg(t - c), 6) AS difference FROM u WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY metric""")
def paired_metric_difference(spark, sf_dir):
    """Target minus mean control for each metric, over targets where both sides have the metric."""
    targets, controls = pool_sides(spark, sf_dir)
    # What the controls of one place add to a target's means is two sums and counts, whatever their number.
    size = F.when(F.col("p_partkey") % 4 == 0, F.col("depth"))
    held = controls.groupBy("p_brand", F.col("p_retailprice").alias("c_p_retailprice"), F.col("depth").alias("c_depth")).agg(F.count("*").alias("_n"), F.count(size).alias("_m"), F.sum(size).alias("_s"))
    pairs = pool_places(targets, controls).join(held, ["p_brand", "c_p_retailprice", "c_depth"])
    place = ["p_brand", "p_retailprice", "depth"]
    means = pairs.groupBy(*place).agg((F.sum(F.col("c_p_retailprice") * F.col("_n")) / F.sum("_n")).alias("c_price"), F.try_divide(F.sum("_s"), F.sum("_m").cast("double")).alias("c_size"))
    each = targets.join(means, place).select("p_partkey", F.col("p_retailprice").alias("t_price"), F.when(F.col("p_partkey") % 3 == 0, F.col("depth")).alias("t_size"), "c_price", "c_size")
    return rounded(rollups.paired_differences(each, "p_partkey", {"price": ("t_price", "c_price"), "conditional": ("t_size", "c_size")}))


@plan("""WITH b AS (SELECT p_size AS pos, substr(p_type, 1, 1) AS base, count(*) AS n, least(count(*) FILTER (p_partkey % 2 = 0), count(*) FILTER (p_partkey % 2 <> 0)) AS s FROM part GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS depth, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS k FROM b),
g AS (SELECT pos, any_value(depth) AS depth, max(base) FILTER (k = 1) AS ref, max(base) FILTER (k = 2) AS alt, max(n) FILTER (k = 1) AS r, max(n) FILTER (k = 2) AS a, min(s) AS s FROM k WHERE k <= 2 GROUP BY pos)
SELECT pos, ref, alt, depth::BIGINT AS depth, round(a::DOUBLE / depth, 6) AS fraction FROM g WHERE depth >= 16 AND a >= 4 AND (r + a)::DOUBLE / depth >= 0.3 AND a::DOUBLE / depth BETWEEN 0.1 AND 0.75 AND s >= 2""")
def variant_filter_by_strand(spark, sf_dir):
    """As variant_filter, with two reads of both bases on each strand."""
    pile = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("pos"), F.substring("p_type", 1, 1).alias("base"), (F.col("p_partkey") % 2 == 0).alias("forward")).agg(F.count("*").alias("n"))
    return rounded(studies.variants(pile, ["pos"], each=4, covered=0.3, low=0.1, strand="forward"))


@plan("""WITH t AS (SELECT user_id % 10 AS grp, event_id AS mol, event_id % 3 AS z0, event_id % 5 % 3 AS z1 FROM events),
w AS (SELECT grp, count(*) AS n, avg((z0 = 2)::INT) AS a, avg((z1 = 2)::INT) AS b, avg((z0 = 2 AND z1 = 2)::INT) AS ab, least(count(*) FILTER (z0 = 2), count(*) FILTER (z1 = 2), count(*) FILTER (z0 <> 2), count(*) FILTER (z1 <> 2)) AS low,
  covar_samp(CASE z0 WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END, CASE z1 WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END) * 11 / 12.0 AS hm FROM t GROUP BY grp),
s AS (SELECT grp, rep, z0, z1 FROM t, (SELECT range AS rep FROM range(0, 64)) QUALIFY row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'phi', rep::VARCHAR, mol::VARCHAR))) <= 12),
d AS (SELECT grp, rep, avg((z0 = 2)::INT) AS x, avg((z1 = 2)::INT) AS y, avg((z0 = 2 AND z1 = 2)::INT) AS xy FROM s GROUP BY 1, 2 HAVING count(*) = 12),
p AS (SELECT grp, avg((xy - x * y) / sqrt(x * (1 - x) * y * (1 - y))) AS phi, count(*) AS valid FROM d WHERE x * (1 - x) * y * (1 - y) > 0 GROUP BY grp)
SELECT grp, n::BIGINT AS molecules, round(a, 6) AS one, round(b, 6) AS two, round((ab - a * b) * n / (n - 1) * 11 / 12.0 * 100, 6) AS joint_excess, CASE WHEN low >= 3 AND valid >= 32 THEN round(phi, 6) END AS phi,
  CASE WHEN low >= 3 THEN coalesce(valid, 0) ELSE 0 END::BIGINT AS phi_valid, round(hm, 6) AS h_minus_m FROM w LEFT JOIN p USING (grp)""")
def distance_pair_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), F.col("event_id").alias("mol"), (F.col("event_id") % 3).alias("z0"), (F.col("event_id") % 5 % 3).alias("z1"))
    return rounded(sequences.pair_metrics(e, ["grp"], "mol", "z0", "z1"))


_RANKS = ", ".join(_RANK.format(c=c).replace("OVER (ORDER BY", "OVER (PARTITION BY rep ORDER BY").replace("PARTITION BY " + c, "PARTITION BY rep, " + c) + f" AS r_{c}" for c in ("coarse", "n", "top"))
_DIGEST = "sha256(concat_ws('|', '{seed}', rep::VARCHAR, {key}::VARCHAR))"
_PARTIAL = "(corr(r_coarse, r_n) - corr(r_coarse, r_top) * corr(r_n, r_top)) / sqrt((1 - corr(r_coarse, r_top) ** 2) * (1 - corr(r_n, r_top) ** 2))"


@plan(f"""WITH {_NATION}, z AS (SELECT *, row_number() OVER (ORDER BY nation) - 1 AS place, count(*) OVER () AS m FROM nat),
b AS (SELECT rep, p.coarse, p.n, p.top FROM (SELECT rep, ('0x' || substr({_DIGEST.format(seed='adj', key='place')}, 1, 8))::BIGINT % m AS place FROM z, (SELECT range AS rep FROM range(0, 5000))) d JOIN z p USING (place)),
rb AS (SELECT rep, {_RANKS} FROM b), pb AS (SELECT rep, {_PARTIAL} AS rho FROM rb GROUP BY rep),
r AS (SELECT nation, {_RANKS} FROM (SELECT *, 0 AS rep FROM nat)), seen AS (SELECT count(*) AS n, {_PARTIAL} AS rho FROM r),
l AS (SELECT regr_slope(r_coarse, r_top) AS bx, regr_intercept(r_coarse, r_top) AS ax, regr_slope(r_n, r_top) AS b_y, regr_intercept(r_n, r_top) AS ay FROM r),
e AS (SELECT nation, r_top, r_coarse - ax - bx * r_top AS ex, ay + b_y * r_top AS fit, r_n - ay - b_y * r_top AS ey FROM r, l),
q AS (SELECT rep, nation, ex, fit, r_top, ey, row_number() OVER (PARTITION BY rep ORDER BY nation) AS k, row_number() OVER (PARTITION BY rep ORDER BY {_DIGEST.format(seed='adjp', key='nation')}) AS s FROM e, (SELECT range AS rep FROM range(1, 10000))),
y AS (SELECT a.rep, a.ex, a.r_top, a.fit + b.ey AS y FROM q a JOIN q b ON a.rep = b.rep AND a.k = b.s),
n AS (SELECT rep, sum(y * ex) / sqrt(var_pop(y) * count(*) * (1 - corr(y, r_top) ** 2) * sum(ex * ex)) AS rho FROM y GROUP BY rep)
SELECT 0 AS k, (SELECT n FROM seen)::BIGINT AS n, round((SELECT rho FROM seen), 6) AS rho, round((SELECT quantile_cont(rho, 0.025) FROM pb), 6) AS low, round((SELECT quantile_cont(rho, 0.975) FROM pb), 6) AS high,
  round((1 + count(*) FILTER (abs(rho) >= abs((SELECT rho FROM seen)) - 1e-12)) / 10000.0, 6) AS p FROM n""")
def adjusted_association(spark, sf_dir):
    """Partial rank correlation with its bootstrap interval and residual permutation p, at the rule's 5000 and 9999 replicates."""
    return rounded(statistics.adjusted_association(nations(spark, sf_dir), ["k"], "nation", "coarse", "n", "top"))
