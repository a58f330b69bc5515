"""Plans over intervals, calendars of customers, and layered annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, matching, ranking, rollups
from .registry import plan, rounded, table

_DAYS = "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"
_SPANS = f"spans AS (SELECT o_orderkey AS id, o_custkey AS cust, {_DAYS}::BIGINT AS s, ({_DAYS} + 10 + o_orderkey % 50)::BIGINT AS e FROM orders)"
_GROUPS = """ord AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
brk AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e, id) AS grp FROM ord),
merged AS (SELECT cust, grp, min(s) AS s, max(e) AS e, count(*)::BIGINT AS members FROM brk GROUP BY 1, 2)"""


def spans(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), day.alias("start"), (day + 10 + F.col("o_orderkey") % 50).alias("end"))


@plan(f"WITH {_SPANS}, {_GROUPS.format(src='spans')} SELECT cust, s AS start, e AS \"end\", members FROM merged")
def interval_cluster(spark, sf_dir):
    return intervals.clusters(spans(spark, sf_dir), ["cust"], order=["id"])


@plan(f"""WITH {_SPANS}, clip AS (SELECT id, cust, greatest(s, 300) AS s, least(e, 1500) AS e FROM spans WHERE least(e, 1500) > greatest(s, 300)),
{_GROUPS.format(src='clip')} SELECT cust, sum(e - s)::BIGINT AS length FROM merged GROUP BY cust""")
def interval_union_length(spark, sf_dir):
    return intervals.union_length(spans(spark, sf_dir), ["cust"], low=F.lit(300).cast("long"), high=F.lit(1500).cast("long"))


@plan(f"""WITH {_SPANS} SELECT a.id AS id, b.id AS r_id FROM spans a JOIN spans b ON a.cust = b.cust AND a.s < b.e AND a.e > b.s AND a.id < b.id""")
def overlap_join(spark, sf_dir):
    s = spans(spark, sf_dir)
    return intervals.overlap_join(s, s, ["cust"], bin_size=64).where("id < r_id").select("id", "r_id")


@plan(f"""WITH {_SPANS}, t AS (SELECT range AS bin, range * 90 AS bs, range * 90 + 90 AS be FROM range(0, 40))
SELECT bin, sum(greatest(0, least(e, be) - greatest(s, bs)))::BIGINT AS bp, count(*)::BIGINT AS n FROM spans JOIN t ON s < be AND e > bs GROUP BY bin""")
def block_overlap_bp(spark, sf_dir):
    bins = spark.range(40).select(F.col("id").alias("bin"), (F.col("id") * 90).alias("start"), (F.col("id") * 90 + 90).alias("end"))
    pairs = intervals.overlap_join(spans(spark, sf_dir), bins, [], bin_size=90)
    return pairs.groupBy(F.col("r_bin").alias("bin")).agg(F.sum(intervals.overlap_length("start", "end", "r_start", "r_end")).alias("bp"), F.count("*").alias("n"))


@plan(f"""WITH {_SPANS}, t AS (SELECT range * 200 AS bs, range * 200 + 40 AS be FROM range(0, 14))
SELECT id FROM spans WHERE NOT EXISTS (SELECT 1 FROM t WHERE s < be AND e > bs)""")
def interval_anti_join(spark, sf_dir):
    holes = spark.range(14).select((F.col("id") * 200).alias("start"), (F.col("id") * 200 + 40).alias("end"))
    s = spans(spark, sf_dir).withColumn("_id", F.col("id"))
    return intervals.overlap_join(s, holes, [], bin_size=200, how="left_anti").select("id")


@plan(f"""WITH {_SPANS}, v AS (SELECT cust, s AS pos, 1 AS d FROM spans UNION ALL SELECT cust, e, -1 FROM spans),
k AS (SELECT cust, pos, sum(d) AS d FROM v GROUP BY 1, 2), r AS (SELECT cust, pos, sum(d) OVER (PARTITION BY cust ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY cust ORDER BY pos) AS e FROM k)
SELECT cust, pos AS start, e AS "end", depth::BIGINT AS depth FROM r WHERE depth > 0""")
def interval_mask(spark, sf_dir):
    return intervals.coverage(spans(spark, sf_dir), ["cust"])


_LAYERS = """layers AS (SELECT * FROM (VALUES (1, 10, 14, 'core'), (1, 30, 33, 'core'), (2, 8, 20, 'near'), (2, 28, 36, 'near'), (3, 5, 25, 'far'), (3, 26, 45, 'far')) t(priority, s, e, label))"""


def _labelled(spark, sf_dir):
    layers = spark.createDataFrame([(1, 10, 14, "core"), (1, 30, 33, "core"), (2, 8, 20, "near"), (2, 28, 36, "near"), (3, 5, 25, "far"), (3, 26, 45, "far")], "priority int, start int, end int, label string")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return intervals.overlay(part, F.broadcast(layers), [], "p_size", ["p_partkey"], "priority", "label", "open", bin_size=16)


_CONTEXT = f"""WITH {_LAYERS}, c AS (SELECT p_partkey, p_size, p_brand, p_retailprice, coalesce((SELECT arg_min(label, priority) FROM layers WHERE p_size >= s AND p_size < e), 'open') AS label FROM part)"""


@plan(f"{_CONTEXT} SELECT p_partkey, label FROM c")
def priority_context(spark, sf_dir):
    return _labelled(spark, sf_dir).select("p_partkey", "label")


@plan(f"{_CONTEXT} SELECT label, p_brand, count(*)::BIGINT AS n, sum(round(p_retailprice * 100))::BIGINT AS cents FROM c GROUP BY GROUPING SETS ((label), (p_brand), (label, p_brand))")
def context_grouping_sets(spark, sf_dir):
    c = _labelled(spark, sf_dir)
    sets = c.groupingSets([[F.col("label")], [F.col("p_brand")], [F.col("label"), F.col("p_brand")]], "label", "p_brand")
    return rounded(sets.agg(F.count("*").alias("n"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("cents")).select("label", "p_brand", "n", "cents"))


@plan("""WITH b AS (SELECT floor(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 30.0)::BIGINT AS bin, l_quantity FROM lineitem), g AS (SELECT bin, count(*) AS n, sum(l_quantity) AS q FROM b GROUP BY bin)
SELECT r.range AS bin, coalesce(g.n, 0)::BIGINT AS n, coalesce(round(g.q, 6), 0) AS depth FROM range(0, 100) r LEFT JOIN g ON g.bin = r.range""")
def depth_bins(spark, sf_dir):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    line = table(spark, sf_dir, "lineitem").select(F.floor(day / 30.0).alias("bin"), "l_quantity")
    g = line.groupBy("bin").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("depth"))
    return rounded(spark.range(100).withColumnRenamed("id", "bin").join(g, "bin", "left").na.fill(0, ["n"]).na.fill(0.0, ["depth"]))


@plan("""WITH a AS (SELECT DISTINCT p_size AS pos, p_brand AS brand FROM part) SELECT a.brand, a.pos, count(p.p_partkey) FILTER (abs(p.p_size - a.pos) <= 3)::BIGINT AS density
FROM a JOIN part p ON p.p_brand = a.brand GROUP BY 1, 2""")
def local_density(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_size")
    anchors = part.select("brand", F.col("p_size").alias("pos")).distinct()
    return intervals.local_density(anchors, part, ["brand"], "pos", "p_size", 3)


@plan("""WITH t AS (SELECT p_partkey, p_size * 100 AS s, p_size * 100 + p_partkey % 900 AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)
SELECT p_partkey, greatest(0, CASE WHEN strand = '+' THEN s - 2000 ELSE e - 500 END)::BIGINT AS low, least(4000, CASE WHEN strand = '+' THEN s + 500 ELSE e + 2000 END)::BIGINT AS high FROM t""")
def promoter_windows(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).cast("long").alias("s"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(4000).cast("long").alias("len"))
    t = t.withColumn("e", F.col("s") + F.col("p_partkey") % 900)
    low, high = intervals.promoter("s", "e", "strand", "len")
    return t.select("p_partkey", low.cast("long").alias("low"), high.cast("long").alias("high"))


_PART = "part0 AS (SELECT p_partkey, p_brand, p_size, p_retailprice, p_type, p_partkey % 20 = 0 AS is_target FROM part)"


@plan(f"""WITH {_PART}, s AS (SELECT floor(p_size / 5)::BIGINT AS stratum, p_brand, count(*) FILTER (is_target) AS n1, count(*) FILTER (NOT is_target) AS n0,
avg(p_retailprice) FILTER (is_target) AS m1, avg(p_retailprice) FILTER (NOT is_target) AS m0 FROM part0 GROUP BY 1, 2), k AS (SELECT *, least(n1, n0) AS w FROM s WHERE n1 > 0 AND n0 > 0)
SELECT p_brand, sum(w)::BIGINT AS weight, count(*)::BIGINT AS strata, round(sum(w * (m1 - m0)) / sum(w), 4) AS p_retailprice FROM k GROUP BY p_brand""")
def stratum_matched_difference(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("stratum", F.floor(F.col("p_size") / 5))
    return rounded(matching.stratum_difference(p, ["p_brand"], ["stratum"], F.col("p_partkey") % 20 == 0, ["p_retailprice"]), digits=4)


_BAND = f"""WITH {_PART}, p AS (SELECT t.p_partkey, c.p_partkey AS c_p_partkey, c.p_type AS c_p_type, greatest(abs(ln(c.p_retailprice / t.p_retailprice)) / ln(1.05), abs(ln(c.p_size::DOUBLE / t.p_size)) / ln(1.25)) AS distance
FROM part0 t JOIN part0 c ON t.is_target AND NOT c.is_target AND t.p_brand = c.p_brand), q AS (SELECT * FROM p WHERE distance <= 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, c_p_partkey) AS place FROM q)"""


def _band(spark, sf_dir, k, block=None, least=1):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return matching.nearest_blocks(p.where("p_partkey % 20 = 0"), p.where("p_partkey % 20 <> 0"), ["p_brand"], {"p_retailprice": 1.05, "p_size": 1.25}, "p_partkey", k, block, least)


@plan(f"{_BAND} SELECT p_partkey, c_p_partkey, place::INTEGER AS place, round(distance, 6) AS distance FROM ranked WHERE place <= 10")
def caliper_match_topk(spark, sf_dir):
    return rounded(_band(spark, sf_dir, 10).select("p_partkey", "c_p_partkey", "place", "distance"))


@plan(f"""{_BAND}, b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, c_p_type ORDER BY distance, c_p_partkey) AS k FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, c_p_partkey) AS place FROM b WHERE k = 1), m AS (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS n FROM n WHERE place <= 4)
SELECT p_partkey, c_p_partkey, place::INTEGER AS place FROM m WHERE n >= 2""")
def caliper_block_match(spark, sf_dir):
    return _band(spark, sf_dir, 4, "p_type", least=2).select("p_partkey", "c_p_partkey", "place")


@plan("""WITH RECURSIVE r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
g AS (SELECT p_brand, p_partkey, k, true AS ok, [p_partkey] AS taken FROM r WHERE k = 1 UNION ALL
 SELECT p_brand, p_partkey, k, ok, CASE WHEN ok THEN list_append(taken, p_partkey) ELSE taken END FROM
  (SELECT r.p_brand, r.p_partkey, r.k, g.taken, len(g.taken) < 12 AND len(list_filter(g.taken, lambda x: abs(x - r.p_partkey) < 15)) = 0 AS ok FROM g JOIN r ON r.p_brand = g.p_brand AND r.k = g.k + 1))
SELECT p_brand, p_partkey, len(taken)::BIGINT AS pick FROM g WHERE ok""")
def greedy_spaced_selection(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    p = p.withColumn("rank", F.row_number().over(_by_price()))
    return ranking.greedy_spaced(p, ["p_brand"], "rank", "p_partkey", apart=15, most=12).select("p_brand", "p_partkey", "pick")


def _by_price():
    from pyspark.sql import Window

    return Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")


@plan("""WITH RECURSIVE f AS (SELECT p_partkey // 2000 AS panel, fold, p_partkey, p_size::DOUBLE AS size, p_retailprice / 100 AS price, p_partkey % 20 = 0 AS is_target FROM part, (SELECT range AS fold FROM range(0, 4)) WHERE p_partkey % 4 <> fold),
t AS (SELECT *, row_number() OVER (PARTITION BY panel, fold ORDER BY price, p_partkey) AS k FROM f WHERE is_target),
g AS (SELECT DISTINCT panel, fold, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS p_partkey, NULL::BIGINT AS "match", NULL::DOUBLE AS distance FROM t UNION ALL
 SELECT panel, fold, k, list_append(used, m), target, m, d FROM (SELECT t.panel, t.fold, t.k, g.used, t.p_partkey AS target, arg_min(c.p_partkey, ((c.size - t.size) ** 2 + (c.price - t.price) ** 2, c.p_partkey)) AS m, min((c.size - t.size) ** 2 + (c.price - t.price) ** 2) AS d
  FROM g JOIN t ON t.panel = g.panel AND t.fold = g.fold AND t.k = g.k + 1 JOIN f c ON c.panel = g.panel AND c.fold = g.fold AND NOT c.is_target AND NOT list_contains(g.used, c.p_partkey) GROUP BY t.panel, t.fold, t.k, g.used, t.p_partkey))
SELECT panel, fold::INTEGER AS fold, p_partkey, "match", round(distance, 6) AS distance FROM g WHERE k > 0""")
def matched_pairs_no_reuse(spark, sf_dir):
    """Folds of panels of 2000 parts that follow each other: a larger table has more panels, not larger ones."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 2000).alias("panel"), F.col("p_size").cast("double").alias("p_size"), (F.col("p_retailprice") / 100).alias("price"), (F.col("p_partkey") % 20 == 0).alias("is_target"))
    folds = p.withColumn("fold", F.explode(F.array(*map(F.lit, range(4))))).where(F.col("p_partkey") % 4 != F.col("fold"))
    return rounded(matching.nearest_without_reuse(folds.withColumn("order", F.col("price")), ["panel", "fold"], "is_target", "order", "p_partkey", ["p_size", "price"]))


@plan("""SELECT l_orderkey, min(l_shipdate) AS start, max(l_shipdate) AS "end", count(*)::BIGINT AS n, min(l_returnflag) = max(l_returnflag) AS constant FROM lineitem GROUP BY 1""")
def segments(spark, sf_dir):
    return rollups.segments(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_shipdate", "l_shipdate", "l_returnflag")


_SQUARES = f"""WITH {_PART}, sc AS (SELECT * FROM (VALUES ('primary', 25.0::DOUBLE), ('tight', 10.0), ('wide', 50.0)) v(scenario, tolerance)),
p AS (SELECT scenario, t.p_partkey, c.p_partkey AS c_p_partkey, c.p_partkey // 4 AS block, (c.p_retailprice - t.p_retailprice) / tolerance AS d1, ln(c.p_size::DOUBLE / t.p_size) / ln(1.25) AS d2 FROM part0 t JOIN part0 c ON t.is_target AND NOT c.is_target AND t.p_brand = c.p_brand, sc),
q AS (SELECT *, d1 ** 2 + d2 ** 2 AS distance FROM p WHERE abs(d1) <= 1 AND abs(d2) <= 1), b AS (SELECT *, row_number() OVER (PARTITION BY scenario, p_partkey, block ORDER BY distance, c_p_partkey) AS k FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY scenario, p_partkey ORDER BY distance, c_p_partkey) AS place FROM b WHERE k = 1), m AS (SELECT *, count(*) OVER (PARTITION BY scenario, p_partkey) AS n FROM n WHERE place <= 20)"""


@plan(f"{_SQUARES} SELECT scenario, p_partkey, c_p_partkey, place::INTEGER AS place, round(distance, 6) AS distance FROM m WHERE n >= 5")
def difference_caliper_blocks(spark, sf_dir):
    """Under three tolerances: controls within the difference and ratio calipers by squared distance, one a block, at most twenty, at least five."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), F.floor(F.col("p_partkey") / 4).alias("block"))
    found = None
    for scenario, tolerance in (("primary", 25.0), ("tight", 10.0), ("wide", 50.0)):
        m = matching.nearest_blocks(p.where("p_partkey % 20 = 0"), p.where("p_partkey % 20 <> 0"), ["p_brand"], {"p_size": 1.25}, "p_partkey", 20, "block", 5, {"p_retailprice": tolerance}, "squares")
        m = m.select(F.lit(scenario).alias("scenario"), "p_partkey", "c_p_partkey", "place", "distance")
        found = m if found is None else found.unionByName(m)
    return rounded(found)
