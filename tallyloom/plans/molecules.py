"""Plans over molecules: consecutive patterns, entropy, pair association and their nulls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counting, resampling, rollups, sequences
from .registry import plan, rounded, table

_SEQ = """seq AS (SELECT user_id, event_id % 3 AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id FROM events),
gap AS (SELECT user_id, state, idx + CASE WHEN idx >= 20 THEN 1 ELSE 0 END AS idx, event_id FROM seq),
w4 AS (SELECT user_id, idx, lead(idx, 3) OVER w AS i3, state AS a, lead(state, 1) OVER w AS b, lead(state, 2) OVER w AS c, lead(state, 3) OVER w AS d FROM gap WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
codes AS (SELECT user_id, idx AS index, (a * 27 + b * 9 + c * 3 + d)::INTEGER AS code FROM w4 WHERE i3 - idx = 3)"""


def codes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 3).alias("state"))
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = e.withColumn("idx", idx).withColumn("idx", F.col("idx") + F.when(F.col("idx") >= 20, 1).otherwise(0))
    return sequences.consecutive_codes(e, ["user_id"], ["idx"], "idx", "state")


def pattern_counts(spark, sf_dir):
    return codes(spark, sf_dir).groupBy(F.floor(F.col("index") / 5).alias("win"), "code").agg(F.count("*").alias("n"))


_COUNTS = f"WITH {_SEQ}, pc AS (SELECT floor(index / 5)::BIGINT AS win, code, count(*)::BIGINT AS n FROM codes GROUP BY 1, 2)"


@plan(f"WITH {_SEQ} SELECT user_id, index::INTEGER AS index, code FROM codes")
def consecutive4_codes(spark, sf_dir):
    return codes(spark, sf_dir)


@plan(f"""{_COUNTS}, x AS (SELECT *, (code // 27) % 3 AS a, (code // 9) % 3 AS b, (code // 3) % 3 AS c, code % 3 AS d FROM pc),
y AS (SELECT *, (a > 0)::INT * 8 + (b > 0)::INT * 4 + (c > 0)::INT * 2 + (d > 0)::INT AS bin, 1 IN (a, b, c, d) AS one, 2 IN (a, b, c, d) AS two, sum(n) OVER (PARTITION BY win) AS depth FROM x),
z AS (SELECT *, bin > 0 AND bin < 15 AS dsc, sum(n) OVER (PARTITION BY win, bin) AS nb, row_number() OVER (PARTITION BY win, bin ORDER BY code) AS k FROM y),
g AS (SELECT win, any_value(depth) AS depth, sum(n) FILTER (dsc)::DOUBLE / any_value(depth) AS pdr, -sum(n::DOUBLE / depth * log2(n::DOUBLE / depth)) AS h3, -sum(n::DOUBLE / depth * log2(nb::DOUBLE / depth)) AS h2,
 coalesce(sum(n) FILTER (dsc AND one AND NOT two), 0)::DOUBLE / any_value(depth) AS one_only, coalesce(sum(n) FILTER (dsc AND two AND NOT one), 0)::DOUBLE / any_value(depth) AS two_only,
 coalesce(sum(n) FILTER (dsc AND one AND two), 0)::DOUBLE / any_value(depth) AS mixed, coalesce(sum(n) FILTER (bin = 15 AND one AND two), 0)::DOUBLE / any_value(depth) AS full_mixed,
 sum(n * (a > 0)::INT)::DOUBLE / any_value(depth) AS p0, sum(n * (b > 0)::INT)::DOUBLE / any_value(depth) AS p1, sum(n * (c > 0)::INT)::DOUBLE / any_value(depth) AS p2, sum(n * (d > 0)::INT)::DOUBLE / any_value(depth) AS p3 FROM z GROUP BY win),
r AS (SELECT win, nb, row_number() OVER (PARTITION BY win ORDER BY nb DESC) AS place, sum(nb) OVER (PARTITION BY win) AS dis FROM z WHERE dsc AND k = 1),
t AS (SELECT win, sum(nb) FILTER (place <= 2)::DOUBLE / any_value(dis) AS top2, -sum(nb::DOUBLE / dis * ln(nb::DOUBLE / dis)) / ln(14) AS ent FROM r GROUP BY win)
SELECT g.win, depth::BIGINT AS depth, round(coalesce(pdr, 0), 6) AS pdr, round(h2 / 4, 6) AS binary_entropy, round(h3 / log2(81), 6) AS three_state_entropy, round(h3 / log2(81) - h2 / 4, 6) AS delta_entropy, round(h3 - h2, 6) AS hidden_bits,
round(one_only, 6) AS one_only, round(two_only, 6) AS two_only, round(mixed, 6) AS mixed, round(full_mixed, 6) AS full_mixed, round(coalesce(top2, 0), 6) AS top2_share, round(coalesce(ent, 0), 6) AS discordant_entropy,
round(coalesce(pdr, 0) - (1 - p0 * p1 * p2 * p3 - (1 - p0) * (1 - p1) * (1 - p2) * (1 - p3)), 6) AS pdr_excess FROM g LEFT JOIN t USING (win)""")
def window_entropy_pdr(spark, sf_dir):
    return rounded(sequences.pattern_metrics(pattern_counts(spark, sf_dir), ["win"]))


@plan(f"""{_COUNTS}, s AS (SELECT *, sum(n) OVER (PARTITION BY win) AS total FROM pc),
lf AS (SELECT k, coalesce(sum(ln(k)) OVER (ORDER BY k), 0) AS v FROM (SELECT unnest(range(1, (SELECT max(total) FROM s)::BIGINT + 1)) AS k) UNION ALL SELECT 0, 0),
j AS (SELECT range AS j FROM range(1, 11)),
e AS (SELECT win, total, exp(a.v - b.v - c.v + d.v - e.v - f.v - (g.v - h.v - i.v)) AS p, j FROM s, j JOIN lf a ON a.k = s.n JOIN lf b ON b.k = j JOIN lf c ON c.k = s.n - j JOIN lf d ON d.k = s.total - s.n
  JOIN lf e ON e.k = 10 - j JOIN lf f ON f.k = s.total - s.n - 10 + j JOIN lf g ON g.k = s.total JOIN lf h ON h.k = 10 JOIN lf i ON i.k = s.total - 10 WHERE s.total >= 10)
SELECT win, max(total)::BIGINT AS total, round(sum(-p * (j / 10.0::DOUBLE) * log2(j / 10.0::DOUBLE)), 6) + 0 AS entropy FROM e GROUP BY win""")
def rarefied_entropy(spark, sf_dir):
    return rounded(sequences.rarefied_entropy(pattern_counts(spark, sf_dir), ["win"], "code", "n", depth=10))


_MATRIX = """mx AS (SELECT o_custkey % 40 AS locus, l_orderkey AS mol, l_linenumber AS site, (l_returnflag = 'R')::INT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) = 1)"""


def matrix(spark, sf_dir):
    line = counting.first_occurrence(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate l_partkey l_suppkey l_extendedprice l_quantity l_discount l_tax l_returnflag".split())
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("locus"))
    state = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return line.withColumn("state", state).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("locus", F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("site"), scalars.encode("state", "two").alias("v"))


@plan(f"""WITH {_MATRIX}, p AS (SELECT a.locus, a.site AS i, b.site AS j, count(*) AS n, sum(a.v) AS a, sum(b.v) AS b, sum(a.v * b.v) AS ab FROM mx a JOIN mx b ON a.locus = b.locus AND a.mol = b.mol AND a.site < b.site GROUP BY 1, 2, 3)
SELECT locus, i, j, n::BIGINT AS n, a::BIGINT AS a, b::BIGINT AS b, ab::BIGINT AS ab, CASE WHEN n >= 12 THEN round((ab::DOUBLE / n - a::DOUBLE / n * b / n) * n / (n - 1) * 11.0 / 12 * 100, 6) END AS covariance,
CASE WHEN n >= 12 AND a > 0 AND a < n AND b > 0 AND b < n THEN round((ab::DOUBLE / n - a::DOUBLE / n * b / n) / sqrt(a::DOUBLE / n * (1 - a::DOUBLE / n) * (b::DOUBLE / n) * (1 - b::DOUBLE / n)), 6) END AS phi FROM p""")
def pair_covariance_phi(spark, sf_dir):
    return rounded(sequences.covariance_phi(sequences.pair_counts(matrix(spark, sf_dir), ["locus"], "mol", "site", "v")))


_TRIPLES = """trip AS (SELECT user_id % 10 AS grp, event_id AS mol, (event_id % 3 = 2)::INT AS x0, (event_id % 5 = 2)::INT AS x1, (event_id % 7 = 2)::INT AS x2 FROM events)"""


@plan(f"""WITH {_TRIPLES}, r AS (SELECT range AS rep FROM range(0, 64)),
s AS (SELECT grp, rep, mol, x0, x1, x2, row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'pick', rep::VARCHAR, mol::VARCHAR))) AS slot FROM trip, r QUALIFY slot <= 12),
q AS (SELECT *, row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'c0', rep::VARCHAR, mol::VARCHAR))) AS k0, row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'c1', rep::VARCHAR, mol::VARCHAR))) AS k1,
 row_number() OVER (PARTITION BY grp, rep ORDER BY sha256(concat_ws('|', 'c2', rep::VARCHAR, mol::VARCHAR))) AS k2 FROM s),
o AS (SELECT grp, rep, sum((x0 + x1 + x2) * (x0 + x1 + x2 - 1)) AS v FROM s GROUP BY 1, 2),
n AS (SELECT a.grp, a.rep, sum((a.x0 + b.x1 + c.x2) * (a.x0 + b.x1 + c.x2 - 1)) AS v FROM q a JOIN q b ON a.grp = b.grp AND a.rep = b.rep AND a.k0 = b.k1 JOIN q c ON a.grp = c.grp AND a.rep = c.rep AND a.k0 = c.k2 GROUP BY 1, 2)
SELECT o.grp, round(avg((o.v - n.v)::DOUBLE / 72) * 100, 6) AS excess FROM o JOIN n USING (grp, rep) GROUP BY 1""")
def joint_excess_permuted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), F.col("event_id").alias("mol"), *[(F.col("event_id") % m == 2).cast("int").alias(f"x{k}") for k, m in enumerate((3, 5, 7))])
    s = resampling.subsample(e, ["grp"], "mol", 12, 64, "pick")
    # Twelve molecules a replicate: one array, permuted by column inside the row.
    cols = F.array(*(F.transform(F.array_sort(F.collect_list(F.struct(scalars.draw_order(F.lit(f"c{k}"), F.col("rep"), F.col("mol")).alias("o"), F.col(f"x{k}").alias("x")))), lambda t: t["x"]) for k in range(3)))
    total = F.col("x0") + F.col("x1") + F.col("x2")
    g = s.groupBy("grp", "rep").agg(F.sum(total * (total - 1)).alias("seen"), cols.alias("c"))
    null = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda a, i: a + (F.get(F.col("c")[0], i) + F.get(F.col("c")[1], i) + F.get(F.col("c")[2], i)) * (F.get(F.col("c")[0], i) + F.get(F.col("c")[1], i) + F.get(F.col("c")[2], i) - 1))
    return rounded(g.select("grp", ((F.col("seen") - null) / F.lit(72.0)).alias("d")).groupBy("grp").agg((F.avg("d") * 100).alias("excess")))


@plan()
def fixed_margin_null(spark, sf_dir):
    out = resampling.fixed_margin_null(matrix(spark, sf_dir), ["locus"], "mol", "site", "v")
    return rounded(out)


@plan(f"""WITH {_MATRIX}, d AS (SELECT DISTINCT locus, site FROM mx), n AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY site) - 1 AS k FROM d),
b AS (SELECT locus, k // 3 AS block, list(site ORDER BY site) AS sites FROM n GROUP BY 1, 2 HAVING count(*) = 3) SELECT locus, block::BIGINT AS block, sites FROM b""")
def site_blocks(spark, sf_dir):
    return sequences.site_blocks(matrix(spark, sf_dir), ["locus"], "site")


@plan(f"""WITH {_MATRIX}, w AS (SELECT locus, site, avg(v) AS v FROM mx GROUP BY 1, 2) SELECT locus, {', '.join(f'round(max(v) FILTER (site = {k}), 6) AS s{k}' for k in range(1, 8))} FROM w GROUP BY locus HAVING count(*) = 7""")
def pivot_complete_case(spark, sf_dir):
    w = matrix(spark, sf_dir).groupBy("locus", F.concat(F.lit("s"), F.col("site").cast("string")).alias("name")).agg(F.avg("v").alias("v"))
    return rounded(rollups.complete_cases(w, "locus", "name", [f"s{k}" for k in range(1, 8)], "v"))


@plan(f"""WITH {_MATRIX}, m AS (SELECT locus, mol, count(*) AS k FROM mx GROUP BY 1, 2) SELECT locus, count(*)::BIGINT AS molecules, count(*) FILTER (k > 1)::BIGINT AS linking FROM m GROUP BY locus""")
def molecule_bookkeeping(spark, sf_dir):
    m = matrix(spark, sf_dir).groupBy("locus", "mol").agg(F.count("*").alias("k"))
    return m.groupBy("locus").agg(F.count("*").alias("molecules"), F.count_if(F.col("k") > 1).alias("linking"))


_POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.999916758850712 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END"


def _reweighed(name: str, replicates: int, seed: str, weight: str) -> str:
    return f"""{name}_u AS (SELECT locus, s, n, p, b * 8 + i AS rep, (('0x' || substr(h, (1 + 8 * i)::INTEGER, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM (SELECT *, unnest(range(0, 8)) AS i FROM (SELECT *, sha256(concat_ws('|', '{seed}', mol::VARCHAR, b::VARCHAR)) AS h FROM (SELECT *, unnest(range(0, {replicates // 8 + (replicates % 8 > 0)})) AS b FROM mol)))),
{name}_r AS (SELECT locus, rep, sum(w * s) / sum(w * n) AS mean FROM (SELECT *, {weight} AS w FROM {name}_u WHERE rep < {replicates}) WHERE w > 0 GROUP BY 1, 2),
{name} AS (SELECT '{name}' AS kind, locus, any_value(a.units) AS units, any_value(a.mean) AS mean, quantile_cont(coalesce(r.mean, a.mean), 0.025) AS low, quantile_cont(coalesce(r.mean, a.mean), 0.5) AS mid, quantile_cont(coalesce(r.mean, a.mean), 0.975) AS high, count(*) FILTER (r.mean IS NULL) AS empty
 FROM (SELECT *, unnest(range(0, {replicates})) AS rep FROM plain) a LEFT JOIN {name}_r r USING (locus, rep) GROUP BY locus)"""


@plan(f"""WITH {_MATRIX}, depth AS (SELECT locus, site, count(*) AS d FROM mx GROUP BY 1, 2), thin AS (SELECT locus, least(1, 3 / quantile_cont(d, 0.5)) AS p FROM depth WHERE d >= 5 GROUP BY 1),
mol AS (SELECT mx.locus, mol, sum(v)::DOUBLE AS s, count(*) AS n, any_value(p) AS p FROM mx JOIN thin USING (locus) GROUP BY 1, 2), plain AS (SELECT locus, count(*) AS units, sum(s) / sum(n) AS mean FROM mol GROUP BY 1),
{_reweighed('bootstrap', 2000, 'pois', _POISSON)}, {_reweighed('downsample', 500, 'thin', '(u < p)::INT')}
SELECT kind, locus, units::BIGINT AS units, empty::BIGINT AS empty, round(mean, 6) AS mean, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high FROM (FROM bootstrap UNION ALL FROM downsample)""")
def molecule_poisson_bootstrap(spark, sf_dir):
    """2000 reweighings of the molecules of each locus, and 500 thinnings to a median depth of three at its sites."""
    m = matrix(spark, sf_dir)
    thin = m.groupBy("locus", "site").agg(F.count("*").alias("d")).where("d >= 5").groupBy("locus").agg(F.least(F.lit(1.0), 3 / F.percentile("d", F.lit(0.5))).alias("p"))
    m = m.join(thin, "locus")
    both = resampling.unit_bootstrap(m, ["locus"], "mol", "v", 2000, "pois").withColumn("kind", F.lit("bootstrap")).unionByName(
        resampling.unit_bootstrap(m, ["locus"], "mol", "v", 500, "thin", keep=F.col("p")).withColumn("kind", F.lit("downsample")))
    return rounded(both.select("kind", "locus", "units", "empty", "mean", "low", "mid", "high"))
