"""Plans for tests and fits: ranks, permutations, false discovery, robust lines, survival, linear scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import ranking, resampling, rollups, statistics, survival
from .registry import BASE, plan, rounded, table, windows

_NATION = """nat AS (SELECT c_nationkey AS nation, count(*) AS n, avg(c_acctbal) AS bal, max(c_acctbal) AS top, round(avg(c_acctbal) / 250) AS coarse FROM customer GROUP BY 1)"""


def nations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    return c.agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("bal"), F.max("c_acctbal").alias("top"), F.round(F.avg("c_acctbal") / 250).alias("coarse")).withColumn("k", F.lit(0))


_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE"


@plan(f"WITH {_NATION} SELECT nation, {_RANK.format(c='coarse')} AS r_coarse, {_RANK.format(c='n')} AS r_n FROM nat")
def average_ranks(spark, sf_dir):
    d = ranking.average_rank(ranking.average_rank(nations(spark, sf_dir), ["k"], "coarse", "r_coarse"), ["k"], "n", "r_n")
    return d.select("nation", "r_coarse", "r_n")


_RANKED = f"{_NATION}, rk AS (SELECT nation, {_RANK.format(c='coarse')} AS rx, {_RANK.format(c='n')} AS ry, {_RANK.format(c='top')} AS rz FROM nat)"


@plan(f"""WITH {_RANKED}, c AS (SELECT corr(rx, ry) AS rho FROM rk), r AS (SELECT range AS rep FROM range(1, 20000)),
o AS (SELECT rep, nation, row_number() OVER (PARTITION BY rep ORDER BY nation) AS k, row_number() OVER (PARTITION BY rep ORDER BY sha256(concat_ws('|', 'perm', rep::VARCHAR, nation::VARCHAR))) AS s, rx, ry FROM rk, r),
p AS (SELECT a.rep, corr(a.rx, b.ry) AS rho FROM o a JOIN o b ON a.rep = b.rep AND a.k = b.s GROUP BY a.rep)
SELECT round((SELECT rho FROM c), 6) AS rho, round((1 + count(*) FILTER (abs(p.rho) >= abs((SELECT rho FROM c)) - 1e-12)) / (1.0 + count(*)), 6) AS p FROM p""")
def spearman_perm(spark, sf_dir):
    n = nations(spark, sf_dir)
    rho = statistics.spearman(n, ["k"], "coarse", "n").withColumnRenamed("rho", "seen").select("k", "seen")
    null = resampling.permute(n.select("k", "nation", F.col("n").alias("v")), ["k"], "nation", "v", 19_999, "perm")
    null = statistics.spearman(null.join(n.select("nation", "coarse"), "nation"), ["k", "rep"], "coarse", "v")
    return rounded(resampling.permutation_p(null.join(rho, "k"), ["k"], "rho", "seen").select(F.col("seen").alias("rho"), "p"))


@plan(f"""WITH {_RANKED}, c AS (SELECT count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM rk), o AS (SELECT n::BIGINT AS n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS rho FROM c), t AS (SELECT *, rho * sqrt((n - 3) / (1 - rho * rho)) AS t, (n - 3)::DOUBLE AS df FROM o),
a AS (SELECT *, atan(abs(t) / sqrt(df)) AS low, (pi() / 2 - atan(abs(t) / sqrt(df))) / 4000 AS step FROM t)
SELECT n, round(rho, 6) AS rho, round(2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * step / 3
  * list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * greatest(cos(low + k * step), 0) ** (df - 1))), 6) AS p FROM a""")
def partial_rank_corr(spark, sf_dir):
    """With the two-sided p of Student's t at n less three degrees of freedom; its SQL integrates the density by Simpson's rule."""
    r = statistics.partial_spearman(nations(spark, sf_dir), ["k"], "coarse", "n", "top").select("n", "rho")
    df = F.col("n") - 3
    return rounded(r.withColumn("p", tails.t_two_sided(F.col("rho") * F.sqrt(df / (1 - F.col("rho") * F.col("rho"))), df)))


_P = """ps AS (SELECT p_brand AS fam, p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE ((p_partkey * 7919) % 1009) / 1009.0::DOUBLE END AS p FROM part)"""


@plan(f"""WITH {_P}, o AS (SELECT *, coalesce(p, 1) AS p1, count(p) OVER (PARTITION BY fam) AS n_known, count(*) OVER (PARTITION BY fam) AS n_all FROM ps),
k AS (SELECT *, rank() OVER (PARTITION BY fam, p IS NULL ORDER BY p) + count(*) OVER (PARTITION BY fam, p) - 1 AS r, rank() OVER (PARTITION BY fam ORDER BY p1) + count(*) OVER (PARTITION BY fam, p1) - 1 AS r1 FROM o),
q AS (SELECT fam, id, p, min(p * n_known / r) OVER w AS q_exclude, min(p * n_all / r) OVER w AS q_count, min(p * 5.0 / r) OVER w AS q_five, min(p1 * n_all / r1) OVER (PARTITION BY fam ORDER BY p1 DESC RANGE UNBOUNDED PRECEDING) AS q_one FROM k
 WINDOW w AS (PARTITION BY fam ORDER BY p DESC NULLS LAST RANGE UNBOUNDED PRECEDING))
SELECT fam, id, CASE WHEN p IS NOT NULL THEN round(least(1, q_exclude), 6) END AS q_exclude, CASE WHEN p IS NOT NULL THEN round(least(1, q_count), 6) END AS q_count, round(least(1, q_one), 6) AS q_one, CASE WHEN p IS NOT NULL THEN round(least(1, q_five), 6) END AS q_five FROM q""")
def bh_adjust(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("fam"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 7919) % 1009 / F.lit(1009.0)).alias("p"))
    for name, policy, family in (("q_exclude", "exclude", None), ("q_count", "count", None), ("q_one", "one", None), ("q_five", "exclude", 5)):
        d = ranking.bh(d, ["fam"], "p", name, policy, family)
    return rounded(d.drop("p"))


@plan(f"""{BASE}, x AS (SELECT win, sample, h, sample < 15 AS g FROM windows), o AS (SELECT win, avg(h) FILTER (g) - avg(h) FILTER (NOT g) AS seen FROM x GROUP BY win), s AS (SELECT DISTINCT sample, g FROM x),
r AS (SELECT range AS rep FROM range(1, 20000)), d AS (SELECT rep, sample, g, row_number() OVER (PARTITION BY rep ORDER BY sample) AS k, row_number() OVER (PARTITION BY rep ORDER BY sha256(concat_ws('|', 'label', rep::VARCHAR, sample::VARCHAR))) AS s FROM s, r),
l AS (SELECT b.rep, b.sample, a.g FROM d a JOIN d b ON a.rep = b.rep AND a.k = b.s), n AS (SELECT win, rep, avg(h) FILTER (l.g) - avg(h) FILTER (NOT l.g) AS diff FROM x JOIN l USING (sample) GROUP BY 1, 2)
SELECT win, round(any_value(seen), 6) AS seen, round((1 + count(*) FILTER (abs(diff) >= abs(seen) - 1e-12)) / (1.0 + count(*)), 6) AS p FROM n JOIN o USING (win) GROUP BY win""")
def mean_difference_perm(spark, sf_dir):
    return rounded(resampling.label_permutation(windows(spark, sf_dir), ["win"], "sample", F.col("sample") < 15, "h", 19_999, "label"))


@plan(f"""{BASE}, x AS (SELECT sample, avg(h) - avg(m) AS d FROM windows GROUP BY sample), r AS (SELECT range AS rep FROM range(1, 50000)),
n AS (SELECT rep, avg(CASE WHEN ('0x' || substr(sha256(concat_ws('|', 'flip', rep::VARCHAR, sample::VARCHAR)), 1, 8))::BIGINT % 2 = 0 THEN d ELSE -d END) AS mean FROM x, r GROUP BY rep), o AS (SELECT avg(d) AS seen FROM x)
SELECT round((SELECT seen FROM o), 6) AS seen, round((1 + count(*) FILTER (abs(mean) >= abs((SELECT seen FROM o)) - 1e-12)) / (1.0 + count(*)), 6) AS p FROM n""")
def sign_flip_test(spark, sf_dir):
    x = windows(spark, sf_dir).groupBy("sample").agg((F.avg("h") - F.avg("m")).alias("d")).withColumn("k", F.lit(0))
    null = resampling.sign_flips(x, ["k"], "sample", "d", 49_999, "flip")
    seen = x.groupBy("k").agg(F.avg("d").alias("seen"))
    return rounded(resampling.permutation_p(null.join(seen, "k"), ["k"], "mean", "seen").select("seen", "p"))


@plan("""WITH x AS (SELECT r_regionkey AS g, n_nationkey AS id, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2 GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n, count(*) FILTER (g = 0) OVER () AS a FROM x),
s AS (SELECT range AS mask FROM range(0, 1024)), c AS (SELECT mask, v, g, a, (mask >> k) & 1 AS inside FROM i, s WHERE bit_count(mask) = a),
m AS (SELECT mask, quantile_cont(v, 0.5) FILTER (inside = 1) - quantile_cont(v, 0.5) FILTER (inside = 0) AS d FROM c GROUP BY mask),
o AS (SELECT quantile_cont(v, 0.5) FILTER (g = 0) - quantile_cont(v, 0.5) FILTER (g = 1) AS d FROM x)
SELECT round((SELECT d FROM o), 6) AS effect, count(*)::BIGINT AS labellings, round(avg((abs(d) >= abs((SELECT d FROM o)) - 1e-14)::INT), 6) AS p FROM m""")
def exact_label_permutation(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    x = c.join(n.where("n_regionkey < 2"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("v"))
    # All labellings of one small set: the values are one array, each labelling a bit mask of its places.
    one = x.agg(F.sort_array(F.collect_list(F.struct("id", "v", "g"))).alias("x"))
    size = F.size(F.filter("x", lambda t: t["g"] == 0))
    masks = one.select("x", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("x")).cast("int") - 1)).alias("mask")).where(F.bit_count("mask") == size)
    median = lambda keep: _median(F.transform(F.filter(F.transform("x", lambda t, i: F.struct(t["v"].alias("v"), keep(t, i).alias("k"))), lambda t: t["k"]), lambda t: t["v"]))
    bit = lambda t, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1
    d = masks.select((median(bit) - median(lambda t, i: ~bit(t, i))).alias("d"), (median(lambda t, i: t["g"] == 0) - median(lambda t, i: t["g"] != 0)).alias("seen"))
    out = d.agg(F.first("seen").alias("effect"), F.count("*").alias("labellings"), F.avg((F.abs("d") >= F.abs("seen") - 1e-14).cast("int")).alias("p"))
    return rounded(out)


def _median(values):
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


_POINTS = """pt AS (SELECT c_nationkey AS nation, c_custkey AS id, (c_custkey % 50)::DOUBLE AS x, c_acctbal AS y FROM customer)"""


def points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).cast("double").alias("x"), F.col("c_acctbal").alias("y"))


@plan(f"""WITH {_POINTS}, s AS (SELECT a.nation, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM pt a JOIN pt b ON a.nation = b.nation AND a.id < b.id AND a.x <> b.x GROUP BY 1)
SELECT nation, count(*)::BIGINT AS n, round(any_value(slope), 6) AS slope, round(quantile_cont(y - slope * x, 0.5), 6) AS intercept FROM pt JOIN s USING (nation) GROUP BY nation""")
def theil_sen(spark, sf_dir):
    return rounded(statistics.theil_sen(points(spark, sf_dir), ["nation"], "x", "y"))


@plan(f"""WITH {_POINTS}, z AS (SELECT nation, id // 1500 AS block, id, x, y, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY nation, id // 1500) AS n FROM pt WINDOW w AS (PARTITION BY nation, id // 1500 ORDER BY id)), r AS (SELECT range AS rep FROM range(0, 200)),
d AS (SELECT nation, block, rep, ('0x' || substr(sha256(concat_ws('|', 'ts', rep::VARCHAR, a.place::VARCHAR)), 1, 8))::BIGINT % a.n AS place FROM z a, r), k AS (SELECT nation, block, rep, place, count(*) AS k FROM d GROUP BY ALL),
s AS (SELECT nation, block, rep, id, x, y, k FROM k JOIN z USING (nation, block, place)), p AS (SELECT a.nation, a.block, a.rep, (b.y - a.y) / (b.x - a.x) AS v, a.k * b.k AS w FROM s a JOIN s b ON a.nation = b.nation AND a.block = b.block AND a.rep = b.rep AND a.id < b.id AND a.x <> b.x),
c AS (SELECT nation, block, rep, v, sum(w) OVER (PARTITION BY nation, block, rep ORDER BY v RANGE UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY nation, block, rep) AS t FROM p),
m AS (SELECT nation, block, rep, (min(v) FILTER (u >= (t + 1) // 2) + min(v) FILTER (u >= (t + 2) // 2)) / 2 AS slope FROM c GROUP BY ALL),
e AS (SELECT nation, block, rep, slope, y - slope * x AS v, k AS w FROM s JOIN m USING (nation, block, rep)), f AS (SELECT *, sum(w) OVER (PARTITION BY nation, block, rep ORDER BY v RANGE UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY nation, block, rep) AS t FROM e)
SELECT nation, block, rep::INTEGER AS rep, floor(any_value(slope) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS slope, floor((min(v) FILTER (u >= (t + 1) // 2) + min(v) FILTER (u >= (t + 2) // 2)) / 2 * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS intercept FROM f GROUP BY nation, block, rep""")
def theil_sen_bootstrap(spark, sf_dir):
    """Refits of every cohort: the customers of a nation among 1500 that follow each other. So the table's growth is that of the cohorts' number."""
    p = points(spark, sf_dir).withColumn("block", F.floor(F.col("id") / 1500))
    refits = statistics.theil_sen_bootstrap(p, ["nation", "block"], "x", "y", "id", 200, "ts")
    # Halves are common here, and engines round them differently.
    return refits.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("slope", "intercept")})


def _three_by_three(w: str) -> tuple[str, str]:
    """(weighted sums, their solution by Cramer's rule) of a plane through x and z."""
    sums = f"sum({w}) AS s, sum({w} * x) AS sx, sum({w} * z) AS sz, sum({w} * x * x) AS sxx, sum({w} * x * z) AS sxz, sum({w} * z * z) AS szz, sum({w} * y) AS sy, sum({w} * x * y) AS sxy, sum({w} * z * y) AS szy"
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    a, right = ["s", "sx", "sz", "sx", "sxx", "sxz", "sz", "sxz", "szz"], ["sy", "sxy", "szy"]
    part = lambda k: det([right[i // 3] if i % 3 == k else v for i, v in enumerate(a)])
    return sums, ", ".join(f"{part(k)} / {det(a)} AS a{k}" for k in range(3))


def _huber_sql(c: float = 1.345, rounds: int = 50) -> str:
    first, weighted = _three_by_three("1.0::DOUBLE"), _three_by_three("w")
    return f"""WITH RECURSIVE {_POINTS}, d AS (SELECT nation % 5 AS region, (x - 50) / 10 AS x, (id % 2)::DOUBLE AS z, y FROM pt),
b AS (SELECT region, 0 AS k, a0, a1, a2, true AS open FROM (SELECT region, {first[1]} FROM (SELECT region, {first[0]} FROM d GROUP BY region)) UNION ALL
 SELECT region, k + 1, a0, a1, a2, greatest(abs(a0 - b0), abs(a1 - b1), abs(a2 - b2)) >= 1e-8 * greatest(1, abs(a0), abs(a1), abs(a2)) FROM (SELECT region, k, b0, b1, b2, {weighted[1]} FROM (SELECT region, k, b0, b1, b2, {weighted[0]}
  FROM (SELECT *, far / greatest(far, abs(r)) AS w FROM (SELECT *, {c} * 1.4826022185056018::DOUBLE * quantile_cont(abs(r - m), 0.5) OVER (PARTITION BY region) AS far FROM (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY region) AS m
   FROM (SELECT d.*, b.k, b.a0 AS b0, b.a1 AS b1, b.a2 AS b2, y - (b.a0 + b.a1 * x + b.a2 * z) AS r FROM d JOIN b USING (region) WHERE open AND k < {rounds})))) GROUP BY region, k, b0, b1, b2)))
SELECT region, (SELECT count(*) FROM d WHERE d.region = b.region)::BIGINT AS n, round(a0, 4) AS b0, round(a1, 4) AS b1, round(a2, 4) AS b2 FROM b QUALIFY row_number() OVER (PARTITION BY region ORDER BY k DESC) = 1"""


@plan(_huber_sql())
def huber_group_effect(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("decade", (F.col("x") - 50) / 10).withColumn("group", (F.col("id") % 2).cast("double")).withColumn("region", F.col("nation") % 5)
    return rounded(statistics.huber(p, ["region"], "y", ["decade", "group"]), digits=4)


def _clipped_sql(rounds: int) -> str:
    """Each round fits the kept rows, and looks at all rows' residuals for those to keep next."""
    steps = ["k0 AS (SELECT *, true AS keep, false AS stop FROM pt)"]
    for k in range(1, rounds):
        steps += [
            f"r{k} AS (SELECT *, y - (regr_slope(y, x) FILTER (keep) OVER w * x + regr_intercept(y, x) FILTER (keep) OVER w) AS r FROM k{k - 1} WINDOW w AS (PARTITION BY nation))", f"m{k} AS (SELECT *, abs(r - quantile_cont(r, 0.5) OVER (PARTITION BY nation)) AS off FROM r{k})",
            f"n{k} AS (SELECT *, off <= greatest(0.5, 3 * 1.4826::DOUBLE * quantile_cont(off, 0.5) OVER (PARTITION BY nation)) AS ok FROM m{k})", f"s{k} AS (SELECT nation, id, x, y, keep, ok, stop OR count(*) FILTER (ok) OVER (PARTITION BY nation) < 8 AS stop FROM n{k})",
            f"k{k} AS (SELECT nation, id, x, y, CASE WHEN stop THEN keep ELSE ok END AS keep, stop FROM s{k})",
        ]
    return f"WITH {_POINTS}, {', '.join(steps)} SELECT nation, count(*) FILTER (keep)::BIGINT AS n, round(regr_slope(y, x) FILTER (keep), 6) AS slope, round(regr_intercept(y, x) FILTER (keep), 6) AS intercept FROM k{rounds - 1} GROUP BY nation"


@plan(_clipped_sql(3))
def clipped_line_fit(spark, sf_dir):
    return rounded(statistics.clipped_line(points(spark, sf_dir), ["nation"], "x", "y"))


_BETA = """bt AS (SELECT vec_id AS id, unnest(range(0, 64)) AS probe, unnest(embedding)::DOUBLE AS v FROM embeddings), obs AS (SELECT id, probe, CASE WHEN (id + probe) % 7 <> 0 THEN v END AS v FROM bt),
wt AS (SELECT range AS probe, (range % 9 - 4) / 10.0::DOUBLE AS weight, (range % 5) / 10.0::DOUBLE AS reference FROM range(0, 64))"""
_AGE = "CASE WHEN {e} < 0 THEN 21 * exp({e}) - 1 ELSE 21 * {e} + 20 END"


def betas(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("probe", "v"))
    return v.select("id", F.col("probe").cast("long").alias("probe"), F.when((F.col("id") + F.col("probe")) % 7 != 0, F.col("v").cast("double")).alias("v"))


def weights(spark):
    p = spark.range(64).withColumnRenamed("id", "probe")
    return F.broadcast(p.select("probe", ((F.col("probe") % 9 - 4) / F.lit(10.0)).alias("weight"), ((F.col("probe") % 5) / F.lit(10.0)).alias("reference")))


@plan(f"""WITH {_BETA}, s AS (SELECT id, 0.696::DOUBLE + sum(weight * coalesce(v, reference)) AS eta, count(v) AS observed FROM obs JOIN wt USING (probe) GROUP BY id)
SELECT id, round(eta, 6) AS eta, observed::BIGINT AS observed, round({_AGE.format(e='eta')}, 6) AS age FROM s""")
def clock_score(spark, sf_dir):
    return rounded(statistics.linear_score(betas(spark, sf_dir), weights(spark), "id", "probe", "v", 0.696))


@plan(f"""WITH {_BETA}, p AS (SELECT id, weight * 21 AS w, v, reference, abs(v) * 0.75 AS a, abs(v) * 0.25 AS b FROM obs JOIN wt USING (probe)),
s AS (SELECT id, sum(CASE WHEN v IS NOT NULL THEN w * a ELSE 0 END) AS one, sum(CASE WHEN v IS NOT NULL THEN w * b ELSE 0 END) AS two, sum(CASE WHEN v IS NULL THEN w * reference ELSE 0 END) AS imputed,
 sum(abs(CASE WHEN v IS NOT NULL THEN w * a ELSE 0 END)) AS x, sum(abs(CASE WHEN v IS NOT NULL THEN w * b ELSE 0 END)) AS y FROM p GROUP BY id)
SELECT id, round(one, 6) AS one, round(two, 6) AS two, round(imputed, 6) AS imputed, round(x / nullif(x + y, 0), 6) AS one_share FROM s""")
def component_decomposition(spark, sf_dir):
    b = betas(spark, sf_dir).select("id", "probe", (F.abs("v") * 0.75).alias("a"), (F.abs("v") * 0.25).alias("b"))
    return rounded(statistics.contribution(b, weights(spark), "id", "probe", "a", "b"))


@plan(f"""WITH {_BETA}, s AS (SELECT id, 0.696::DOUBLE + sum(weight * v) AS eta, sum(CASE WHEN probe < 5 THEN weight * (v - reference) ELSE 0 END) AS shift FROM bt JOIN wt USING (probe) GROUP BY id),
c AS (SELECT *, {_AGE.format(e='eta')} AS age, {_AGE.format(e='(eta - shift)')} AS counterfactual_age FROM s)
SELECT id, round(eta, 6) AS eta, round(shift, 6) AS shift, round(age, 6) AS age, round(counterfactual_age, 6) AS counterfactual_age, round(age - counterfactual_age, 6) AS years FROM c""")
def replacement_effect(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("probe", "v"))
    v = v.select("id", F.col("probe").cast("long").alias("probe"), F.col("v").cast("double").alias("v"))
    return rounded(statistics.replacement_effect(v, weights(spark), "id", "probe", "v", F.col("probe") < 5, 0.696))


@plan(f"""{BASE}, al AS (SELECT range AS alloc FROM range(0, 500)), rg AS (SELECT a.range AS lo, b.range AS hi FROM range(0, 8) a, range(0, 8) b WHERE a.range <= b.range),
lab AS (SELECT alloc, sample, row_number() OVER (PARTITION BY alloc ORDER BY sha256(concat_ws('|', 'alloc', alloc::VARCHAR, sample::VARCHAR))) <= 5 AS inside FROM al, (SELECT DISTINCT sample FROM windows)),
v AS (SELECT lo, hi, sample, avg(h) AS v FROM windows JOIN rg ON win BETWEEN lo AND hi GROUP BY 1, 2, 3),
s AS (SELECT alloc, lo, hi, count(v) FILTER (inside) AS n1, count(v) FILTER (NOT inside) AS n0, avg(v) FILTER (inside) AS m1, avg(v) FILTER (NOT inside) AS m0, var_samp(v) FILTER (inside) AS v1, var_samp(v) FILTER (NOT inside) AS v0 FROM v JOIN lab USING (sample) GROUP BY 1, 2, 3)
SELECT alloc, round(max(CASE WHEN n1 >= 3 AND n0 >= 10 THEN abs(m1 - m0) / sqrt(v1 / n1 + v0 / n0) ELSE 0 END), 6) AS statistic, count(*)::BIGINT AS ranges FROM s GROUP BY alloc""")
def welch_max_family(spark, sf_dir):
    w = windows(spark, sf_dir)
    ranges = spark.createDataFrame([(a, b) for a in range(8) for b in range(a, 8)], "lo int, hi int")
    v = w.join(F.broadcast(ranges), F.col("win").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi", "sample").agg(F.avg("h").alias("v"))
    samples = w.select("sample").distinct().withColumn("alloc", F.explode(F.sequence(F.lit(0), F.lit(499))))
    from ..functions.scalars import draw_order

    n = F.row_number().over(Window.partitionBy("alloc").orderBy(draw_order(F.lit("alloc"), F.col("alloc"), F.col("sample"))))
    stats = resampling.welch(v.join(samples.withColumn("inside", n <= 5), "sample"), ["alloc", "lo", "hi"], F.col("inside"), "v", 3, 10)
    return rounded(stats.groupBy(F.col("alloc").cast("long").alias("alloc")).agg(F.max("statistic").alias("statistic"), F.count("*").alias("ranges")))


def _erfc(z: str) -> str:
    """The complementary error function in SQL: its power series, by logarithms of gamma functions, below 3, and its continued fraction from there."""
    series = f"(1 - exp(-({z} * {z})) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 150), lambda k: exp(k * 2 * ln(2) + (2 * k + 1) * ln(greatest({z}, 1e-300)) + lgamma(k + 1) - lgamma(2 * k + 2)))))"
    fraction = f"(exp(-({z} * {z})) / sqrt(pi()) / list_reduce(list_prepend(({z})::DOUBLE, list_transform(range(60, 0, -1), lambda k: k::DOUBLE)), lambda f, k: {z} + k / 2 / f))"
    return f"(CASE WHEN {z} < 3 THEN {series} ELSE {fraction} END)"


def _cox_sql(rounds: int) -> str:
    """Newton's rounds from 0, one after another; all groups of this table have a maximum that they reach without halving."""
    steps = ["""pt AS (SELECT c_nationkey AS nation, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS t, (o_orderstatus = 'F')::INT AS e, o_totalprice / 10000 AS x FROM orders JOIN customer ON o_custkey = c_custkey)""",
             "f AS (SELECT nation, count(*)::BIGINT AS n, sum(e)::BIGINT AS events, avg(x) AS mean FROM pt GROUP BY 1)", "d AS (SELECT nation, t, e, x - mean AS x FROM pt JOIN f USING (nation))", "b0 AS (SELECT nation, 0.0::DOUBLE AS beta FROM f)"]
    sums = lambda kind, more="": ", ".join(f"sum(exp(beta * x) * x ** {i}){more} AS {kind}{i}" for i in range(3))
    for k in range(rounds + 1):
        steps += [
            f"w{k} AS (SELECT nation, t, any_value(beta) AS beta, sum(e) AS dead, sum(x) FILTER (e = 1) AS ex, {sums('s')}, {sums('e', ' FILTER (e = 1)')} FROM d JOIN b{k} USING (nation) GROUP BY 1, 2)",
            f"r{k} AS (SELECT nation, beta, dead, ex, e0, e1, e2, {', '.join(f'sum(s{i}) OVER (PARTITION BY nation ORDER BY t DESC) AS s{i}' for i in range(3))} FROM w{k})",
            f"q{k} AS (SELECT nation, beta, ex, j, {', '.join(f's{i} - j / dead * e{i} AS a{i}' for i in range(3))} FROM (SELECT *, unnest(range(0, dead::BIGINT))::DOUBLE AS j FROM r{k} WHERE dead > 0))",
            f"l{k} AS (SELECT nation, any_value(beta) AS beta, sum(CASE WHEN j = 0 THEN beta * ex ELSE 0 END) - sum(ln(a0)) AS ll, sum(CASE WHEN j = 0 THEN ex ELSE 0 END) - sum(a1 / a0) AS score, sum(a2 / a0 - (a1 / a0) ** 2) AS info FROM q{k} GROUP BY 1)",
            f"b{k + 1} AS (SELECT nation, beta + score / info AS beta FROM l{k})",
        ]
    last = f"l{rounds}"
    return f"""WITH {', '.join(steps)},
p AS (SELECT a.nation, count(*)::BIGINT AS pairs, sum(CASE WHEN a.x = b.x THEN 0.5 WHEN (a.x > b.x) = (l.beta > 0) THEN 1 ELSE 0 END) AS agreed FROM d a JOIN d b ON a.nation = b.nation AND a.e = 1 AND b.t > a.t JOIN {last} l ON l.nation = a.nation GROUP BY 1),
z AS (SELECT l.*, 1 / sqrt(l.info) AS se, greatest(0, 2 * (l.ll - l0.ll)) AS lr FROM {last} l JOIN l0 USING (nation))
SELECT nation, n, events, '{statistics.STATUS[5]}' AS status, round(beta, 6) AS log_hr, round(se, 6) AS se, round(exp(beta), 6) AS hr, round(exp(beta - 1.959963984540054 * se), 6) AS low, round(exp(beta + 1.959963984540054 * se), 6) AS high, round(lr, 6) AS lr,
round({_erfc('sqrt(lr / 2)')}, 6) AS p, round({_erfc('abs(beta) / se / sqrt(2)')}, 6) AS wald_p, round(agreed / pairs, 6) AS concordance, pairs, round(ll, 6) AS log_likelihood FROM z JOIN f USING (nation) JOIN p USING (nation)"""


@plan(_cox_sql(7))
def cox_efron(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.select(F.col("c_nationkey").alias("nation"), F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("days"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), (F.col("o_totalprice") / 10000).alias("x"))
    return rounded(survival.cox_by_group(d, ["nation"], "days", "event", "x"))


def _residual_sql(terms: int) -> str:
    """Least squares in SQL: each term in turn is taken out of all later ones and of y."""
    steps = ["x0 AS (SELECT nation % 5 AS region, id, id % 3 <> 0 AS fit, (x - 25) / 25 AS x, y FROM pt)",
             "c0 AS (SELECT region, id, fit, 1.0::DOUBLE AS t0, x AS t1, x ** 2 AS t2, x ** 3 AS t3, greatest(0, x + 0.4::DOUBLE) ** 3 AS t4, greatest(0, x - 0.2::DOUBLE) ** 3 AS t5, y FROM x0)"]
    for k in range(terms):
        later = [f"t{j}" for j in range(k + 1, terms)] + ["y"]
        sums = ", ".join(f"sum(t{k} * {c}) FILTER (fit) / sum(t{k} * t{k}) FILTER (fit) AS b_{c}" for c in later)
        steps.append(f"s{k} AS (SELECT region, {sums} FROM c{k} GROUP BY region)")
        steps.append(f"c{k + 1} AS (SELECT region, id, fit, {', '.join(f'{c} - b_{c} * t{k} AS {c}' for c in later)} FROM c{k} JOIN s{k} USING (region))")
    return f"WITH {_POINTS}, {', '.join(steps)} SELECT region, id, round(y, 2) AS residual FROM c{terms}"


@plan(_residual_sql(6))
def spline_residuals(spark, sf_dir):
    p = points(spark, sf_dir).select((F.col("nation") % 5).alias("region"), "id", (F.col("id") % 3 != 0).alias("fit"), ((F.col("x") - 25) / 25).alias("x"), "y")
    return rounded(statistics.spline_residuals(p, ["region"], "y", "x", "fit", [-0.4, 0.2], "id"), digits=2)


@plan("""SELECT event_type, round(quantile_cont(value, 0.1), 6) AS q100, round(quantile_cont(value, 0.25), 6) AS q250, round(quantile_cont(value, 0.5), 6) AS q500, round(quantile_cont(value, 0.75), 6) AS q750, round(quantile_cont(value, 0.9), 6) AS q900 FROM events GROUP BY 1""")
def quantile_profile(spark, sf_dir):
    return rounded(rollups.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.25, 0.5, 0.75, 0.9]))


@plan("""WITH g AS (SELECT range * 2.5::DOUBLE AS point FROM range(0, 41)) SELECT event_type, point, round(avg((value <= point)::INT), 6) AS share FROM events, g GROUP BY 1, 2""")
def empirical_cdf(spark, sf_dir):
    return rounded(rollups.empirical_cdf(table(spark, sf_dir, "events"), ["event_type"], "value", [k * 2.5 for k in range(41)]))


@plan("""WITH w AS (SELECT event_type, value, sum(event_id % 4 + 1) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS u, sum(event_id % 4 + 1) OVER (PARTITION BY event_type) AS t FROM events WHERE value IS NOT NULL)
SELECT event_type, (min(value) FILTER (u >= (t + 1) // 2) + min(value) FILTER (u >= (t + 2) // 2)) / 2 AS weighted_median FROM w GROUP BY 1""")
def weighted_median(spark, sf_dir):
    return ranking.weighted_median(table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 4 + 1), ["event_type"], "value", "w")


@plan("""SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256(concat_ws('|', 'sub', event_id::VARCHAR))) <= 25""")
def keyed_stratified_subset(spark, sf_dir):
    return ranking.keyed_subset(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], [F.lit("sub"), F.col("event_id")], 25)


@plan("""SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice) DESC, p_partkey) <= 4""")
def top_k_per_group(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc(F.abs("p_retailprice")), F.asc("p_partkey")], 4)
