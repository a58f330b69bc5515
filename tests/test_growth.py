"""Queries on tables that differ from the small ones: degenerate values, repeated rows, other orders of size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.plans.catalogue import ORACLE_SQL, QUERIES


def written(folder, **tables):
    """Tables made by DuckDB's SQL, and a connection that sees them."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(found):
    return sorted((tuple(None if isinstance(v, float) and v != v else v for v in r) for r in found), key=str)


def same_as_sql(spark, con, folder, name):
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert rows_of(map(tuple, got)) == rows_of(want.fetchall()) and got
    return got


def test_replicates_without_spread_stay_in_the_interval(spark, tmp_path):
    con = written(tmp_path, customer="""SELECT range AS c_custkey, (range % 25)::INT AS c_nationkey,
        CASE WHEN range % 25 = 0 THEN 6000.0 ELSE 4500.0 END::DOUBLE + (CASE WHEN range % 2 = 0 THEN 1 ELSE -1 END) * (range % 25 * 7 % 11) AS c_acctbal FROM range(0, 413)""")
    (row,) = same_as_sql(spark, con, tmp_path, "adjusted_association")
    assert row.low < row.rho and row.high != row.high


@pytest.mark.parametrize("distance", ["largest", "squares"])
def test_nearest_blocks_are_those_of_all_matches(spark, distance):
    from tallyloom.operators import matching

    d = spark.range(3000).select("id", (F.col("id") % 2).alias("ctx"), F.round(100 + 400 * F.rand(3), F.lit(0)).alias("a"), F.when(F.col("id") % 97 != 0, F.floor(1 + 20 * F.rand(4)).cast("double")).alias("b"), (F.col("id") % 23).alias("part"))
    d = d.unionByName(d.withColumn("id", F.col("id") + 3000)).localCheckpoint()
    args = dict(ratios={"a": 1.3}, differences={"b": 4.0}, distance=distance)
    for block, k, least in (("part", 5, 2), ("id", 7, 1)):
        want = matching.one_per_block(matching.caliper_matches(d.where("id % 9 = 0"), d.where("id % 4 <> 0"), ["ctx"], key="id", k=None, **args), "id", f"c_{block}", k, least)
        got = matching.nearest_blocks(d.where("id % 9 = 0"), d.where("id % 4 <> 0"), ["ctx"], key="id", k=k, block=block, least=least, **args)
        shown = ["id", "c_id", "place", "distance"]
        assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))


def repeated_parts(times):
    """``times`` copies of 1200 parts."""
    return f"""SELECT i + 1200 * k AS p_partkey, 'brand' || i % 3 AS p_brand, (1 + i * 7 % 50)::INT AS p_size, (900 + i * 37 % 1100)::DOUBLE AS p_retailprice, 'type' AS p_type FROM range(0, 1200) t(i), range(0, {times}) s(k)"""


@pytest.mark.parametrize("name", ["paired_metric_difference", "matched_set_null", "caliper_pools"])
def test_pools_of_repeated_parts(spark, tmp_path, name):
    from tallyloom.plans import studies

    same_as_sql(spark, written(tmp_path, part=repeated_parts(3)), tmp_path, name)
    compared = studies.pool_places(*studies.pool_sides(spark, str(tmp_path)))
    (tmp_path / "more").mkdir()
    written(tmp_path / "more", part=repeated_parts(6))
    assert studies.pool_places(*studies.pool_sides(spark, str(tmp_path / "more"))).count() == compared.count() > 0


@pytest.mark.parametrize("name", ["caliper_match_topk", "caliper_block_match", "difference_caliper_blocks"])
def test_calipers_broadcast_nothing(spark, tmp_path, name):
    con = written(tmp_path, part=repeated_parts(2).replace("'type'", "'type' || i % 4"))
    same_as_sql(spark, con, tmp_path, name)
    d = QUERIES[name](spark, str(tmp_path))
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_pairs_within_calipers_are_no_rows_before_they_come_out(spark, tmp_path):
    from tallyloom.operators import matching

    d = [(i, None if i % 41 == 0 else f"b{i % 2}", 100.0 + i * 37 % 60, (1.0, 2.0, 3.0, 0.0, -2.0, float("inf"), None)[i % 7]) for i in range(400)]
    d = spark.createDataFrame(d, "id long, g string, a double, b double")
    want = sorted((x.id, y.id) for x in d.collect() if x.id % 20 == 0 for y in d.collect() if y.id % 20 and x.g == y.g is not None and x.b and y.b and 0.8 <= y.a / x.a <= 1.25 and 2 / 3 <= y.b / x.b <= 1.5)
    for chunks in ((2048, 32768), (3, 17)):
        got = matching.caliper_pairs(d.where("id % 20 = 0"), d.where("id % 20 <> 0"), ["g"], {"a": (0.8, 1.25), "b": (2 / 3, 1.5)}, "id", chunks=chunks)
        assert sorted(map(tuple, got.collect())) == want and want
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    # Signs and zeros as SQL has them, and no exchange of pairs.
    con = written(tmp_path, part="SELECT i AS p_partkey, 'b' || i % 2 AS p_brand, (i % 7 - 3)::INT AS p_size, CASE WHEN i % 13 = 0 THEN 0 ELSE (i % 3 - 1) * (90 + i % 31) END::DOUBLE AS p_retailprice FROM range(0, 900) t(i)")
    same_as_sql(spark, con, tmp_path, "caliper_pools")
    plan = QUERIES["caliper_pools"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("SortMergeJoin") == 3


def test_permutations_meet_keys_in_bundles(spark):
    import hashlib

    from tallyloom.operators import resampling

    rows = [(k, u, None if (k + u) % 5 == 0 else float((u * 7 + k * 3) % 11)) for k in range(6) for u in range(7)]
    out = resampling.label_permutation(spark.createDataFrame(rows, "k int, u int, v double"), ["k"], "u", F.col("u") < 3, "v", 99, "s")
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().sparkPlan().toString()  # no row a key and permutation
    got, mean = {r.k: r for r in out.collect()}, lambda x: sum(x) / len(x)
    for k in range(6):
        mine = [(u, v) for a, u, v in rows if a == k and v is not None]
        diff = lambda inside: mean([v for u, v in mine if inside(u)]) - mean([v for u, v in mine if not inside(u)])
        null = []
        for rep in range(1, 100):
            order = sorted(range(7), key=lambda u: hashlib.sha256(f"s|{rep}|{u}".encode()).hexdigest())
            null.append({u: i < 3 for i, u in enumerate(order)})
        null = [diff(x.get) for x in null if any(x[u] for u, _ in mine) and not all(x[u] for u, _ in mine)]
        assert got[k].seen == pytest.approx(diff(lambda u: u < 3)) and got[k].p == pytest.approx((1 + sum(abs(d) >= abs(got[k].seen) - 1e-12 for d in null)) / (1 + len(null)))


def test_trades_of_a_long_matrix_end_soon():
    """210 trades a row of 20,000 rows, and states of a small matrix equally often."""
    import collections
    import time

    import numpy as np

    from tallyloom.operators import resampling

    g, began = np.random.default_rng(2), time.process_time()
    resampling.curveball(g.integers(0, 2, (20_000, 7)).astype(np.int8), g, 210 * 20_000)
    assert time.process_time() - began < 40
    z, seen = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1]], np.int8), collections.Counter()
    for _ in range(6000):
        resampling.curveball(z, g, 5)
        seen[z.tobytes()] += 1
    assert len(seen) == 6 and max(abs(n - 1000) for n in seen.values()) < 160


def test_fixed_margins_of_a_group_of_any_size(spark):
    from tallyloom.operators import resampling

    d = spark.range(2_100_000).selectExpr("'a' AS g", "id DIV 7 AS i", "int(id % 7) AS j", "int(xxhash64(id) % 2 = 0) AS v").where("(i + j) % 3 > 0")
    d = d.unionByName(spark.range(700_000).selectExpr("'a' AS g", "id DIV 7 + 300000 AS i", "int(id % 7) AS j", "1 AS v")).unionByName(spark.createDataFrame([("b", 1, 1, None)], d.schema))
    got = {r.g: r for r in resampling.fixed_margin_null(d, ["g"], "i", "j", "v", draws=2, burn_in=1, apart=1).collect()}
    assert (got["a"].n_rows, got["a"].n_columns) == (400_000, 7) and got["a"].moves > 100_000 and got["a"].residual == pytest.approx(got["a"].observed - got["a"].null_mean)
    assert (got["b"].n_rows, got["b"].observed, got["b"].eligible) == (0, None, False)


@pytest.mark.parametrize("shape", [(41, 7), (40, 30), (1, 3), (2, 300)])
def test_trades_are_those_of_whole_ranks(shape):
    import numpy as np

    from tallyloom.operators import resampling

    g = np.random.default_rng(8)
    z = g.integers(-1, 2, shape).astype(np.int8)
    want, rng, left, changed = z.copy(), np.random.default_rng(3), 777 if len(z) > 1 else 0, 0
    while left > 0:
        pairs = min(left, len(z) // 2)
        order = rng.permutation(len(z))
        for i, j, u in zip(order[:pairs], order[pairs : 2 * pairs], rng.random((pairs, shape[1]))):
            pool = [c for c in np.argsort(u) if {want[i, c], want[j, c]} == {0, 1}]
            back = pool[: sum(want[i, c] == 1 for c in pool)]
            changed += {*back} != {c for c in pool if want[i, c] == 1}
            want[i, pool], want[j, pool] = 0, 1
            want[i, back], want[j, back] = 1, 0
        left -= pairs
    assert resampling.curveball(z, np.random.default_rng(3), 777) == changed and (z == want).all()


def test_pairs_of_a_draw_are_no_rows(spark):
    from tallyloom.operators import statistics

    d = spark.range(40).selectExpr("id % 2 AS g", "id", "double(id % 7) AS x", "double(id * 13 % 17) AS y")
    out = statistics.theil_sen_bootstrap(d, ["g"], "x", "y", "id", 20, "s")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "MapInPandas" in plan and "slice(" not in plan and out.count() == 40


def test_subsamples_are_cut_where_units_are_read(spark):
    import hashlib

    from tallyloom.operators import resampling

    # The second group's rows are of two units, so their digests are not even and most replicates must look at all of it.
    rows = [("a", i) for i in range(700)] + [(None, i % 2) for i in range(900)] + [("c", i) for i in range(5)]
    out = resampling.subsample(spark.createDataFrame(rows, "g string, u long"), ["g"], "u", 4, 6, "s")
    assert "Generate" not in out._jdf.queryExecution().sparkPlan().toString()  # a unit is no row of each replicate up to the end
    got = sorted(((r.g or "", r.rep, r.slot, r.u) for r in out.collect()))
    want = []
    for g in ("a", None, "c"):
        for rep in range(6):
            units = sorted((hashlib.sha256(f"s|{rep}|{u}".encode()).hexdigest(), u) for h, u in rows if h == g)
            want += [(g or "", rep, k + 1, u) for k, (_, u) in enumerate(units[:4])]
    assert got == sorted(want)


def test_a_molecule_with_two_states_at_a_site_is_not_whole(spark):
    from tallyloom.operators import studies

    rows = [("g", m, s, (m + s) % 3) for m in range(20) for s in range(3)] + [("g", 99, 0, 0), ("g", 99, 0, 2), ("g", 99, 1, 1)]
    (row,) = studies.block_patterns(spark.createDataFrame(rows, "g string, m long, s long, x long"), ["g"], "m", "s", "x").collect()
    assert row.molecules == 20 and row.entropy is not None


def test_refits_of_a_cohort_go_together():
    """Each refit's status and estimate are those of its own fit, and 2000 of them end soon."""
    import time

    import numpy as np

    from tallyloom.operators import statistics

    g = np.random.default_rng(3)
    for n, step in ((200, 0.5), (40, 30), (8, 20), (5, 1)):
        t, e, x = np.ceil(g.exponential(40, n) / step) * step, (g.random(n) < 0.6).astype(int), np.round(g.normal(size=n), 1)
        if n == 5:
            x[:] = [1, 1, 1, 1, 2]
        copies = np.stack([np.ones(n, int)] + [np.bincount(g.integers(0, n, n), minlength=n) for _ in range(2000 if n == 200 else 60)])
        began = time.process_time()
        status, log_hr = statistics.cox_refits(t, e, x, copies)
        assert time.process_time() - began < 2.5
        for k, s, b in list(zip(copies, status, log_hr))[:60]:
            want = statistics.cox(np.repeat(t, k), np.repeat(e, k), np.repeat(x, k))
            assert s == want["status"] and (np.isnan(b) if "log_hr" not in want else b == pytest.approx(want["log_hr"], abs=1e-11))


def test_draws_and_keys_meet_in_bundles(spark):
    from tallyloom.operators import resampling

    rows = [(k, u, float((u * 7 + k * 3) % 11)) for k in range(5) for u in range(7) if (k + u) % 4] + [(9, 1, 2.0)]
    out = resampling.bootstrap_contrast(spark.createDataFrame(rows, "k int, u int, v double"), ["k"], "u", F.col("u") < 3, "v", 50)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().sparkPlan().toString()  # no row a key and replicate
    got = {r.k: r for r in out.collect()}
    assert set(got) == set(range(5)) and all(r.low <= r.high for r in got.values())


def test_permutations_of_a_scan_are_no_rows(spark):
    import numpy as np

    from tallyloom.operators import studies

    g = np.random.default_rng(1)
    rows = [(k, "f", u, float(g.integers(0, 9)), *map(float, g.normal(size=3))) for k in range(4) for u in range(20 - k % 2)]
    out = studies.locus_scan(spark.createDataFrame(rows, "w int, f string, u int, x double, y double, r double, c double"), "w", "f", "u", "x", "y", "r", "c", permutations=60, control_permutations=30)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().sparkPlan().toString()
    got = out.collect()
    assert len(got) == 4 and all(0 < r.p <= 1 and r.loo_min <= r.loo_max for r in got)


def test_pairs_are_counted_in_slabs(spark):
    import numpy as np

    from tallyloom.operators import statistics, survival

    g, rows, want = np.random.default_rng(4), [], {}
    for name, times, values in (("a", 500, 400), ("b", 6, 300), ("c", 300, 2), ("d", 1, 5)):
        t, x, e, k = g.integers(0, times, 400).astype(float), g.integers(0, values, 400) / 4, g.integers(0, 2, 400), g.integers(1, 4, 400)
        rows += [(name, *map(float, r[:2]), int(r[2]), int(r[3])) for r in zip(t, x, e, k)]
        later = (t[:, None] < t[None]) * (e * k)[:, None] * k[None]
        want[name] = tuple(int(later[c].sum()) for c in (np.full((400, 400), True), x[:, None] > x[None], x[:, None] == x[None]))
    out = survival.ordered_pairs(spark.createDataFrame(rows, "g string, _t double, _x double, _e int, _k long"), ["g"], cells=8)
    assert "shiftright" not in out._jdf.queryExecution().sparkPlan().toString()  # no row a row and bit
    assert {r.g: (r.pairs, r.higher, r.level) for r in out.collect()} == want


def test_weights_of_a_unit_stay_in_its_task(spark):
    import hashlib

    import numpy as np

    from tallyloom.operators import resampling

    rows = [(k, u, u * 3 % 5) for k in range(3) for u in range(40 if k else 2)] + [(1, 5, 2), (1, 6, None)]
    out = resampling.unit_bootstrap(spark.createDataFrame(rows, "k int, u int, v int"), ["k"], "u", "v", 60, "pois")
    assert "Generate" not in out._jdf.queryExecution().sparkPlan().toString()  # no row a unit and replicate
    steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(8)])
    for r in out.collect():
        mine = [(u, v) for k, u, v in rows if k == r.k and v is not None]
        means = []
        for rep in range(60):
            drawn = lambda u: (int(hashlib.sha256(f"pois|{u}|{rep // 8}".encode()).hexdigest()[rep % 8 * 8 :][:8], 16) + 0.5) / 2**32
            w = [int((steps <= drawn(u)).sum()) for u, _ in mine]
            means.append(sum(a * v for a, (_, v) in zip(w, mine)) / sum(w) if sum(w) else None)
        plain = sum(v for _, v in mine) / len(mine)
        want = np.percentile([plain if m is None else m for m in means], [2.5, 50, 97.5])
        assert (r.units, r.empty) == (len({u for u, _ in mine}), means.count(None)) and [r.mean, r.low, r.mid, r.high] == pytest.approx([plain, *want])
    assert r.k == 2 or out.where("k = 0").first().empty > 0


def test_draws_of_features_are_summed_in_bundles(spark):
    import numpy as np

    from tallyloom.operators import studies

    x = np.random.default_rng(4).normal(size=(9, 12)) + np.array([0] * 4 + [1] * 5)[:, None] * 0.8
    d = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(9) for j in range(12)] + [(None, 3, 1.0)], "u long, f long, v double").where("u IS NOT NULL")
    whole = sorted(map(tuple, studies.cluster_stability(d, "u", "f", "v", repeats=40).collect()))
    assert whole == sorted(map(tuple, studies.cluster_stability(d, "u", "f", "v", repeats=40, features_at_once=5, pairs_at_once=7).collect())) and len(whole) == 9


def test_a_bundle_passes_on_only_what_can_be_chosen(spark, monkeypatch):
    from tallyloom.operators import studies

    # Sizes with ties, a unit twice at a key, one without a label, keys of three strata.
    values = [(u, k, float((u * k * 7 + k * k) % 11)) for u in range(15) for k in range(60) if (u + k) % 9] + [(2, 5, 3.0), (99, 1, 1.0)]
    labels = [(a, u, (u * (a + 3)) % 15 < 4) for a in range(4) for u in range(15)]
    parts = [(u, k, p, float((u + k * p) % 7)) for u in range(15) for k in range(60) for p in range(2)]
    frames = (spark.createDataFrame(values, "u int, k int, v double"), spark.createDataFrame(parts, "u int, k int, part int, v double"), spark.createDataFrame(labels, "alloc int, u int, inside boolean"))
    seen, passed_on = [], studies.passed_on
    monkeypatch.setattr(studies, "passed_on", lambda d: seen.append(passed_on(d)) or seen[-1])
    results = [sorted(map(tuple, studies.nested_reselection(*frames, "u", "k", "v", F.col("k") % 3, "part", 2, least_in=2, least_out=3, bundles=b, keys_at_once=n).collect())) for b, n in ((1, 100), (2, 8), (1, 1))]
    d = [x.count() for x in seen if "_stratum" in x.columns]
    assert results[0] and results[0] == results[1] == results[2]
    assert d[0] <= 4 * 15 * (3 + 3) + 4 * 6 < len(values) * 4 == d[2] + 4  # a key alone is passed on whole
