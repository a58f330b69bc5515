from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import intervals

SPANS = st.lists(st.tuples(st.integers(0, 3), st.integers(-30, 60), st.integers(0, 25)), max_size=25)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, spans):
    return spark.createDataFrame([(k, i, s, s + n) for i, (k, s, n) in enumerate(spans)], "k int, i int, start int, end int")


@QUICK
@given(SPANS, SPANS, st.integers(1, 40))
def test_overlap_join_matches_brute_force(spark, a, b, size):
    got = sorted((r.i, r.r_i) for r in intervals.overlap_join(frame(spark, a), frame(spark, b), ["k"], bin_size=size).collect())
    want = sorted((i, j) for i, (k, s, n) in enumerate(a) for j, (q, t, m) in enumerate(b) if k == q and n and m and s < t + m and t < s + n)
    assert got == want


@QUICK
@given(SPANS, st.lists(st.integers(-40, 90), max_size=20), st.integers(1, 40))
def test_points_match_brute_force(spark, a, points, size):
    p = spark.createDataFrame([(x,) for x in points], "pos int")
    got = sorted((r.pos, r.i) for r in intervals.points_in_intervals(p, frame(spark, a), [], "pos", bin_size=size).collect())
    assert got == sorted((x, i) for x in points for i, (_, s, n) in enumerate(a) if s <= x < s + n)


@QUICK
@given(SPANS)
def test_unions_and_coverage_match_brute_force(spark, a):
    covered = {}
    for k, s, n in a:
        for x in range(s, s + n):
            covered.setdefault(k, {}).setdefault(x, 0)
            covered[k][x] += 1
    d = frame(spark, a)
    assert {r.k: r.length for r in intervals.union_length(d, ["k"]).collect()} == {k: len(v) for k, v in covered.items()}
    seen = {}
    for r in intervals.coverage(d.where("end > start"), ["k"]).collect():
        for x in range(r.start, r.end):
            seen.setdefault(r.k, {})[x] = r.depth
    assert seen == covered


def test_fixed_unions_and_overlaps(spark):
    d = spark.createDataFrame([(0, 0, 10), (0, 5, 20), (0, 25, 30)], "k int, start int, end int")
    assert intervals.union_length(d, ["k"], low=F.lit(3), high=F.lit(28)).first().length == 20
    b = spark.createDataFrame([(0, 10), (20, 30)], "s int, e int")
    assert b.withColumn("s5", F.lit(5)).withColumn("e25", F.lit(25)).agg(F.sum(intervals.overlap_length("s", "e", "s5", "e25"))).first()[0] == 10


def test_anti_join_keeps_what_nothing_touches(spark):
    d = spark.createDataFrame([(0, 0, 5), (1, 5, 9), (2, 20, 30)], "_id int, start int, end int")
    other = spark.createDataFrame([(4, 6), (29, 30)], "start int, end int")
    assert [r._id for r in intervals.overlap_join(d, other, [], bin_size=7, how="left_anti").collect()] == []
    assert [r._id for r in intervals.overlap_join(d, other.where("start > 10"), [], bin_size=7, how="left_anti").orderBy("_id").collect()] == [0, 1]


def test_touching_intervals_merge_only_if_asked(spark):
    d = spark.createDataFrame([(0, 0, 5), (0, 5, 9), (0, 2, 3), (0, 11, 12)], "k int, start int, end int")
    assert sorted((r.start, r.end, r.members) for r in intervals.clusters(d, ["k"]).collect()) == [(0, 9, 3), (11, 12, 1)]
    assert sorted((r.start, r.end) for r in intervals.clusters(d, ["k"], touching=False).collect()) == [(0, 5), (5, 9), (11, 12)]


def test_runs_break_at_gaps_and_signs(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in ((1, 2.0), (2, 3.0), (3, -1.0), (4, -2.0), (6, -2.0), (7, 0.0), (8, 1.0))], "k int, i int, v double")
    got = sorted((r.first, r.last, r.sign) for r in intervals.merge_adjacent(d, ["k"], "i", F.signum("v").cast("int")).collect())
    assert got == [(1, 2, 1), (3, 4, -1), (6, 6, -1), (8, 8, 1)]
