"""Proportional hazards on Spark against the array version, and tails against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import tails
from tallyloom.operators import statistics, survival


def cohort(rng, n, step):
    t = np.ceil(rng.exponential(40, n) / step) * step
    x = np.round(rng.normal(size=n), 1)
    return [(float(a), int(b), float(c)) for a, b, c in zip(t, rng.random(n) < 0.6, x)]


def test_equals_the_array_version(spark):
    rng = np.random.default_rng(5)
    groups = {f"g{i}": cohort(rng, n, step) for i, (n, step) in enumerate([(30, 1), (200, 10), (900, 0.01), (60, 40), (12, 1)])}
    groups |= {"none": [(1.0, 0, 1.0), (2.0, 0, 2.0)], "flat": [(1.0, 1, 3.0), (2.0, 1, 3.0)], "endless": [(float(i), 1, -float(i)) for i in range(9)], "other way": [(float(i), 1, float(i)) for i in range(9)]}
    rows = [(g, *r) for g, rs in groups.items() for r in rs] + [("g0", None, 1, 1.0), ("g0", 3.0, None, 1.0), ("g0", 3.0, 1, None), ("g0", 3.0, 1, float("nan")), (None, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, t double, e int, x double").repartition(5)
    got = {r.g: r for r in survival.cox_by_group(df, ["g"], "t", "e", "x").collect()}
    assert set(got) == set(groups)
    for g, rs in groups.items():
        t, e, x = map(np.array, zip(*rs))
        want = statistics.cox(t, e, x)
        assert got[g].n == len(rs) and got[g].events == e.sum() and got[g].status == want["status"], g
        for name in ("log_hr", "se", "hr", "low", "high", "lr", "p", "wald_p", "concordance", "pairs", "log_likelihood"):
            if want.get(name) is None:
                assert got[g][name] is None
            else:
                assert got[g][name] == pytest.approx(want[name], rel=1e-7, abs=1e-9), (g, name)
    assert sum(got[g].status == statistics.STATUS[5] for g in groups) >= 4


def test_weights_are_copies(spark):
    rng = np.random.default_rng(8)
    rows = [(*r, int(k)) for r, k in zip(cohort(rng, 80, 5), rng.integers(0, 4, 80))]
    df = spark.createDataFrame([("a", *r) for r in rows], "g string, t double, e int, x double, k int")
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") + 1))).where("i <= k")
    one, two = (r.asDict() for r in (survival.cox_by_group(df, ["g"], "t", "e", "x", "k").first(), survival.cox_by_group(copies, ["g"], "t", "e", "x").first()))
    assert one == pytest.approx(two) and one["log_hr"] is not None


def test_tied_deaths_go_over_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", *r) for r in cohort(rng, 300, 30)], "g string, t double, e int, x double")
    want = survival.cox_by_group(df, ["g"], "t", "e", "x").first().asDict()
    monkeypatch.setattr(survival, "_PIECE", 3)
    assert survival.cox_by_group(df, ["g"], "t", "e", "x").first().asDict() == pytest.approx(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, t double, e int, x double")
    assert survival.cox_by_group(df, ["g"], "t", "e", "x").collect() == []
    only = spark.createDataFrame([("a", 1.0, 0, 1.0)], "g string, t double, e int, x double")
    assert survival.cox_by_group(only, ["g"], "t", "e", "x").first().status == statistics.STATUS[0]


def test_normal_tail(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.959963984540054, 2.0, 2.8284271, 3.0, 5.0, 9.0, 30.0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").select("i", tails.normal_two_sided(F.col("z")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(v / math.sqrt(2)) for v in z], rel=1e-11, abs=0)


def test_t_tail(spark):
    def direct(t, df, steps=400_000):
        """Simpson's rule on the density, in the angle whose tangent is t / sqrt(df)."""
        a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, steps + 1)
        y = np.cos(a) ** (df - 1)
        area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (a[1] - a[0]) / 3
        return 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    cases = [(t, df) for t in (0.0, 1e-3, 0.5, 1.0, -2.0, 4.0, 12.0) for df in (1, 2, 3, 7, 10, 31, 200)]
    got = spark.createDataFrame([(i, float(t), d) for i, (t, d) in enumerate(cases)], "i int, t double, d int").select("i", tails.t_two_sided(F.col("t"), F.col("d")).alias("p")).orderBy("i").collect()
    for r, (t, d) in zip(got, cases):
        assert r.p == pytest.approx(direct(t, d), rel=1e-9, abs=1e-14), (t, d)
    # Student's t with one degree of freedom is the Cauchy distribution; the usual 5 % points of ten and thirty.
    assert got[cases.index((1.0, 1))].p == pytest.approx(0.5, rel=1e-12)
    two = spark.range(1).select(tails.t_two_sided(F.lit(2.2281388519649385), F.lit(10)).alias("a"), tails.t_two_sided(F.lit(2.0422724563012373), F.lit(30)).alias("b"), tails.t_two_sided(F.lit(1.0), F.lit(0)).alias("c")).first()
    assert two.a == pytest.approx(0.05, rel=1e-10) and two.b == pytest.approx(0.05, rel=1e-10) and two.c is None
