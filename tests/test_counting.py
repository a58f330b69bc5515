from pyspark.sql import functions as F

import pytest

from tallyloom.functions import scalars
from tallyloom.operators import counting, intervals, rollups
from tallyloom.sources import readers


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def read(flag=0, qs="12.0", mm="C+mh,0;", ml="C,0,0", name="r", mapq=60):
    seq = "A" * 150 + "CG" + "A" * 248 if not flag & 16 else "A" * 150 + "CG" + "A" * 248
    return f"{name}\t{flag}\tchr1\t1\t{mapq}\t400M\t*\t0\t0\t{seq}\t*\tqs:f:{qs}\tMM:Z:{mm}\tML:B:{ml}"


def states(spark, lines):
    """Decode, project to the reference site chr1:150 and call: the way alignment text becomes states."""
    reads = readers.read_sam(spark.createDataFrame([(x,) for x in lines], "value string"))
    blocks = counting.cigar_blocks(reads, ["name", "chrom", "flag"], "cigar", "pos").withColumn("rev", F.col("flag").bitwiseAND(F.lit(16)) / 16)
    site = spark.createDataFrame([("chr1", 150)], "chrom string, site long")
    placed = counting.sites_in_blocks(blocks, site, ["name"], "site", "rev")
    calls = readers.modification_calls(reads)
    j = placed.join(calls, ["name", "query_place"], "left")
    return {r.name: r.state for r in j.select("name", scalars.call_state("pm", "ph").alias("state")).collect()}


@pytest.mark.parametrize("flag", [0, 16])
def test_probability_bytes_to_states(spark, flag):
    cases = {"a": (0, 0, 0), "b": (230, 0, 1), "c": (0, 230, 2), "d": (100, 100, None), "e": (204, 0, None), "f": (205, 0, 1)}
    got = states(spark, [read(flag, ml=f"C,{m},{h}", name=k) for k, (m, h, _) in cases.items()])
    assert got == {k: s for k, (_, _, s) in cases.items()}


def test_both_kinds_are_needed(spark):
    assert states(spark, [read(mm="C+m,0;", ml="C,230")]) == {"r": None}


def test_cigar_walk_moves_both_coordinates(spark):
    r = spark.createDataFrame([("r", 10, [("S", 3), ("M", 5), ("I", 2), ("=", 4), ("D", 6), ("N", 1), ("X", 2)])], "name string, pos int, cigar array<struct<op:string,len:int>>")
    assert values(counting.cigar_blocks(r, ["name"], "cigar", "pos"), "query_start", "ref_start", "length") == [(10, 15, 4), (14, 26, 2), (3, 10, 5)]


def test_first_reason_wins_and_repeats_are_marked_among_kept(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 50), ("a", 3, 60), ("b", 1, None)], "id string, n int, q int")
    out = counting.reject(d, [("low", F.col("q") < 10), ("first", F.col("n") == 1)])
    out = counting.mark_repeats(out, ["id"], ["n"], F.col("reason") == "kept")
    assert values(out, "id", "n", "reason") == [("a", 1, "low"), ("a", 2, "kept"), ("a", 3, "duplicate"), ("b", 1, "first")]


def test_equal_weight_differs_from_pooling(spark):
    d = spark.createDataFrame([(0, 0, 8, 2), (0, 90, 0, 10)], "w int, c int, m int, h int")
    pct = counting.percents(d, ["m", "h"], ["m", "h"], F.col("c") + d["m"] + d["h"])
    r = counting.equal_weight_mean(pct, ["w"], ["m", "h"]).first()
    assert (r.m, r.h) == (40.0, 15.0) and (r.m, r.h) != (100 * 8 / 110, 100 * 12 / 110)


def test_support_needs_every_sample(spark):
    d = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, "a", 9), (3, "a", 5), (3, "b", 4)], "site int, sample string, depth int")
    assert values(counting.common_support(d, "site", "sample", F.col("depth"), 5, 2), "site") == [(1,)]


def test_promoters(spark):
    d = spark.createDataFrame([(3000, 9000, "+", 10000), (3000, 9000, "-", 10000), (100, 9000, "+", 10000)], "start long, end long, strand string, len long")
    low, high = intervals.promoter("start", "end", "strand", "len")
    assert [tuple(r) for r in d.select(low, high).collect()] == [(1000, 3500), (8500, 10000), (0, 600)]


def test_opposing_change_is_flagged(spark):
    rows = [(r, s, [60.0, 5.0]) for r in (0, 1) for s in range(6)]
    rows = [(r, s, 63.0 if r == 0 and s < 3 else v[0], 2.0 if r == 0 and s < 3 else v[1]) for r, s, v in rows]
    d = spark.createDataFrame(rows, "region int, sample int, m double, h double")
    out = {r.region: r for r in rollups.opposing(rollups.group_contrast(d, ["region"], "sample", F.col("sample") < 3, ["m", "h"]), "m", "h").collect()}
    assert out[0].opposing and out[0].m + out[0].h == 0 and out[0].h_agree == 1 and out[0].h_min_abs == 3
    assert not out[1].opposing and not out[1].candidate


def test_validated_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    assert rollups.validated_join(a, b, ["k"], "many_to_one").count() == 2
    with pytest.raises(Exception, match="left side is not unique"):
        rollups.validated_join(a, b, ["k"], "one_to_one").collect()


def test_markers_flags_and_missing(spark):
    d = spark.createDataFrame([("ACTACGTGCA", 4), ("ACTACGTGCA", 5), ("ACTACGTGCA", 0), ("AAAAAACGAAAAAA", 6), ("GCNTA", 2), ("GTGAAAATC", 2)], "s string, i int")
    assert [r[0] for r in d.select(scalars.marker_allowed("s", "i")).collect()] == [False, False, True, False, False, False]
    m = spark.createDataFrame([("NA",), ("",), ("None",), ("1.5",), (None,)], "x string")
    assert [r[0] for r in m.select(scalars.parse_missing("x")).collect()] == [None, None, None, "1.5", None]
    f = spark.createDataFrame([("True",), ("False",), ("1",)], "x string")
    assert [r[0] for r in f.select(scalars.parse_flag("x")).collect()] == [True, False, None]


def test_age_scale(spark):
    d = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "e double")
    got = [r[0] for r in d.select(scalars.age_from_linear(F.col("e"))).collect()]
    assert got == pytest.approx([21 / 2.718281828459045 - 1, 20, 41])


def test_guard_of_saturated_probabilities(spark):
    d = spark.createDataFrame([(100, 156), (0, 0)], "m int, h int")
    assert counting.guard_sum(d, "m", "h").count() == 2 and counting.guard_sum(d, "m", "h").agg(F.sum("m")).first()[0] == 100
    with pytest.raises(Exception, match="over 256"):
        counting.guard_sum(spark.createDataFrame([(200, 100)], "m int, h int"), "m", "h").agg(F.sum("m")).collect()


def test_composition_windows_cover_the_whole_text(spark, tmp_path):
    from tallyloom.plans.catalogue import QUERIES

    rows = [(1, "A" * 400 + "G" * 400 + "GA"), (2, "gc"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["composition_windows"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.5), (2, 0, 1.0), (3, 0, None), (4, 0, None)]


def test_caliper_without_k_takes_every_control(spark):
    from tallyloom.operators import matching

    t = spark.createDataFrame([(0, 1, 10.0)], "id long, g int, v double")
    c = spark.createDataFrame([(i, 1, 10.0) for i in range(1, 31)], "id long, g int, v double")
    assert matching.caliper_matches(t, c, ["g"], {"v": 1.2}, "id", None).count() == 30
