import gzip

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import guards
from tallyloom.sources import readers
from tallyloom.streaming import counts


def test_tsv_round_trip_with_missing_and_types(spark, tmp_path):
    path = str(tmp_path / "x.tsv.gz")
    with gzip.open(path, "wt") as f:
        f.write("id\tv\tflag\n1\t2.5\tTrue\n2\tNA\tFalse\n3\t\tNone\n")
    d = readers.read_tsv(spark, path, "id int, v double, flag string")
    assert sorted(map(tuple, d.collect())) == [(1, 2.5, "True"), (2, None, "False"), (3, None, None)]
    readers.write_tsv(d, str(tmp_path / "out"), digits=10)
    assert sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / "out"), "id int, v double, flag string").collect())) == sorted(map(tuple, d.collect()))
    with pytest.raises(ValueError, match="unexpected"):
        readers.read_tsv(spark, path, "id int, v double")


def test_reference_sites_cross_piece_borders(spark):
    seq = "A" * 150 + "CG" + "A" * 99847 + "CG" + "ACGCG"
    d = spark.createDataFrame([("chr1", seq), ("chr2", "AAAA"), ("chr3", "cgcG")], "chrom string, seq string")
    want = [("chr1", i) for i in range(len(seq)) if seq[i : i + 2] == "CG"] + [("chr3", 0), ("chr3", 2)]
    assert sorted(map(tuple, readers.sites_of(d).collect())) == want


def test_fasta_and_interval_pieces(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 note\nACGT\nAC\n>chr2\nGGG\n")
    d = readers.read_fasta(spark, str(tmp_path / "r.fa"))
    assert sorted(map(tuple, d.collect())) == [("chr1", "ACGTAC"), ("chr2", "GGG")]
    i = spark.createDataFrame([("chr1", 1, 4)], "chrom string, start int, end int")
    assert readers.interval_sequence(i, d).first().piece == "CGT"


def test_series_metadata(spark):
    lines = ['!Other\t"x"', '!Sample_title\t"a"\t"b"', '!Sample_ch\t"age: 18"\t"age: 20"', '!Sample_ch\t"sex: f"\t"sex: m"', '!Sample_note\t"p"\t"q"', '!Sample_note\t"r"\t"s"']
    d = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    out = readers.metadata_table(readers.series_metadata(d), ["title", "age", "sex", "note"])
    assert sorted(map(tuple, out.collect())) == [(0, "a", "18", "f", "p | r"), (1, "b", "20", "m", "q | s")]


def test_target_rows_check_width_and_repeats(spark):
    t = spark.createDataFrame([("p1",), ("p2",)], "target string")
    ok = spark.createDataFrame([('"p1"\t1\t2',), ("p9\t1",), ("p2\t3\t4",)], "value string")
    assert sorted(r.target for r in readers.target_rows(ok, t, width=3).collect()) == ["p1", "p2"]
    for bad, why in (([("p1\t1\t2",), ("p1\t1\t2",)], "repeated target"), ([("p1\t1",)], "wrong width")):
        with pytest.raises(Exception, match=why):
            readers.target_rows(spark.createDataFrame(bad, "value string"), t, width=3).collect()


def test_manifest_hash_json_and_bed(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text('[{"k": 1, "p": [{"x": 2}]},\n {"k": 3, "p": []}]')
    assert readers.read_manifest(spark, str(tmp_path)).first().bytes == (tmp_path / "a.json").stat().st_size
    assert readers.read_checked(spark, str(tmp_path / "a.json")).first().sha256 == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    assert [r.k for r in readers.read_json(spark, str(tmp_path / "a.json")).orderBy("k").collect()] == [1, 3]
    b = spark.createDataFrame([("chr10", 1, 2), ("chr2", 9, 12), ("chr2", 3, 4)], "chrom string, start int, end int")
    readers.write_bed(b, str(tmp_path / "bed"))
    rows = [line for p in sorted((tmp_path / "bed").glob("part*")) for line in p.read_text().splitlines()]
    assert rows == ["chr2\t3\t4", "chr2\t9\t12", "chr10\t1\t2"]


def test_guards(spark):
    d = spark.createDataFrame([(1, "mail me@x.org"), (2, "GSM12345 and 10.0.0.1"), (3, None)], "id int, t string")
    f = {r.id: (r.has_email, r.has_accession, r.has_address) for r in guards.flag_text(d, "t").collect()}
    assert f == {1: (True, False, False), 2: (False, True, True), 3: (False, False, False)}
    with pytest.raises(Exception, match="rule broken: adult"):
        guards.require(spark.createDataFrame([(17.99,)], "age double"), {"adult": F.col("age") >= 18}).collect()
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, guards.set_differences(a, b, ["k"]).collect())) == [(1, "left"), (3, "right")]
    order = spark.createDataFrame([(2, 0), (1, 1)], "k int, place int")
    assert [r.k for r in guards.select_in_order(a, order, "k", "place").collect()] == [2, 1]
    with pytest.raises(Exception, match="rule broken"):
        guards.select_in_order(b, order, "k", "place").collect()


def test_streaming_counts_equal_batch(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = counts.deduplicated(counts.read_events(spark, str(tmp_path / "in"), schema, 1), ["event_id"], "ts", "60 days")
    out = counts.windowed_states(stream, "ts", "1 day", ["event_type"], "user_id", {1: "one", 2: "two"})
    q = out.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(str, spark.sql("SELECT * FROM seen").collect()))
    batch = counts.windowed_states(spark.read.parquet(f"{small}/events.parquet"), "ts", "1 day", ["event_type"], "user_id", {1: "one", 2: "two"})
    assert got == sorted(map(str, batch.collect())) and got
