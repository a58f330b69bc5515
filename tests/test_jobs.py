"""Both jobs: their SQL, two runs over growing input, and runs that are stopped or repeated."""

import json
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import incremental_counts, queries, region_extract

TABLES = "orders customer lineitem documents labels".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql_says_the_same(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall()]
    near = lambda rs: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs), key=str)
    assert near(map(tuple, got.collect())) == near(rows) and rows


@pytest.fixture()
def calls(spark, small, tmp_path):
    """Three deliveries: some calls, other calls with all of the first again, and the first ones changed."""
    line = spark.read.parquet(f"{small}/lineitem.parquet").where("l_orderkey % 3 < 2")
    first = line.where("l_orderkey % 3 = 0").persist()
    parts = [first, line.where("l_orderkey % 3 = 1").unionByName(first), first.withColumn("l_suppkey", F.col("l_suppkey") + 1)]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    config = {"calls": str(tmp_path / "calls"), "orders": f"{small}/orders.parquet", "customers": f"{small}/customer.parquet", "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "checkpoint")}
    (tmp_path / "calls").mkdir()
    yield config, lambda i: [shutil.copy(f, tmp_path / "calls" / f"{i}-{f.name}") for f in (tmp_path / f"part{i}").glob("*.parquet")]
    first.unpersist()


def counts(df):
    return {(r.sample, r.site): (r.c, r.m, r.h) for r in df.collect()}


def expected(spark, config, sources):
    """Rows of the deliveries in turn; the first call of each read and place counts."""
    sample = {r.o_orderkey: r.c_nationkey for r in spark.read.parquet(config["orders"]).join(spark.read.parquet(config["customers"]), F.col("o_custkey") == F.col("c_custkey")).collect()}
    seen, found = set(), Counter()
    for path in sources:
        rows = [r for r in spark.read.parquet(path).collect() if r.l_orderkey in sample and r.l_quantity >= 5 and r.l_suppkey is not None]
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in incremental_counts.ORDER)):
            if (r.l_orderkey, r.l_linenumber) not in seen:
                seen.add((r.l_orderkey, r.l_linenumber))
                found[sample[r.l_orderkey], r.l_suppkey, r.l_returnflag] += 1
    keys = {k[:2] for k in found}
    return {k: tuple(found[(*k, s)] for s in incremental_counts.STATES.values()) for k in keys}


def test_counts_grow_with_the_input(spark, calls, tmp_path):
    config, deliver = calls
    assert counts(incremental_counts.run(spark, config)) == {}
    for i in range(3):
        deliver(i)
        got = counts(incremental_counts.run(spark, config))
        assert got == expected(spark, config, [str(tmp_path / f"part{k}") for k in range(i + 1)]) and got
    again = sorted(p for p in Path(config["output"]).rglob("*.parquet"))
    assert counts(incremental_counts.run(spark, config)) == got
    assert sorted(p for p in Path(config["output"]).rglob("*.parquet")) == again  # nothing new, nothing written
    reasons = {(r.batch, r.reason): r.n for r in spark.read.parquet(f"{config['output']}/checks").collect()}
    assert reasons[1, "seen"] == reasons[2, "seen"] == reasons[0, "kept"] and (2, "kept") not in reasons


def test_a_repeated_batch_counts_once(spark, calls):
    config, deliver = calls
    deliver(0)
    incremental_counts.run(spark, config)
    deliver(1)
    want = counts(incremental_counts.run(spark, config))
    for name in ("1", ".1.crc"):  # as if the run had ended after its last write and before the batch was committed
        (Path(config["checkpoint"]) / "commits" / name).unlink(missing_ok=True)
    assert counts(incremental_counts.run(spark, config)) == want


def test_a_stopped_batch_goes_on(spark, calls, monkeypatch):
    config, deliver = calls
    deliver(0)
    incremental_counts.run(spark, config)
    deliver(1)
    real, left = incremental_counts._replace, [2]

    def stop(*a):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("stopped")
        real(*a)

    monkeypatch.setattr(incremental_counts, "_replace", stop)
    with pytest.raises(Exception, match="stopped"):
        incremental_counts.run(spark, config)
    monkeypatch.setattr(incremental_counts, "_replace", real)
    got = counts(incremental_counts.run(spark, config))
    assert got == expected(spark, config, [str(Path(config["calls"]).parent / f"part{k}") for k in range(2)])


@pytest.fixture()
def texts(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.when(F.col("source") != F.lit("src00"), F.col("source")))
    docs.write.parquet(str(tmp_path / "documents"))
    return {"documents": str(tmp_path / "documents"), "needed": f"{small}/labels.parquet", "output": str(tmp_path / "out"), "samples_at_once": 2}


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_stopped_extraction_goes_on(spark, texts, tmp_path, monkeypatch):
    full = rows(region_extract.run(spark, texts | {"output": str(tmp_path / "other"), "samples_at_once": 100}))
    real, asked = region_extract._batch, []

    def stop(contigs, some, *a):
        asked.append([r.sample for r in some])
        if len(asked) == 3:
            raise RuntimeError("stopped")
        real(contigs, some, *a)

    monkeypatch.setattr(region_extract, "_batch", stop)
    with pytest.raises(RuntimeError):
        region_extract.run(spark, texts)
    part = rows(region_extract.reads(spark, texts["output"]))
    assert set(part) < set(full)
    assert rows(region_extract.run(spark, texts)) == full
    assert asked[3] == asked[2] and not set(asked[0] + asked[1]) & {s for some in asked[3:] for s in some}
    n = len(asked)
    assert rows(region_extract.run(spark, texts)) == full and len(asked) == n  # nothing changed, nothing done


def test_only_changed_samples_are_extracted(spark, texts, monkeypatch):
    region_extract.run(spark, texts)
    extra = spark.createDataFrame([(10**9, "Enough light through\nthe high night\n\nno site here, mail a@b.cd right", "en", "new", 60), (None, "right", "en", "new", 5)], spark.read.parquet(texts["documents"]).schema)
    extra.write.mode("append").parquet(texts["documents"])
    needed = spark.read.parquet(texts["needed"]).unionByName(spark.createDataFrame([(10**9, 1, 0)], "doc_id long, quality int, toxic int"))
    needed.write.parquet(f"{texts['output']}-needed")
    real, asked = region_extract._batch, []
    monkeypatch.setattr(region_extract, "_batch", lambda contigs, some, *a: (asked.extend(r.sample for r in some), real(contigs, some, *a)))
    got = region_extract.run(spark, texts | {"needed": f"{texts['output']}-needed"}).where("sample = 'new'").orderBy("line").collect()
    assert asked == ["new"]
    assert [(r.line, r.start, r.end, r.text, r.n_targets) for r in got] == [(0, 0, 20, "Enough light through", 1), (1, 21, 35, "the high night", 1)]
    assert got[0].covered == 20 and got[0].gc == pytest.approx(3 / 20)
    done = spark.read.parquet(f"{texts['output']}/done").where("sample = 'new'").first()
    assert (done.contigs, done.reads, done.held) == (1, 2, 1)


def test_a_sample_that_loses_its_reads(spark, texts):
    first = region_extract.run(spark, texts)
    assert first.count() and first.where("sample is null").count() >= 0
    got = region_extract.run(spark, texts | {"motif": "QQQQ"})
    assert got.count() == 0  # reads of the earlier rules are still in the files, and are not taken


def test_names_are_unique(spark, texts):
    spark.read.parquet(texts["documents"]).limit(2).write.mode("append").parquet(texts["documents"])
    with pytest.raises(ValueError, match="2 names"):
        region_extract.run(spark, texts)


@pytest.mark.parametrize("job", ["incremental_counts", "region_extract"])
def test_command_line(job, small, tmp_path):
    given = json.loads(Path(f"jobs/{job}.json").read_text())
    given |= {"calls": f"{small}/lineitem.parquet", "orders": f"{small}/orders.parquet", "customers": f"{small}/customer.parquet", "documents": f"{small}/documents.parquet", "needed": f"{small}/labels.parquet", "output": "", "checkpoint": str(tmp_path / "checkpoint")}
    (tmp_path / "config.json").write_text(json.dumps(given))
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", str(tmp_path / "config.json"), f"output={tmp_path / 'out'}"], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert list((tmp_path / "out").rglob("*.parquet")) and "read" in done.stderr


def test_jobs_need_no_text_operators():
    code = "import sys; sys.modules['tallyloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import jobs.queries; assert len(jobs.queries.QUERIES) == 2"
    assert subprocess.run([sys.executable, "-c", code], timeout=60).returncode == 0
