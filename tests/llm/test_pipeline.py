import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import quality, queries

from . import test_decontamination, test_lines, test_quality, test_simhash
from .conftest import words


def corpus(rng):
    items = [(k, " ".join(words(rng, 25))) for k in range(6)]
    shared = [" ".join(words(rng, 12)) for _ in range(6)]
    rows, labels = [], []
    for i in range(240):
        body = [" ".join(words(rng, rng.randrange(5, 15))) for _ in range(rng.randrange(2, 6))]
        if i % 6 == 0:
            body[1:1] = shared[: rng.randrange(2, 6)]
        if i % 9 == 0:
            body.append(rng.choice(items)[1])
        if i % 7 == 0:
            body = [" ".join(w.upper() + "##" for w in x.split()) for x in body]
        rows.append((i, "\n".join(body), "en" if i % 2 else "fr", rng.choice(["a", "a", "a", "b", None])))
        labels.append((i, int(i % 7 != 0), 0))
    for k in range(12):
        rows.append((300 + k, rows[1 + 8 * k][1] + (" w1" if k % 2 else ""), "en", "c"))
    rows += [(400, None, "en", "a"), (401, "", None, "b"), (402, "w1 " * 9000, "fr", "b")]
    return rows, labels, items


def brute(spark, rows, labels, items):
    """The first four stages without Spark's operators."""
    ids = spark.createDataFrame([(i,) for i, q, _ in labels if q], "i long").withColumn("fold", F.pmod(F.xxhash64("i"), F.lit(5))).collect()
    train = {r.i for r in ids if r.fold}
    rest = {r.i for r in ids if not r.fold}
    model = test_quality.SlowKneserNey([r[1] for r in rows if r[0] in train])
    ppl = {r[0]: model.log_ppl(r[1]) for r in rows if (r[1] or "").split()}
    groups = {}
    for r in rows:
        if r[0] in rest:
            for lang in (r[2], "all"):
                groups.setdefault(lang, []).append(int(np.floor(ppl[r[0]] / 0.002)))
    cut = {}
    for lang, steps in groups.items():
        steps.sort()
        n = next(k for k in range(1, len(steps) + 1) if sum(s <= steps[k - 1] for s in steps) >= quality.QUANTILE * len(steps))
        cut[lang] = (steps[n - 1] + 1) * 0.002
    limit = lambda lang: cut[lang] if len(groups.get(lang, [])) >= 30 else cut["all"]
    rows = [r for r in rows if r[0] in ppl and ppl[r[0]] <= limit(r[2])]
    lines = {r[0]: r for r in test_lines.brute([r[:2] for r in rows])}
    rows = [(r[0], lines[r[0]][1], r[2], r[3]) for r in rows if lines[r[0]][2] > lines[r[0]][3] or not lines[r[0]][3]]
    roots = test_simhash.slow_similar([r[:2] for r in rows])
    rows = [r for r in rows if roots[r[0]] == r[0]]
    leaks = {i for i, _, _ in test_decontamination.brute([r[:2] for r in rows], items)}
    return [r for r in rows if r[0] not in leaks]


def test_matches_brute_force(spark, docs_of, rng, tmp_path):
    rows, labels, items = corpus(rng)
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    want = brute(spark, rows, labels, items)
    assert 50 < len(want) < len(rows) - 40
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", want)
    mixed = con.sql(f"SELECT * FROM ({queries.OP9_SQL}) WHERE taken > 0").fetchall()
    assert sorted(map(tuple, got.where("taken > 0").select("doc_id", "size", "source_size", "target", "taken").collect())) == sorted(mixed)


def test_stages_keep_the_columns(spark, docs_of, rng, tmp_path):
    rows, labels, items = corpus(rng)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(rows[:60])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    from tallyloom.llm.common import _CLEANUP, keep

    before = spark.conf.get(_CLEANUP)
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    known = lambda: env.mapOutputTracker().shuffleStatuses().size()
    old = known()
    assert keep(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()).count() == 7
    assert known() <= old + 1 and spark.conf.get(_CLEANUP) == before  # that of the last count alone may stay
