import duckdb
import pytest

from tallyloom.llm import mixing, queries


def by_hand(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


def rows_of(rng):
    rows = []
    for i in range(400):
        source = rng.choice(["big"] * 6 + ["a", "é", "zz", None])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)), "en", source))
    return rows + [(400, None, None, "tiny"), (401, "one two", "en", "tiny"), (402, "word " * 5000, "en", "big")]


def test_targets_and_taken(docs_of, rng):
    rows = rows_of(rng)
    got = mixing.mix(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(403))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = by_hand(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] = taken.get(r.source, 0) + r.taken
    longest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    assert abs(sum(taken.values()) - sum(sizes.values())) <= max(longest.values())


def test_reruns_and_partitions_agree(docs_of, rng):
    rows = rows_of(rng)
    a = sorted(map(str, mixing.mix(docs_of(rows, 1)).collect()))
    assert a == sorted(map(str, mixing.mix(docs_of(rows[::-1], 7), cells=16).collect()))


def test_sql_says_the_same(spark, docs_of, rng, tmp_path):
    docs_of(rows_of(rng) + [(7, "same row", "en", "a"), (8, "", "en", None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op9_source_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP9_SQL).fetchall())


def test_empty_repeats_and_clashing_columns(docs_of):
    from pyspark.sql import functions as F

    assert mixing.mix(docs_of([])).count() == 0
    same = docs_of([(1, "a b", "en", "s")] * 3 + [(None, None, None, None)]).withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("epoch", F.lit(2))
    got = mixing.mix(same).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == [(0, 0, 0), (1, 2, 2), (1, 2, 2), (1, 2, 2)]


def test_cells_follow_the_rows(spark):
    assert mixing.cells_for(spark.range(10)) == 256 and mixing.cells_for(spark.range(300), rows=1) == 4096


def test_documents_of_the_mix_carry_their_columns(docs_of, rng):
    from pyspark.sql import functions as F

    rows = rows_of(rng) + [(7, "x y", "en", "a"), (7, "x y", "de", "a"), (8, "one w", "en", "a"), (8, "two w", "en", "a"), (None, "z", "en", None)]
    docs = docs_of(rows).withColumn("size", F.lit("mine")).withColumn("document", F.lit(5))
    got = mixing.mixed_documents(docs).collect()
    plain = {}
    for r in mixing.mix(docs).collect():
        k = (r.doc_id, r.source, r.size)
        plain[k] = plain.get(k, 0) + r.taken
    seen = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken == r.epochs * r.size and r.epochs > 0 and r.document == 5
        seen[r.doc_id, r.source, r.size] = seen.get((r.doc_id, r.source, r.size), 0) + r.taken
    assert seen == {k: v for k, v in plain.items() if k in seen} and sum(seen.values()) == sum(plain.values())
    assert len({(r.doc_id, r.source, r.text) for r in got}) == len(got)


def test_texts_are_exchanged_once(docs_of, rng):
    plan = mixing.mixed_documents(docs_of(rows_of(rng))).drop("n_chars")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("XxHash64") + plan.count("xxhash64") == 1, plan
