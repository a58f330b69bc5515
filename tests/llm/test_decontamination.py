from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontamination as dc
from tallyloom.llm import queries

from .conftest import words


def brute(docs, items, threshold=0.8):
    """Every window of every document against every item."""
    out = []
    split = lambda t: [w for w in t.lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    for i, t in sorted({d for d in docs if d[1] is not None}, key=str):
        w = split(t)
        for j, x in items:
            item = split(x or "")
            n = min(5, len(item))
            if not item or len(w) < n:
                continue
            g, best = grams(item, n), None
            for s in range(max(1, len(w) - len(item) + 1)):
                v = grams(w[s : s + len(item)], n)
                sim = sum((g & v).values()) / sum((g | v).values())
                if sim >= threshold and (best is None or sim > best[0] + 1e-12):
                    best = (sim, s)
            if best:
                out.append((i, j, round(best[0], 6)))
    return sorted(out, key=str)


def make(rng):
    items = [(k, " ".join(words(rng, rng.choice([5, 6, 9, 20, 40, 60])))) for k in range(25)]
    items += [(30, "four words are few"), (31, None), (32, ""), (33, "rep a b c d " * 6), (34, items[0][1])]
    docs = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            p = rng.choice(items)[1] or "x"
            p = p.upper().split() if i % 2 else p.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        docs.append((i, " ".join(w) if i % 3 else "\n".join(w)))
    return docs + [(200, None), (201, ""), (202, items[4][1]), (203, " ".join(items[4][1].split()[:-1])), (204, "pad " * 30000 + items[6][1]), (205, "rep a b c d " * 50)], items


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force_with_and_without_broadcast(spark, docs_of, rng):
    docs, items = make(rng)
    want = brute(docs, items)
    assert len(want) > 15 and any(s < 1 for _, _, s in want)
    for most in (500_000, 0):
        got = dc.matches(docs_of(docs), table(spark, items), most=most).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 6)) for r in got), key=str) == want


def test_other_thresholds(spark, docs_of, rng):
    docs, items = make(rng)
    for t, radius in ((0.6, 29), (0.95, 11)):
        got = dc.matches(docs_of(docs), table(spark, items), threshold=t, radius=radius).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 6)) for r in got), key=str) == brute(docs, items, t)


def test_sql_says_the_same(spark, docs_of, rng, tmp_path):
    docs, items = make(rng)
    docs_of(docs + [docs[3], docs[6]]).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, queries.op5_benchmark_decontamination(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP5_SQL).fetchall(), key=str)


def test_block_tables_find_all_within_the_radius(spark, rng):
    base = [rng.getrandbits(64) for _ in range(10)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    near = []
    for k, b in enumerate(base):
        for n in range(0, 40):
            x = b
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            near.append((len(near), k, n, signed(x)))
    w = spark.createDataFrame([(r, 5, 9, 0, x) for r, k, _, x in near], "row long, width int, total int, start int, fp long")
    i = spark.createDataFrame([(k, 5, 9, signed(b)) for k, b in enumerate(base)] + [(99, 5, 8, near[0][3])], "item long, width int, total int, fp long")
    for radius in (-1, 0, 3, 12, 17, 29):
        for most in (0, 10**6):
            got = sorted((r.row, r.item) for r in dc._candidates(w, i, radius, most).collect())
            assert got == [(r, k) for r, _, _, x in near for k, b in enumerate(base) if ((x ^ b) % 2**64).bit_count() <= radius]


def test_the_index_alone_says_which_item(spark, docs_of, rng):
    """Pairs come from the block tables: without them nothing is found, and a smaller radius loses edited copies only."""
    docs, items = make(rng)
    want = brute(docs, items)
    run = lambda radius: sorted(((r.doc_id, r.item_id, round(r.similarity, 6)) for r in dc.matches(docs_of(docs), table(spark, items), radius=radius).collect()), key=str)
    assert run(-1) == []
    exact = run(0)
    assert {x for x in want if x[2] == 1} <= set(exact) < set(want)


def test_recall_against_brute_force_at_the_threshold(spark, docs_of, rng):
    items = [(k, " ".join(words(rng, rng.choice([15, 25, 40, 59]), 5000))) for k in range(60)]
    docs = []
    for i in range(400):
        p = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            p[rng.randrange(len(p))] = f"edit{i}"
        docs.append((i, " ".join(words(rng, rng.randrange(60), 5000) + p + words(rng, rng.randrange(60), 5000))))
    want = {x[:2] for x in brute(docs, items)}
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs_of(docs), table(spark, items)).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("longest", [9 * 3, 200, 40000])
def test_fingerprint_bits(spark, rng, longest):
    rows = [(g, rng.getrandbits(64) - 2**63, 1 + rng.randrange(3)) for g in range(5) for _ in range(9)]
    got = {r.g: r.fp % 2**64 for r in dc._fingerprints(spark.createDataFrame(rows, "g long, h long, times int"), ["g"], longest).collect()}
    for g in range(5):
        own = [(h % 2**64, t) for k, h, t in rows if k == g]
        assert got[g] == sum(1 << b for b in range(64) if 2 * sum(t * (h >> b & 1) for h, t in own) > sum(t for _, t in own))


def test_short_and_nameless_items_match(spark, docs_of):
    items = [(None, "one two three four five six"), (1, "Only three words"), (2, "word"), (3, None), (3, " "), (4, "p q r s t u"), (4, "a b c d e f g h")]
    docs = [(1, "x one two three four five six y"), (2, "here only  three\nwords stand"), (3, "a word"), (4, "a b c d e f g h"), (5, "only three"), (None, "word")]
    got = sorted(((r.doc_id, r.item_id, r.start, r.size) for r in dc.matches(docs_of(docs), table(spark, items)).collect()), key=str)
    assert got == sorted([(1, None, 1, 6), (2, 1, 1, 3), (3, 2, 1, 1), (4, 4, 0, 8), (None, 2, 0, 1)], key=str)


def test_filter_keeps_clean_rows_and_columns(spark, docs_of, rng):
    docs, items = make(rng)
    df = docs_of(docs + [(None, items[6][1]), (None, "clean text only here now"), (7, "clean"), (7, "clean")]).withColumn("start", F.lit("s")).withColumn("h", F.lit(1)).withColumn("item_id", F.lit(None)).withColumn("row", F.lit("mine"))
    kept = dc.decontaminate(df, table(spark, items))
    assert kept.columns == df.columns and {r.row for r in kept.collect()} == {"mine"}
    leaked = {i for i, _, _ in brute(docs, items)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted([str(i) for i, _ in docs if i not in leaked] + ["None", "7", "7"])
    assert dc.decontaminate(docs_of([]), table(spark, items)).count() == 0
    assert dc.decontaminate(df, table(spark, [])).count() == df.count()
