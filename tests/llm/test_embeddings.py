import math

import numpy as np
from pyspark.sql import types as T

from tallyloom.llm import embeddings

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, threshold=0.98):
    def usable(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.asarray(a[1], float), np.asarray(b[1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], n[i], least.get(find(i)), None if r[0] is None else r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


def rows_of(seed=3):
    g = np.random.default_rng(seed)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    rows = []
    for k in range(60):
        base = g.normal(size=16) * np.linspace(3, 0.3, 16)
        for _ in range(1 + k % 6):
            rows.append((len(rows), f32(base + g.normal(size=16) * 0.12), int(k % 3)))
        rows.append((len(rows), f32(base * 2), int(k % 3)))
        rows.append((len(rows), f32(base), int(k % 3)))
    v = rows[0][1]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, v, None), (903, [float("nan")] + v[1:], 0), (904, [None] + v[1:], 0), (905, [], 0), (906, v[:5], 0), (907, [float("inf")] + v[1:], 0), (908, v[:5], 0)]
    return rows


def result(spark, rows, **k):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, embeddings.near_duplicates(df, **k).collect()), key=str)


def test_matches_brute_force_at_any_tile_size(spark):
    rows = rows_of()
    want = brute(rows)
    assert sum(n for _, n, _, _ in want) > 100
    assert result(spark, rows) == want
    assert result(spark, rows, tile=7) == want


def test_other_thresholds(spark):
    rows = rows_of(5)
    for t in (0.5, 0.9, 0.999):
        assert result(spark, rows, threshold=t, tile=16) == brute(rows, t)


def test_empty_repeats_and_null_ids(spark):
    assert result(spark, []) == []
    v = [1.0, 2.0, 3.0]
    rows = [(4, v, 1), (4, v, 1), (2, v, 1), (None, v, 1), (None, None, 1), (None, None, None)]
    assert result(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], SCHEMA).withColumn("v", F.lit(1)).withColumn("node", F.lit(2)).withColumn("n_links", F.lit(3))
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
