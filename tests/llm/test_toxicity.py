import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, toxicity

from .conftest import words


def corpus(rng, n=240):
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 120), 200)
        bad = i % 3 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile,", "RUDE!!", "éW%%"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "fr"))
        labels.append((i, int(bad)))
    return rows, labels


def slow_features(model, text):
    rows = toxicity._rows(model, toxicity.hashes(text))
    out = []
    for f, b in zip(model.filters, model.biases):
        best = np.zeros(f.shape[2])
        for at in range(1 - len(f), len(rows)):
            x = b.copy()
            for k in range(len(f)):
                if 0 <= at + k < len(rows):
                    x = x + model.embeddings[rows[at + k]] @ f[k]
            best = np.maximum(best, x)
        out.append(best)
    return np.concatenate(out)


def test_features_match_brute_force_in_pieces():
    model = toxicity.fit([b"a b c d"] * 6 + [b"c d e f g"] * 6, np.array([0.0, 1.0] * 6), shared_by=2, epochs=1)
    for text in (b"", b"a", b"a b c d e f g zz " * 9):
        rows = toxicity._rows(model, toxicity.hashes(text))
        for piece in (3, 1 << 14):
            assert toxicity.features(model, model.tables(), rows, piece) == pytest.approx(slow_features(model, text), abs=1e-5)


def test_gradient_matches_differences():
    model = toxicity.fit([b"a b c d"] * 6 + [b"c d e f g"] * 6, np.array([0.0, 1.0] * 6), shared_by=2, epochs=2)
    texts, labels, weight = [b"a c e b d g zz", b"c", b"g f a a a"], np.array([1.0, 0.0, 0.0]), np.array([1.0, 0.5, 2.0])
    rows = [toxicity._rows(model, toxicity.hashes(t)) for t in texts]
    params = [model.embeddings, *model.filters, *model.biases, model.weights, np.zeros(1)]
    grads = [np.zeros_like(p) for p in params]
    toxicity._gradient(model, 0.0, rows, labels, weight, grads)

    def loss():
        x = [slow_features(model, t) @ model.weights for t in texts]
        return sum(w * math.log1p(math.exp(-v if y else v)) for v, y, w in zip(x, labels, weight))

    for p, g in zip(params[:-1], grads):
        for i in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_held_out_accuracy_and_leakage(spark, docs_of, rng):
    rows, labels = corpus(rng)
    docs = docs_of(rows + [(900, None), (901, ""), (902, "plain " * 40000 + "vile,")])
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, table, learn)).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (y == 1) for i, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.5 and len(got) == len(rows) + 3
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    assert got == {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, flipped, learn)).collect()}
    assert got == {r.doc_id: r.score for r in toxicity.score(docs.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(9)), toxicity.train(docs, table, learn)).collect()}


def test_thresholds_by_language(spark, docs_of, rng, monkeypatch):
    rows, labels = corpus(rng, 900)
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    cuts, thresholds = {}, toxicity.thresholds
    monkeypatch.setattr(toxicity, "thresholds", lambda *a: cuts.update(thresholds(*a)) or cuts)
    out = toxicity.classify(docs_of(rows + [(1700, "vile", None)]), table, F.lit(True))
    by = {r.doc_id: r for r in out.collect()}
    assert set(cuts) == {"en", "fr"} and by[1700].threshold == 0.5 and all(by[i].threshold == cuts["en" if i % 2 else "fr"] for i in range(900))
    assert sum(by[i].toxic == (y == 1) for i, y in labels) / len(labels) > 0.95


def test_thresholds_come_from_rows_that_trained_nothing(spark, docs_of, rng, monkeypatch):
    rows, labels = corpus(rng)
    seen, train, thresholds = {}, toxicity.train, toxicity.thresholds
    monkeypatch.setattr(toxicity, "train", lambda d, t, keep, n: seen.update(train={r.doc_id for r in t.where(keep).collect()}) or train(d, t, keep, n, epochs=1))
    monkeypatch.setattr(toxicity, "thresholds", lambda d, t, keep: seen.update(cut={r.doc_id for r in t.where(keep).collect()}) or thresholds(d, t, keep))
    toxicity.classify(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 2 == 0)
    assert seen["train"] and seen["cut"] and not seen["train"] & seen["cut"] and seen["train"] | seen["cut"] == set(range(0, 240, 2))


def test_query_matches_brute_force(spark, docs_of, rng, tmp_path):
    """The query's own scores against slow features under the same network."""
    rows, labels = corpus(rng, 90)
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, str(tmp_path)).collect()}
    learn = (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0)
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), learn)
    for i, t, _ in rows:
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(slow_features(model, t.encode()) @ model.weights + model.bias))), abs=1e-5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_no_labels_or_rows(spark, docs_of, tmp_path):
    docs_of([(1, "a"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.score == 0 and r.predicted == 0 and not r.toxic for r in got)
    assert toxicity.score(docs_of([]), toxicity.fit([], np.zeros(0))).count() == 0


def test_long_texts_teach(spark, docs_of):
    docs = docs_of([(1, "x " * 150_000 + "bad " * 10), (2, "y " * 10), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.labelled(docs, labels, "toxic", F.lit(True), 10).collect()}
    assert set(got) == {1, 2} and len(got[1].text) < 202_000 and "bad" in got[1].text and got[2].text == "y " * 10
