import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import lattice
from tallyloom.llm.common import fold

from .conftest import words

PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "é", "bab"]


def small():
    w = np.linspace(1, 2, len(PIECES))
    return lattice.Lattice(PIECES, np.concatenate([w / w.sum() * 0.9, np.full(256, 0.1 / 256)]))


def all_cuts(word, model):
    """Probabilities of every segmentation, spelled-out characters included."""
    if not word:
        return [(1.0, ())]
    out = []
    for k in range(1, len(word) + 1):
        steps = [(math.exp(model.log[model.index[word[:k]]]), (model.index[word[:k]],))] if word[:k] in model.index else []
        if k == 1:
            b = word[0].encode()
            steps.append((math.exp(sum(model.log[model.n + x] for x in b)), tuple(model.n + x for x in b)))
        for p, used in steps:
            out += [(p * q, used + rest) for q, rest in all_cuts(word[k:], model)]
    return out


@pytest.mark.parametrize("word", ["▁", "▁ab", "▁abab", "▁éba", "▁xyz", "▁babab"])
def test_sums_all_segmentations(word):
    model = small()
    cuts = all_cuts(word, model)
    total = sum(p for p, _ in cuts)
    assert model.score([word])[0] == pytest.approx(math.log(total)) == model._scalar(word)
    want = np.zeros(model.n + 256)
    for p, used in cuts:
        for u in used:
            want[u] += 3 * p / total
    assert model.expect([word], np.array([3.0])) == pytest.approx(want)
    scalar = np.zeros(model.n + 256)
    model._scalar(word, 3.0, scalar)
    assert scalar == pytest.approx(want)


def test_long_words_agree_with_short_path(monkeypatch):
    model = small()
    many = ["▁" + "abé"[: 1 + i % 3] * (i % 7 + 1) for i in range(50)]
    fast = model.score(many)
    monkeypatch.setattr(lattice, "LONG", 1)
    assert model.score(many) == pytest.approx(fast)


def test_re_estimation_raises_the_likelihood():
    pieces, weights = lattice.read_vocabulary()
    text = ["▁" + w for w in ("the", "thing", "nthering", "thnt", "ouble", "reth")] * 3
    counts = np.arange(1, len(text) + 1, dtype=float)
    last = -math.inf
    for _ in range(4):
        model = lattice.Lattice(pieces, weights)
        now = float((model.score(text) * counts).sum())
        assert now > last
        last, weights = now, model.expect(text, counts) + 1e-9
        weights = weights / weights.sum()


def test_contract_columns(docs_of, rng):
    rows = [(i, " ".join(words(rng, rng.randrange(40), 60)).upper()) for i in range(120)] + [(200, None), (201, ""), (202, "ünï cøde " + "x" * 5000), (203, "w1 " * 3000), (7, "w1 w2 only here"), (None, "w1")]
    df = docs_of(rows).withColumn("row", F.lit(1)).withColumn("id", F.lit("z")).withColumn("score", F.lit(0))
    got = lattice.score_texts(df, fold("doc_id", 10) == 0).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update((t or "").encode().lower().split())
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(i), held(i), len(k), sum(count[w] > 0 for w in k), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k), 6))
        for i, t in rows for k in [(t or "").encode().lower().split() + ["end"]]
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    few = lattice.score_texts(df, fold("doc_id", 10) == 0, common=1).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, few)) == sorted(map(key, got))


def test_score_matches_brute_force(docs_of, rng):
    """The whole way: counts, two rounds of expectation maximisation, all segmentations of all words, and the end."""
    pool = ["ab", "the", "a", "é", "thé", "xq", "anth", "ther"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 9)))) for i in range(60)] + [(70, "unseen THE zz"), (80, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update((t or "").lower().split())
            ends += 1
    pieces, weights = lattice.read_vocabulary()
    weights, end = weights * 0.99, 0.01
    for _ in range(2):
        model = lattice.Lattice(pieces, weights)
        expected = np.full(len(weights), 0.01)
        for w, n in count.items():
            cuts = all_cuts(lattice.MARK + w, model)
            total = sum(p for p, _ in cuts)
            for p, used in cuts:
                for u in used:
                    expected[u] += n * p / total
        total = expected.sum() + ends + 0.01
        weights, end = expected / total, (ends + 0.01) / total
    model = lattice.Lattice(pieces, weights)
    log = {w: math.log10(sum(p for p, _ in all_cuts(lattice.MARK + w, model))) for w in {w for _, t in rows for w in (t or "").lower().split()}}
    for common in (1, 200_000):
        got = {r.doc_id: r.score for r in lattice.score_texts(docs_of(rows), fold("doc_id", 10) == 0, common=common).collect()}
        assert got == pytest.approx({i: sum(log[w] for w in (t or "").lower().split()) + math.log10(end) for i, t in rows})


def test_bytes_that_are_no_text(spark):
    rows = spark.createDataFrame([(1, b"a\xffb a"), (2, b"\xc3"), (3, b"ok a"), (4, b"x" * 50 + b"\xfe" * 3)], "doc_id long, text binary")
    got = lattice.score_texts(rows, F.lit(False)).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [3, 2, 3, 2] and all(math.isfinite(r.score) for r in got)


def test_empty_table_and_nothing_to_learn(docs_of):
    assert lattice.score_texts(docs_of([]), F.lit(False)).count() == 0
    got = lattice.score_texts(docs_of([(1, "a b")]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] and math.isfinite(got[0].score)
