import hashlib

from tallyloom.llm import substring

from .conftest import words


def brute(rows, window=50):
    """Window by window over the input, smallest starting doc_id per word sequence."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k : k + window])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def make_rows(rng):
    passages = [words(rng, n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 12)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[cut:]
        rows.append((i, " ".join(w)))
    rows.append((60, "\n\t ".join(rows[3][1].split())))
    rows.append((61, rows[3][1] + " tail"))
    rows += [(62, None), (63, ""), (64, "the " * 20000), (65, "the " * 300), (66, " ".join(passages[4] + passages[3] + passages[4]))]
    return rows


def test_matches_brute_force(docs_of, rng):
    rows = make_rows(rng)
    assert result(substring.substring_dedup(docs_of(rows))) == brute(rows)


def test_window_and_gram_are_parameters(docs_of, rng):
    rows = make_rows(rng)
    assert result(substring.substring_dedup(docs_of(rows), window=12, gram=5)) == brute(rows, 12)


def test_repeats_null_ids_and_clashing_columns(docs_of, rng):
    from pyspark.sql import functions as F

    a, b = words(rng, 90), words(rng, 90)
    rows = [(5, " ".join(a)), (5, " ".join(b + a)), (5, " ".join(b + a)), (None, " ".join(a)), (7, " ".join(b[:60] + a)), (3, " ".join(a[10:70]))]
    df = docs_of(rows).withColumn("sha", F.lit("x")).withColumn("anchors", F.lit(1)).withColumn("n_removed", F.lit(2))
    assert result(substring.substring_dedup(df)) == brute(rows)
    assert result(substring.substring_dedup(docs_of([]))) == []


def test_factors_are_the_removed_spans(docs_of, rng):
    rows = make_rows(rng)
    texts = dict(rows)
    for r in substring.substring_dedup(docs_of(rows), with_text=True).where("size(factors) > 0").collect():
        w = texts[r.doc_id].split()
        for f in r.factors:
            assert f.source < r.doc_id and f.length >= 50
            assert w[f.start : f.start + f.length] == texts[f.source].split()[f.source_start : f.source_start + f.length]
        assert all(a.start + a.length < b.start + b.length and a.start < b.start for a, b in zip(r.factors, r.factors[1:]))
        gone = set()
        for f in r.factors:
            gone |= set(range(f.start, f.start + f.length))
        assert r.kept == " ".join(x for k, x in enumerate(w) if k not in gone) and len(gone) == r.n_removed


def test_a_factor_is_extended_to_its_end_and_boundaries_are_looked_up(docs_of, rng):
    """One long copy is one factor; two passages of one source, joined, are two factors and what straddles them stays."""
    long, other = words(rng, 400, 9000), words(rng, 300, 9000)
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(words(rng, 30, 9000) + long[20:390] + words(rng, 30, 9000))), (4, " ".join(long[:120] + other[100:220])), (5, " ".join(long[:60] + other[:49] + long[60:]))]
    got = {r.doc_id: r for r in substring.substring_dedup(docs_of(rows)).collect()}
    assert [tuple(f) for f in got[3].factors] == [(30, 370, 1, 20)]
    assert [tuple(f) for f in got[4].factors] == [(0, 120, 1, 0), (120, 120, 2, 100)]
    assert [tuple(f) for f in got[5].factors] == [(0, 60, 1, 0), (109, 340, 1, 60)] and got[5].n_removed == 400
    assert result(substring.substring_dedup(docs_of(rows))) == brute(rows)


def test_blocks_cover_every_passage_once():
    import numpy as np

    own = np.array([5, 5, 5, 7, 7, 2, 2, 2, 2, 2, 2, 2], np.uint64)
    at, n = substring._spans(own, 3)
    assert at.tolist() == [0, 3, 5, 8, 11] and n.tolist() == [3, 2, 3, 3, 1]


def test_bytes_that_are_no_text(spark):
    a = b" ".join(b"w%d\xff" % k for k in range(80))
    df = spark.createDataFrame([(1, a), (2, b"own " + a)], "doc_id long, text binary")
    got = {r.doc_id: r for r in substring.substring_dedup(df, with_text=True).collect()}
    assert got[2].kept == "own" and got[2].n_removed == 80
