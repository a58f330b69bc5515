import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import dealt, quality

from .conftest import words


class SlowKneserNey:
    def __init__(self, texts):
        grams = Counter()
        for t in texts:
            w = ["<s>", "<s>", *t.split(), "</s>"]
            grams.update(zip(w, w[1:], w[2:]))
        self.levels = [grams]
        self.levels.append(Counter(g[1:] for g in grams))
        self.levels.append(Counter(g[1:] for g in self.levels[1]))
        self.d = [quality.discounts(Counter(x.values())) for x in self.levels]
        self.contexts = []
        for level in self.levels:
            c = defaultdict(list)
            for g, n in level.items():
                c[g[:-1]].append(n)
            self.contexts.append(c)

    def p(self, gram):
        level = 3 - len(gram)
        cut = lambda n: self.d[level][min(n, 3) - 1]
        seen = self.contexts[level].get(gram[:-1])
        if level == 2:
            lower = 1 / (len(self.levels[2]) + 1)
        else:
            lower = self.p(gram[1:])
        if not seen:
            return lower
        n = self.levels[level].get(gram, 0)
        return (n - cut(n) if n else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * lower

    def log_ppl(self, text):
        w = ["<s>", "<s>", *text.split(), "</s>"]
        return -sum(math.log(self.p(g)) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)


def corpus(rng, n=60):
    return [" ".join(words(rng, rng.randrange(3, 60), 30)) for _ in range(n)]


def test_perplexity_matches_brute_force(docs_of, rng):
    texts = corpus(rng)
    model = quality.fit(docs_of(list(enumerate(texts)) + [(99, None)]))
    slow = SlowKneserNey(texts)
    new = corpus(rng, 20) + ["never seen words", "w1 never w2", "w1 " * 3000]
    got = {r.doc_id: r for r in quality.score(docs_of(list(enumerate(new)) + [(90, None), (91, " \n")]), model).collect()}
    for i, t in enumerate(new):
        assert got[i]._log_ppl == pytest.approx(slow.log_ppl(t)) and got[i]._tokens == len(t.split())
    assert got[90]._log_ppl is None and got[91]._tokens == 0


def test_probabilities_add_up_to_one(docs_of, rng):
    texts = corpus(rng, 30)
    model = quality.fit(docs_of(list(enumerate(texts))))
    vocabulary = sorted({w for t in texts for w in t.split()})
    every = [quality.word_ids(w.encode())[2] for w in [*vocabulary, "unseen"]] + [np.uint64(quality.END)]
    for context in ([quality.START, quality.START], list(quality.word_ids(b"w1 w2")[2:4]), list(quality.word_ids(b"zz yy")[2:4])):
        total = sum(math.exp(model.log_probabilities(np.array([*context, w], np.uint64))[0]) for w in every)
        assert total == pytest.approx(1.0)


def test_table_finds_every_key():
    g = np.random.default_rng(1)
    keys = np.unique(g.integers(0, 2**64, 5000, dtype=np.uint64))
    keys = np.concatenate([keys, np.arange(1, 201, dtype=np.uint64)])  # a run that shares a home
    t = quality.Table(keys, np.arange(len(keys), dtype=float), -7.0)
    assert (t.find(keys)[0] == np.arange(len(keys))).all() and t.find(keys)[1].all()
    other = keys[:100] + np.uint64(10**9)
    assert (t.find(other)[0] == -7).all() and not t.find(other)[1].any()


def test_keeps_clean_and_rejects_noise(spark, docs_of, rng):
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 3 else "fr"
        w = words(rng, rng.randrange(20, 80), 40)
        if i % 10 == 0:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), lang))
        labels.append((i, int(i % 10 != 0), 0))
    rows += [(900, None, "en"), (901, "", None), (902, " ".join(words(rng, 40, 40)), None), (None, " ".join(words(rng, 40, 40)), "xx")]
    table = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs_of(rows).withColumn("keep", F.lit("old")).withColumn("threshold", F.lit(1)), table, least=10).collect()
    keep = {r.doc_id: r.keep for r in out}
    assert len(out) == len(rows) and keep[900] is False and keep[901] is False and keep[902] and keep[None]
    assert not any(keep[i] for i in range(0, 400, 10)) and all(keep[i] for i in range(400) if i % 10)
    assert len({r.threshold for r in out}) >= 2


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.assess(docs_of([(1, "a b"), (2, None)]), none).collect()}
    assert got == {1: True, 2: False}
    assert quality.assess(docs_of([]), none).count() == 0


def test_trains_on_thousands_of_texts_and_keeps_a_strict_threshold(spark, docs_of, rng, monkeypatch):
    rows = [(i, " ".join(words(rng, 6, 40))) for i in range(5300)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    sizes, cuts, shards, thresholds = [], [], quality.shards, quality.thresholds
    monkeypatch.setattr(quality, "shards", lambda t: sizes.append(t.count()) or shards(t))
    monkeypatch.setattr(quality, "thresholds", lambda t, *at: cuts.append(at) or thresholds(t, *at))
    quality.assess(docs_of(rows), labels)
    assert sizes == [4000] and cuts == [(quality.QUANTILE,)]


def test_joined_shards_give_the_same_and_the_threshold_is_the_quantile(spark, docs_of, rng):
    rows = [(i, " ".join(words(rng, rng.randrange(3, 40), 40)), "en" if i % 3 else "fr") for i in range(300)] + [(900, None, "en"), (901, " ", None), (902, "w1 " * 5000, "xx")]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows).withColumn("row", F.lit("mine")).withColumn("a", F.lit(1))
    sent = {r.doc_id: r for r in quality.assess(docs, labels, quantile=0.9).collect()}
    dealt = {r.doc_id: r for r in quality.assess(docs, labels, quantile=0.9, most=0).collect()}
    assert set(sent) == set(dealt) and {r.row for r in dealt.values()} == {"mine"}
    for i, r in sent.items():
        assert dealt[i].n_tokens == r.n_tokens and dealt[i].keep == r.keep
        if r.log_perplexity is None:
            assert dealt[i].log_perplexity is None
        else:
            assert dealt[i].log_perplexity == pytest.approx(r.log_perplexity, rel=1e-5)
    ids = spark.createDataFrame([(i,) for i in range(300) if i % 10], "i long").withColumn("fold", F.pmod(F.xxhash64("i"), F.lit(5))).collect()
    rest = [r.i for r in ids if not r.fold]
    for lang in ("en", "fr"):
        own = sorted(sent[i].log_perplexity for i in rest if sent[i].lang == lang)
        used = own if len(own) >= 30 else sorted(sent[i].log_perplexity for i in rest)
        at = next(v for k, v in enumerate(used, 1) if k >= 0.9 * len(used))
        cut = next(r.threshold for r in sent.values() if r.lang == lang)
        assert at <= cut + 1e-9 and cut - at <= 0.002 + 1e-9


def test_the_query_and_the_pipeline_learn_from_all_trusted_texts(spark, rng, tmp_path, monkeypatch):
    import corpus_pipeline
    from tallyloom.llm import queries

    docs = spark.createDataFrame([(i, " ".join(words(rng, 6, 40)), "en", "a", 0) for i in range(5300)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes, shards = [], quality.shards
    monkeypatch.setattr(quality, "shards", lambda t: sizes.append(t.count()) or shards(t))
    queries.op2_quality_classifier(spark, str(tmp_path))
    corpus_pipeline.quality_filter(spark, docs, str(tmp_path))
    all_of = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0).count()
    assert sizes == [all_of, all_of] and all_of > 4000


def _dealt(texts, new, learned, plan, docs_of):
    rows = list(enumerate([*texts, *new]))
    docs = docs_of(rows).select("text", F.unhex(F.md5("text")).alias("key"), (F.col("doc_id") < learned).alias("trains"))
    got = {bytes(r.key): r for r in dealt.log_sums(docs, docs.where("trains"), plan).collect()}
    return {t: got[hashlib.md5(t.encode()).digest()] for t in [*texts, *new]}


@pytest.mark.parametrize("hot", [False, True])
def test_dealt_n_grams_match_brute_force(docs_of, rng, monkeypatch, hot):
    monkeypatch.setattr(dealt, "LETTERS", 900)  # many blocks
    monkeypatch.setattr(dealt, "COMMON", 8)  # most words' shares come from their own shards
    texts = corpus(rng) + ["w1 w1 w1 w2 " * 40, "w3", ""]
    new = corpus(rng, 20) + ["never seen words", "w1 never w2", "w1 " * 3000, texts[0] + " w9"]
    ids = np.sort(np.array([0, *(quality.word_ids(f"w{k}".encode())[2] for k in range(1, 6))], np.uint64))
    plan = dealt.Plan(8, ids if hot else ids[:0], np.array([2, 3, 8, 2, 3, 4])[: len(ids) if hot else 0])
    got, slow = _dealt(texts, new, len(texts), plan, docs_of), SlowKneserNey(texts)
    for t, r in got.items():
        assert r.n == len(t.split())
        assert not r.n or -r.log / (r.n + 1) == pytest.approx(slow.log_ppl(t), rel=1e-6)


def test_a_large_model_is_never_in_one_place(spark, docs_of, rng, monkeypatch):
    texts = [" ".join(words(rng, 200, 3000)) for _ in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sent = {r.doc_id: r for r in quality.assess(docs_of(list(enumerate(texts))), labels).collect()}
    monkeypatch.setattr(quality, "gather", lambda t: pytest.fail("gathered"))
    got = quality.assess(docs_of(list(enumerate(texts))), labels, most=30_000).collect()
    assert all(r.log_perplexity == pytest.approx(sent[r.doc_id].log_perplexity, rel=1e-6) for r in got) and len(got) == 60


def test_common_words_are_dealt_to_several_shards(docs_of):
    frequent = dealt.frequency(docs_of([(i, "the " * 60 + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(50)]))
    plan = dealt.plan(5_050, 6 * dealt.BYTES, frequent)
    assert plan.shards == 8 and plan.hot.tolist() == [quality.word_ids(b"the")[2]] and plan.parts.tolist() == [5]
