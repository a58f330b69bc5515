import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language, queries
from tallyloom.llm.common import spread


def small(h=3, langs=("a", "b", "c"), seed=1):
    r = np.random.default_rng(seed)
    return language.Model(list(langs), r.normal(size=(2, 257, 3 * h)), r.normal(size=(2, h, 3 * h)), r.normal(size=(2, h, len(langs))), r.normal(size=len(langs)))


def slow_sums(model, text, length=language.SEGMENT):
    """Byte by byte, one segment at a time."""
    total, h = np.zeros(len(model.languages)), model.hidden
    for at in range(0, len(text), length):
        part = list(text[at : at + length])
        part += [language.PAD] * (length - len(part))
        states = []
        for d, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
            s, out = np.zeros(h), {}
            for t in order:
                x = model.inputs[d][part[t]]
                g = np.clip(0.25 * (x[: 2 * h] + s @ model.state[d][:, : 2 * h]) + 0.5, 0, 1)
                c = x[2 * h :] + (s * g[h:]) @ model.state[d][:, 2 * h :]
                s = s + g[:h] * (c / (1 + abs(c)) - s)
                out[t] = s
            states.append(out)
        for t in range(length):
            if part[t] != language.PAD:
                z = states[0][t] @ model.output[0] + states[1][t] @ model.output[1] + model.bias
                e = np.exp(z - z.max())
                total += e / e.sum()
    return total


def test_sums_match_byte_by_byte():
    texts = [b"", b"x", bytes(range(200)), "é ñ ü".encode() * 40, b"a" * 64, b"a" * 65]
    for rows in (2, 4096):
        got = language.position_sums(small(), texts, rows)
        assert got == pytest.approx(np.array([slow_sums(small(), t) for t in texts]), abs=2e-3)
    assert got.sum(1) == pytest.approx([len(t) for t in texts], abs=1e-2)


def test_gradient_through_time_matches_differences():
    model = small()
    block, _ = language.segments([b"hello world", b"abc" * 9, b"zz"], 12)
    labels = np.array([0, 1, 1, 1, 2])[: len(block)]
    block = block.astype(np.int64)
    _, g = language.loss_and_gradient(model, block, labels)
    r = np.random.default_rng(2)
    for name in ("inputs", "state", "output", "bias"):
        p, d = getattr(model, name), getattr(g, name)
        places = np.argwhere(np.abs(d) > 1e-6)
        for i in map(tuple, places[r.choice(len(places), min(12, len(places)), replace=False)]):
            old = p[i]
            p[i] = old + 1e-5
            up, _ = language.loss_and_gradient(model, block, labels)
            p[i] = old - 1e-5
            down, _ = language.loss_and_gradient(model, block, labels)
            p[i] = old
            assert d[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def trained(spark, docs_of):
    import random

    rng = random.Random(3)
    parts = {"en": ["th", "er", "on", "an", "re"], "fr": ["é", "eau", "ou", "è", "ment"], "de": ["sch", "ü", "ung", "ß", "ei"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))), lang))
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return rows, learn, language.train(docs_of(rows), learn, steps=200)


def test_held_out_accuracy(spark, docs_of, trained):
    rows, learn, model = trained
    got = {r.doc_id: r for r in language.predict(docs_of(rows), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_lang_of_held_out_rows_is_not_used(docs_of, trained):
    rows, learn, model = trained
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    again = language.train(docs_of(other), learn, steps=200)
    assert again.languages == model.languages and np.array_equal(again.inputs, model.inputs)


def test_nulls_letters_long_texts_and_blocks(docs_of, trained):
    rows, learn, model = trained
    odd = [(1, None), (2, ""), (3, " 12 .,! 😀"), (4, "th er on " * 30000), (None, "é eau ou"), (5, "x"), (5, "x")]
    df = docs_of(odd).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("z"))
    got = sorted(map(tuple, language.predict(df, model).collect()), key=str)
    assert [r[:2] for r in got if r[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert dict((r[0], r[1]) for r in got)[4] == "en" and len(got) == 7
    small_blocks = sorted(map(tuple, language.predict(df, model, block=50).collect()), key=str)
    assert [r[:2] for r in small_blocks] == [r[:2] for r in got]


def test_nothing_to_learn(docs_of):
    model = language.train(docs_of([(1, "abc", None), (2, None, "en")]), F.lit(True))
    assert [(r.lang_pred, r.score) for r in language.predict(docs_of([(1, "abc")]), model).collect()] == [("und", 0.0)]
    one = language.train(docs_of([(1, "abc", "en")]), F.lit(True))
    assert [r.lang_pred for r in language.predict(docs_of([(1, "abc")]), one).collect()] == ["en"]
    assert language.predict(docs_of([]), one).count() == 0


def test_long_texts_teach(spark, docs_of, rng):
    """A language whose texts are all longer than the sample of a text is learned from pieces of all of it."""
    few = ["".join(rng.choice("abcde ") for _ in range(4000)) for _ in range(4)]
    late = ["0 " * 140_000 + "".join(rng.choice("vwxyz ") for _ in range(160_000)) for _ in range(2)]  # letters only far into the text
    docs = docs_of([(i, t, "aa") for i, t in enumerate(few)] + [(10 + i, t, "zz") for i, t in enumerate(late)])
    model = language.train(docs, F.lit(True), steps=60, rows=32)
    assert model.languages == ["aa", "zz"]
    got = {r.doc_id: r.lang_pred for r in language.predict(docs_of([(1, "abc dea cab " * 20), (2, "xyz wvz zyx " * 20)]), model).collect()}
    assert got == {1: "aa", 2: "zz"}


def test_pieces_cover_the_text(spark):
    text = "".join(chr(0x4E00 + i) for i in range(20_000))
    d = spark.createDataFrame([(text,), ("short",), (None,)], "t string")
    got = [r[0] for r in d.select(spread(F.col("t"), 5000, 1000)).collect()]
    assert got[1:] == ["short", None]
    assert [p == text[a : a + 1000] for p, a in zip(got[0].split(" "), (0, 4750, 9500, 14250, 19000))] == [True] * 5


def test_query_matches_a_slow_version(spark, docs_of, rng, tmp_path):
    """lang_pred, score and held_out of the registered query, each byte's distribution by the scalar recurrence."""
    alphabet = {"aa": "abcdefgh ", "bb": "mnopqrst ", "cc": "äöüvwxyz "}
    rows = [(i, "".join(rng.choice(alphabet[k]) for _ in range(rng.randrange(20, 150))), k) for i, k in enumerate(rng.choices(list(alphabet), k=40))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 .. 7", "cc"), (None, "abc abc", "aa"), (103, "abcd mnop", None), (0, rows[1][1], "bb")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language.train(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2)
    assert model.languages == ["aa", "bb", "cc"]
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in queries.op6_language_id(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text, _ in rows:
        sums = slow_sums(model, text.encode()) if text and any(c.isalpha() for c in text) else None
        want.append((i, fold(i) == 2, "und" if sums is None else model.languages[int(sums.argmax())], 0.0 if sums is None else sums.max() / len(text.encode())))
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want, key=str)]
    left = sorted(want, key=str)
    for g, w in zip(got, left):
        assert g[2] == w[2] and g[3] == pytest.approx(w[3], abs=2e-3), (g, w)
