"""License scan against a slow version that compares every block with every template, and against its SQL."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import licenses, queries

from .conftest import words


def slow(rows, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, containment=licenses.CONTAINMENT, block=licenses.BLOCK):
    out = []
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, base, labels, best, half = [], set(), set(), 0.0, block // 2
        for phrase, label in phrases:
            p = phrase.split()
            at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        for start in range(0, max(math.ceil(len(ws) / half) - 2, 0) * half + 1, half):
            own = set(ws[start : start + block])
            for label, t in templates:
                want = set(t.split())
                if len(own & want) >= math.ceil(containment * len(want) - 1e-9):
                    labels.add(label)
                    best = max(best, len(own & want) / len(want))
        out.append((doc_id, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=str)


def test_equals_all_blocks_against_all_templates(docs_of, rng):
    notices = [t for _, t in licenses.TEMPLATES] + [p for p, _ in licenses.PHRASES]
    vocabulary = sorted({w for t in notices for w in t.split()})
    rows = [(1, None), (2, ""), (3, "... --"), (4, "UNDER THE MIT-License"), (5, "under the mit license " * 3), (6, "apache license version 2.0, CC BY-NC"), (7, "Größe ÄÖ mit license"), (8, "Kelvin licensed under the Apache License, Version 2.0"), (None, "cc by nc"), (4, "UNDER THE MIT-License")]
    for i in range(150):
        ws = words(rng, rng.randrange(0, 150), 60)
        for _ in range(rng.randrange(3)):
            notice = rng.choice(notices).split()
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = [w.title() for w in notice]
        rows.append((10 + i, " ".join(ws + rng.choices(vocabulary, k=rng.randrange(20)))))
    docs = docs_of(rows, partitions=5)
    assert rows_of(licenses.scan(docs)) == slow(rows)
    assert rows_of(licenses.scan(docs, containment=0.6, block=70)) == slow(rows, containment=0.6, block=70)
    own = [("x", "w1 w2 w3 w1"), ("y", "w4 w5")]
    assert rows_of(licenses.scan(docs, own, [("w1 w1", "z")], containment=0.5, block=8)) == slow(rows, own, [("w1 w1", "z")], 0.5, 8)


def test_blocks_say_where(docs_of):
    text = "a " * 100 + licenses.TEMPLATES[0][1].upper() + " b" * 100
    row = licenses.scan(docs_of([(1, text)])).first()
    assert row.labels == "mit" and row.base_labels == "" and row.n_base == 0 and row.score == 1.0
    assert {b.label for b in row.blocks} == {"mit"} and all(b.start <= 100 and b.start + licenses.BLOCK >= 120 for b in row.blocks)


def test_clean_texts_stay_clean(docs_of):
    german = "das buch mit der karte und mit dem license wort version 2 the under public general"
    assert [r.labels for r in licenses.scan(docs_of([(1, german), (2, "a license to use this software for any purpose")])).collect()] == ["", ""]


def test_odd_tables(docs_of):
    docs = docs_of([(1, "under the mit license")]).withColumns({"words": F.lit(1), "row": F.lit("x"), "blocks": F.lit(None).cast("string"), "W": F.lit(2)})
    assert licenses.scan(docs).first().labels == "mit"
    assert licenses.scan(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(docs, [("long", "w " * 40)])


def test_long_text_and_repeats(docs_of):
    row = licenses.scan(docs_of([(1, "licensed under cc by nc 4.0 " * 20_000)])).first()
    assert row.n_words == 140_000 and row.n_base == 20_000 and row.last_word == 139_995 and row.labels == "cc-by-nc"


def test_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_license_scan"])
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = [tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()]
    assert sorted(rows, key=str) == rows_of(queries.op12_license_scan(spark, small)) and any(r[6] for r in rows)
