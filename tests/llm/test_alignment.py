"""Token alignment against a slow version that encodes whole texts and compares all token pairs of a text."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import alignment

from .conftest import words

TRICKY = [
    "", None, " ", "  two  spaces ", "a", "tabs\tand\nlines\n\nhere", "<|endoftext|> is text, so are <s> and <unk> and <0x41>", "über straße naïve café", "日本語のテキスト 漢字 と space",
    "it's we're I'll 'd 12 345,67 x_y __ -- ... !? e.g. (a) [b] {c}", "a▁b is lost", "emoji 🙂🙃 family 👨‍👩‍👧 done", "end with space ", " ​zero width  no break　wide", "x" * 3000 + " " + "y z " * 50, "a ̀ combining", "CamelCase1word2 " * 30,
]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    table = alignment.byte_table(a.get_vocab(with_added_tokens=False))
    return a, b, table


def slow(encoders, rows):
    a, b, table = encoders
    found = []
    for doc_id, text in rows:
        ends, ids = ([], []), ([], [])
        want = f" {text}".encode() if text else b""
        if want:
            ids = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text))
            parts = [table[i] for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]
            if any(b"".join(p) != want for p in parts):
                ids = ([], [])
            else:
                ends = tuple([sum(map(len, p[: k + 1])) for k in range(len(p))] for p in parts)
        links = []
        for i, ea in enumerate(ends[0]):
            for j, eb in enumerate(ends[1]):
                if (ends[0][i - 1] if i else 0) < eb and (ends[1][j - 1] if j else 0) < ea:
                    links.append((ids[0][i], ids[1][j]))
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids[s], ends[s]) if low < e <= cut) for s in (0, 1)))
            low = cut
        found.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    count, best = Counter(p for f in found for p in set(f[4])), defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        (d, n_a, n_b, n_g, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, n_a, n_b, n_g, links, g in found
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_equals_whole_text_encoding(spark, docs_of, encoders, rng):
    rows = list(enumerate(TRICKY)) + [(100 + i, " ".join(words(rng, rng.randrange(1, 60), 300)) + rng.choice(["", ".", "\n", " (so)."])) for i in range(60)]
    rows += [(i + 200, rows[i][1]) for i in (3, 5, 9, 40)] + [(300, rows[20][1])] * 3  # repeated texts, ids and rows
    docs = docs_of(rows, partitions=7)
    want = slow(encoders, rows)
    assert rows_of(alignment.align(docs)) == want
    assert rows_of(alignment.align(docs, fan_in=2)) == want  # partial counts in three rounds


def test_real_texts(spark, small, encoders):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 3000").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(encoders, rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "same words"), (1, "same words"), (2, None)], "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(3,)], "doc_id long").withColumn("text", F.unhex(F.lit("61FF62")).cast("string")))
    docs = docs.withColumns({"block": F.lit("x"), "kind": F.lit(1), "n_a": F.lit(None).cast("int"), "cells": F.array(F.lit(1))})
    got = {r.doc_id: r for r in alignment.align(docs).collect()}
    assert set(got) == {None, 1, 2, 3} and got[None].n_a == got[1].n_a > 0 and got[1].count_sum == 2 * got[1].n_links
    assert got[3].n_links == 0 and got[3].groups_sha256 == "" and got[2].count_sum == 0
    assert alignment.align(docs.where("false")).collect() == []


def test_blocks_are_cut_by_size(monkeypatch, rng):
    rows = [(i, " ".join(words(rng, rng.randrange(5, 90), 50)).encode()) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    monkeypatch.setattr(alignment, "_BLOCK_BYTES", 300)
    blocks = list(alignment._blocks([batch, batch]))
    assert [r for b in blocks for r in b] == rows + rows
    assert all(len(b) == 1 or sum(len(t) for _, t in b) <= 300 for b in blocks) and max(map(len, blocks)) > 1
