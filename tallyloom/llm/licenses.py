"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates.

A text's words lie in blocks of ``BLOCK`` words, one at every half block, so any
run of at most ``BLOCK / 2 + 1`` words is inside one of them. A block carries a
template's label if it holds at least ``CONTAINMENT`` of the template's distinct
words. The join finds all such pairs and no other:

* Template words are ordered by how often they occur in all texts, rarest first.
* Prefix: a template of m words that needs c of them shares one of its m - c + 1
  rarest words with every block that has c. Only blocks around such a word are
  looked at, and they are cut out of the text's word array where it lies, so no
  word of a text is exchanged. Of a block's own words in that order, the first
  size - c + 1 have to hold the shared word too.
* Length: a block with less than c template words is out.
* Position: with the shared word at place i of the template and j of the block,
  at most 1 + min(m - 1 - i, size - 1 - j) words are shared; less than c is out.

What is left is decided by the intersection itself. Everything is DataFrame
functions. The templates are a parameter, so their word order and the index of
their prefixes have a bounded size; the index is the broadcast side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

BLOCK = 64
CONTAINMENT = 0.9
#: Phrases that name a license wherever their words stand consecutively.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Words of public license texts and notices. Templates of less than ten words need all of them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case and no other letter changed; none for a null text."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.array_remove(F.split(F.when(plain, F.lower(t)).otherwise(F.translate(t, _UPPER, _UPPER.lower())), _BREAK), "")


def _starts(words: Column, phrase: Sequence[str]) -> Column:
    """Places, from 0, where the words of ``phrase`` stand consecutively."""
    there = F.size(words) >= len(phrase)
    for w in dict.fromkeys(phrase):
        there = there & F.array_contains(words, w)
    here = lambda i: math_all([F.get(words, i + k) == w for k, w in enumerate(phrase)])
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here)
    return F.when(there, found).otherwise(F.array().cast("array<int>"))


def math_all(conditions: Sequence[Column]) -> Column:
    both = conditions[0]
    for c in conditions[1:]:
        both = both & c
    return both


def needed(size: int, containment: float) -> int:
    """Least number of shared words, at least one."""
    return max(1, math.ceil(containment * size - 1e-9))


def word_order(words: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The template words, rarest in all texts first; one count a template word comes to the driver."""
    seen = words.select(F.explode("words").alias("w")).where(F.col("w").isin(*vocabulary)).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _index(templates: Sequence[tuple[str, str]], rank: dict[str, int], containment: float) -> list[tuple]:
    """(word's rank, its place in the template, label, template size, least shared, all ranks) of each prefix word."""
    rows = []
    for label, text in templates:
        own = sorted({rank[w] for w in text.split()})
        c = needed(len(own), containment)
        rows += [(r, i, label, len(own), c, own) for i, r in enumerate(own[: len(own) - c + 1])]
    return rows


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``blocks`` lists (start word, label, containment) of every block that meets
    the threshold, in order. score is 1 with a phrase, else the highest
    containment found, else 0. A null or empty text has no words, null places,
    no labels and score 0. Rows count on their own, so ids may be null or
    repeated; other columns are not looked at. An empty table gives an empty result.
    """
    half = block // 2
    split = [(label, t.split()) for label, t in templates]
    if any(len(w) > half + 1 or not w for _, w in split):
        raise ValueError(f"a template has no word, or more than {half + 1}: blocks of {block} words could cut it")
    vocabulary = sorted({w for _, ws in split for w in ws})
    source = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    order = word_order(source, vocabulary)
    index = _index([(label, " ".join(ws)) for label, ws in split], {w: i + 1 for i, w in enumerate(order)}, containment)
    rare = [order[r - 1] for r in sorted({row[0] for row in index})]
    last = F.greatest(F.ceil(F.size("words") / half).cast("int") - 2, F.lit(0))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*rare), i)), lambda i: i.isNotNull())
    at = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(F.least(F.floor(i / half).cast("int"), last), F.greatest(F.floor(i / half).cast("int") - 1, F.lit(0))))))
    ranked = F.array(*map(F.lit, order))
    ranks = lambda b: F.array_sort(F.transform(F.filter(F.array_distinct(F.slice("words", b * half + 1, F.lit(block))), lambda w: w.isin(*vocabulary)), lambda w: F.array_position(ranked, w).cast("int")))
    base = [(_starts(F.col("words"), p.split()), label) for p, label in phrases]
    places = F.concat(*[s for s, _ in base]) if base else F.array().cast("array<int>")
    found = F.filter(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, label in base]), lambda x: x.isNotNull()) if base else F.array().cast("array<string>")
    facts = source.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"),
        F.array_sort(F.array_distinct(found)).alias("base"), F.transform(at, lambda b: F.struct(b.alias("b"), ranks(b).alias("ranks"))).alias("near"),
    )
    facts = keep(facts)  # row numbers hold from here on
    size = F.size("x.ranks")
    blocks = facts.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", (F.col("x.b") * half).cast("long").alias("start"), F.col("x.ranks").alias("ranks"), size.alias("size"))
    least = min((row[4] for row in index), default=1)
    prefixes = blocks.where(F.col("size") >= least).select("*", F.posexplode(F.slice("ranks", F.lit(1), F.col("size") - least + 1)).alias("j", "rank"))
    kinds = "array<struct<rank int, i int, label string, m int, c int, t array<int>>>"
    table = docs.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(m).alias("m"), F.lit(c).alias("c"), F.array(*map(F.lit, t)).alias("t")) for r, i, label, m, c, t in index]) if index else F.array().cast(kinds)).alias("y")).select("y.*")
    met = prefixes.join(F.broadcast(table), "rank")
    met = met.where((F.col("size") >= F.col("c")) & (F.col("j") <= F.col("size") - F.col("c")) & (1 + F.least(F.col("m") - 1 - F.col("i"), F.col("size") - 1 - F.col("j")) >= F.col("c")))
    shared = F.size(F.array_intersect("ranks", "t"))
    pairs = met.where(shared >= F.col("c")).select("row", F.struct("start", "label", (shared / F.col("m")).alias("containment")).alias("block")).distinct()
    per_row = pairs.groupBy("row").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    all_of = facts.join(per_row, "row", "left")
    blocks = F.coalesce("blocks", F.array().cast("array<struct<start long, label string, containment double>>"))
    return all_of.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.transform(blocks, lambda b: b["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(blocks, lambda b: b["containment"])), F.lit(0.0))).alias("score"), blocks.alias("blocks"),
    )
