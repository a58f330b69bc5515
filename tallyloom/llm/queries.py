"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, embeddings, language, lattice, licenses, lines, mixing, quality, simhash, substring, toxicity
from .common import fold, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), limit=None, with_text=False)
    return found.select("doc_id", "lang", "n_tokens", "log_perplexity", "threshold", "keep")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.line_dedup(table(spark, sf_dir, "documents"))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["lines"])), F.lit(0)).cast("long")
    return cut.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"), F.size("runs").cast("long").alias("n_runs"), longest.alias("longest_run"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.classify(docs, labels, fold("doc_id", 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, (place % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM p),
l AS (SELECT *, ((total - coalesce(sum(cap) OVER b, 0))::BIGINT / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT)::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (cap / weight, place)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT w.source, w.source_size, w.total::BIGINT AS budget,
             least(w.cap::DOUBLE, coalesce((SELECT level FROM f), 'infinity'::DOUBLE) * w.weight) AS target FROM w),
e AS (SELECT d.*, k.epoch, sha256(concat_ws('|', 'mix', k.epoch::VARCHAR, coalesce(d.doc_id::VARCHAR, ''), d.size::VARCHAR)) AS h
      FROM d, (VALUES (1), (2), (3)) k(epoch)),
q AS (SELECT e.*, t.source_size, t.target, t.budget,
             CASE WHEN t.target > 0 THEN sum(size) OVER (PARTITION BY e.source ORDER BY epoch, h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT / t.target ELSE 0.0 END AS finish,
             CASE WHEN t.target > 0 THEN (sum(size) OVER (PARTITION BY e.source ORDER BY epoch, h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size) / t.target ELSE 0.0 END AS begins
      FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, sum(CASE WHEN begins + finish <= 2 THEN size ELSE 0 END) OVER (ORDER BY finish, epoch, h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS served FROM q)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(CASE WHEN 2 * served - size <= 2 * budget AND begins + finish <= 2 THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id, source, size
"""

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_license_scan": op12_license_scan,
}
OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS ord FROM d),
s AS (SELECT ord, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM o),
t AS (SELECT ord, pos, regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS line FROM s),
l AS (SELECT ord, pos, line, row_number() OVER (PARTITION BY ord ORDER BY pos) - 1 AS place, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 8 AS long FROM t WHERE line <> ''),
p AS (SELECT b.ord, b.place, b.long, a.ord AS a_ord, a.place - b.place AS diagonal FROM l a JOIN l b ON a.line = b.line AND (a.ord < b.ord OR (a.ord = b.ord AND a.place < b.place))),
g AS (SELECT *, place - row_number() OVER (PARTITION BY ord, a_ord, diagonal ORDER BY place) AS island FROM p),
m AS (SELECT ord, place, any_value(long) AS long, max(n) AS lines
      FROM (SELECT ord, place, long, max(place) OVER (PARTITION BY ord, a_ord, diagonal, island) - place + 1 AS n FROM g) GROUP BY ord, place),
r AS (SELECT ord, place, lines FROM m WHERE lines >= 2 OR long),
x AS (SELECT *, max(place + lines) OVER (PARTITION BY ord ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
runs AS (SELECT ord, place, lines FROM x WHERE reach IS NULL OR place + lines > reach),
gone AS (SELECT DISTINCT l.ord, l.pos FROM runs JOIN l ON l.ord = runs.ord AND l.place >= runs.place AND l.place < runs.place + runs.lines),
kept AS (SELECT s.ord, string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (gone.pos IS NULL) AS body, count(gone.pos) AS n_deleted
         FROM s LEFT JOIN gone ON s.ord = gone.ord AND s.pos = gone.pos GROUP BY s.ord),
n AS (SELECT ord, count(*) AS n FROM l GROUP BY ord), c AS (SELECT ord, count(*) AS n_runs, max(lines) AS longest FROM runs GROUP BY ord)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(kept.n_deleted, 0)::BIGINT AS n_deleted,
       CASE WHEN documents.text IS NULL THEN NULL ELSE sha256(coalesce(kept.body, '')) END AS kept_sha256,
       coalesce(c.n_runs, 0)::BIGINT AS n_runs, coalesce(c.longest, 0)::BIGINT AS longest_run
FROM documents LEFT JOIN o ON documents.doc_id IS NOT DISTINCT FROM o.doc_id AND documents.text = o.text
LEFT JOIN kept ON kept.ord = o.ord LEFT JOIN n ON n.ord = o.ord LEFT JOIN c ON c.ord = o.ord
"""

OP5_SQL = r"""
WITH iw AS (SELECT DISTINCT item_id, text AS item, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ik AS (SELECT *, least(5, len(w)) AS k FROM iw WHERE len(w) >= 1),
dw AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, item, k, len(w) - k + 1 AS total, unnest(list_transform(range(1, len(w) - k + 2), lambda n: array_to_string(w[n:n + k - 1], ' '))) AS h FROM ik),
ic AS (SELECT item_id, item, k, any_value(total) AS total, h, count(*) AS item_times FROM i GROUP BY item_id, item, k, h),
d AS (SELECT doc_id, text, k, len(w) - k + 1 AS n, unnest(range(0, len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda n: array_to_string(w[n:n + k - 1], ' '))) AS h
      FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k),
hit AS (SELECT d.doc_id, d.text, d.n, d.pos, d.h, ic.item_id, ic.item, ic.total, ic.item_times FROM d JOIN ic USING (k, h)),
s AS (SELECT DISTINCT doc_id, text, item_id, item, total, n, greatest(0, least(pos, n - total)) AS start FROM hit),
c AS (SELECT s.doc_id, s.text, s.item_id, s.item, s.total, s.start, least(s.total, s.n) AS own, hit.h, least(count(*), any_value(hit.item_times)) AS common
      FROM s JOIN hit ON s.doc_id IS NOT DISTINCT FROM hit.doc_id AND s.text = hit.text AND s.item_id IS NOT DISTINCT FROM hit.item_id AND s.item = hit.item AND hit.pos >= s.start AND hit.pos < s.start + s.total
      GROUP BY ALL),
e AS (SELECT doc_id, text, item_id, item, start, sum(common)::DOUBLE / (any_value(own) + any_value(total) - sum(common)) AS similarity FROM c GROUP BY doc_id, text, item_id, item, start)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, arg_min(start, (-similarity, start))::INTEGER AS start
FROM e WHERE similarity >= 0.8 GROUP BY doc_id, text, item_id
"""

OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM e
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.TEMPLATES))}) v(id, label, text)),
tw AS (SELECT id, label, unnest(list_distinct(string_split(text, ' '))) AS word FROM t), tm AS (SELECT id, count(*) AS m FROM tw GROUP BY id),
b AS (SELECT r, w, unnest(range(0, greatest(ceil(len(w) / {licenses.BLOCK // 2}.0)::BIGINT - 2, 0) + 1)) AS b FROM d),
bw AS (SELECT DISTINCT r, b, unnest(w[b * {licenses.BLOCK // 2} + 1:b * {licenses.BLOCK // 2} + {licenses.BLOCK}]) AS word FROM b),
s AS (SELECT r, b, id, label, count(*) AS n FROM bw JOIN tw USING (word) GROUP BY r, b, id, label),
met AS (SELECT r, label, n::DOUBLE / m AS containment FROM s JOIN tm USING (id) WHERE n >= ceil({licenses.CONTAINMENT} * m - 1e-9)),
p AS (SELECT * FROM (VALUES {", ".join(f"({p.split()}, {len(p.split())}, '{label}')" for p, label in licenses.PHRASES)}) v(phrase, k, label)),
hit AS (SELECT r, label, unnest(list_filter(range(0, len(w) - k + 1), lambda i: w[i + 1:i + k] = phrase)) AS place FROM d, p),
h AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM met UNION ALL SELECT r, label FROM hit) GROUP BY r), c AS (SELECT r, max(containment) AS best FROM met GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_base, h.first_word::BIGINT AS first_word, h.last_word::BIGINT AS last_word, coalesce(h.labels, '') AS base_labels,
       coalesce(a.labels, '') AS labels, CASE WHEN h.n > 0 THEN 1.0 ELSE coalesce(c.best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN h USING (r) LEFT JOIN a USING (r) LEFT JOIN c USING (r)
"""

ORACLE_SQL = {"op12_license_scan": OP12_SQL, "op5_benchmark_decontamination": OP5_SQL, "op3_line_dedup": OP3_SQL, "op8_embedding_near_dedup": OP8_SQL, "op9_source_mixing": OP9_SQL}
