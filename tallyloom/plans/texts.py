"""Plans over text and semi-structured sources, projections of reads, guards and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counting, guards, rollups
from ..sources import readers
from .registry import plan, rounded, table


@plan("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rounded(e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@plan("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, length(html)::INTEGER AS n_chars FROM pages""")
def html_targets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n_chars"))


@plan("""WITH l AS (SELECT conv_id AS sample, role AS key, string_agg(length(text)::VARCHAR, ' | ' ORDER BY turn) AS value FROM conversations GROUP BY 1, 2)
SELECT sample, max(value) FILTER (key = 'user') AS "user", max(value) FILTER (key = 'assistant') AS assistant FROM l WHERE key IN ('user', 'assistant') GROUP BY sample""")
def metadata_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("string").alias("v")))), lambda x: x["v"])
    long = c.groupBy(F.col("conv_id").alias("sample"), F.col("role").alias("key")).agg(F.array_join(parts, " | ").alias("value"))
    return readers.metadata_table(long, ["user", "assistant"])


@plan(f"""SELECT doc_id, {', '.join(f"coalesce(regexp_matches(text, '{p}'), false) AS has_{k}" for k, p in guards.PATTERNS.items())} FROM documents""")
def schema_and_pii_guards(spark, sf_dir):
    d = readers.check_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])
    return guards.flag_text(d.select("doc_id", "text"), "text").drop("text")


@plan("""SELECT 'unique id' AS rule, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))::BIGINT AS n
UNION ALL SELECT 'length', count(*) FILTER (NOT coalesce(n_chars = length(text), false))::BIGINT FROM documents UNION ALL SELECT 'language', count(*) FILTER (NOT coalesce(lang IN ('en', 'fr', 'de', 'es'), false))::BIGINT FROM documents""")
def value_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = guards.broken(d, {"length": F.col("n_chars") == F.length("text"), "language": F.col("lang").isin("en", "fr", "de", "es")})
    unique = guards.repeated_keys(d, ["doc_id"]).agg(F.lit("unique id").alias("rule"), F.count("*").alias("n"))
    return unique.unionByName(rules)


@plan("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def set_differences(spark, sf_dir):
    return guards.set_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@plan("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def validated_merge(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return rollups.validated_join(d.select("doc_id", "source"), l, ["doc_id"], "one_to_one").select("doc_id", "source", "quality", "toxic")


@plan("""SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def optional_lookup(spark, sf_dir):
    return rollups.validated_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], "many_to_one", "left").na.fill(-1, ["quality"])


@plan("""SELECT lang, source, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS texts FROM documents GROUP BY 1, 2""")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@plan("""WITH s AS (SELECT doc_id, upper(text) AS seq FROM documents) SELECT doc_id, CASE WHEN length(seq) > 0 THEN round(length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq), 6) END AS gc FROM s""")
def composition_fraction(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", scalars.fraction_of("text").alias("gc")))


@plan("""WITH w AS (SELECT doc_id, unnest(range(0, (greatest(coalesce(length(text), 0), 1) - 1) // 400 + 1)) AS win, text FROM documents),
s AS (SELECT doc_id, win, upper(substr(text, win * 400 + 1, 400)) AS seq FROM w)
SELECT doc_id, win::BIGINT AS win, CASE WHEN length(seq) > 0 THEN round(length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq), 6) END AS gc FROM s""")
def composition_windows(spark, sf_dir):
    """Consecutive windows of 400 characters that cover all of a text; the last one may be shorter."""
    last = F.floor((F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)) - 1) / 400)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("win"))
    d = d.select("doc_id", "win", F.col("text").substr((F.col("win") * 400 + 1).cast("int"), F.lit(400)).alias("seq"))
    return rounded(d.select("doc_id", "win", scalars.fraction_of("seq").alias("gc")))


@plan("""WITH p AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM documents), s AS (SELECT doc_id, unnest(range(1, length(t))) AS i, t FROM p) SELECT doc_id, i - 1 AS pos FROM s WHERE substr(t, i::INTEGER, 2) = 'TH'""")
def reference_sites(spark, sf_dir):
    letters = F.regexp_replace("text", "[^A-Za-z]", "").alias("text")
    return readers.sites_of(table(spark, sf_dir, "documents").select("doc_id", letters), "doc_id", "text", "TH")


@plan("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax AS pm, l_discount * 9 AS ph FROM lineitem),
s AS (SELECT *, greatest(0.0, 1.0 - pm - ph) AS rest FROM c), b AS (SELECT *, greatest(rest, pm, ph) AS best FROM s)
SELECT CASE WHEN best < 0.6 THEN -1 WHEN rest >= best THEN 0 WHEN pm >= best THEN 1 ELSE 2 END AS state, count(*)::BIGINT AS n FROM b GROUP BY 1""")
def threshold_calls(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("pm"), (F.col("l_discount") * 9).alias("ph"))
    return c.select(F.coalesce(scalars.call_state("pm", "ph", 0.6), F.lit(-1)).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@plan("""WITH p AS (SELECT p_brand, p_partkey, p_size AS d, p_retailprice AS v FROM part), m AS (SELECT p_brand, avg(CASE WHEN d <= 30 THEN v END) AS v, count(*) FILTER (d <= 30) AS n FROM p GROUP BY 1)
SELECT p_brand, round(v, 4) AS v, n::BIGINT AS n, CASE WHEN n < 40 THEN 'LOW' WHEN v >= 1000 THEN 'HIGH' WHEN v < 900 THEN 'SMALL' ELSE 'MIDDLE' END AS label FROM m""")
def masked_labels(spark, sf_dir):
    """Value mask by a second column, then an ordered label ladder over per-key aggregates."""
    p = table(spark, sf_dir, "part").withColumn("v", F.when(F.col("p_size") <= 30, F.col("p_retailprice")))
    m = p.groupBy("p_brand").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    label = F.when(F.col("n") < 40, "LOW").when(F.col("v") >= 1000, "HIGH").when(F.col("v") < 900, "SMALL").otherwise("MIDDLE")
    return rounded(m.withColumn("label", label), digits=4)


@plan("""WITH r AS (SELECT l_orderkey AS name, l_linenumber AS ln, l_partkey % 50 AS start FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)
SELECT name, 0 AS query_start, start AS ref_start, 20 AS length FROM r UNION ALL SELECT name, 25, start + 20, 10 FROM r UNION ALL SELECT name, 35, start + 33, 15 FROM r""")
def cigar_projection(spark, sf_dir):
    """Reads 20M5I10M3D15M at their starts: blocks in read and reference coordinates."""
    r = counting.first_occurrence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    ops = F.array(*(F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in (("M", 20), ("I", 5), ("M", 10), ("D", 3), ("M", 15))))
    r = r.select(F.col("l_orderkey").alias("name"), (F.col("l_partkey") % 50).alias("start"), ops.alias("cigar"))
    b = counting.cigar_blocks(r, ["name"], "cigar", "start")
    return b.select("name", F.col("query_start").cast("int").alias("query_start"), "ref_start", "length")


@plan("""WITH x AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, value FROM x WHERE k = 1 UNION ALL SELECT user_id, 'all', round(sum(value), 4) FROM events GROUP BY user_id""")
def first_and_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    first = counting.first_occurrence(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")
    total = e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("value")).select("user_id", F.lit("all").alias("event_type"), "value")
    return first.unionByName(total)


@plan("""WITH a AS (SELECT c_nationkey AS nation, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT c_nationkey AS nation, count(*)::BIGINT AS n FROM customer JOIN a ON c_nationkey = nation WHERE c_acctbal BETWEEN lo AND hi AND c_mktsegment <> 'BUILDING' GROUP BY 1""")
def bounded_restriction(spark, sf_dir):
    """Rows of one cohort restricted to another cohort's range."""
    c = table(spark, sf_dir, "customer")
    bounds = c.where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    j = c.where("c_mktsegment <> 'BUILDING'").join(bounds, "c_nationkey").where(F.col("c_acctbal").between(F.col("lo"), F.col("hi")))
    return j.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@plan("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def needed_set_semi_anti(spark, sf_dir):
    need = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    out = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(need, "c_nationkey", "left_semi").join(out, "c_custkey", "left_anti").select("c_custkey")


@plan("""WITH s AS (SELECT o_custkey % 20 AS fold, o_orderpriority AS locus FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT locus, count(DISTINCT fold)::BIGINT AS folds, round(count(DISTINCT fold) / 20.0, 6) AS frequency FROM s GROUP BY 1""")
def selection_frequency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy((F.col("o_custkey") % 20).alias("fold"), F.col("o_orderpriority").alias("locus")).count().where("count >= 2")
    return rounded(o.groupBy("locus").agg(F.countDistinct("fold").alias("folds")).withColumn("frequency", F.col("folds") / 20.0))
