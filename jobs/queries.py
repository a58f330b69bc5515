"""The jobs as registered queries: each runs twice into one new folder, and gives what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.guards import PATTERNS
from tallyloom.operators.rounds import shared_folder

from . import incremental_counts, region_extract


def job1_incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site counts of all calls. The second run finds no new file."""
    at, given = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}", sf_dir.rstrip("/")
    config = {"calls": f"{given}/lineitem.parquet", "orders": f"{given}/orders.parquet", "customers": f"{given}/customer.parquet", "output": f"{at}/out", "checkpoint": f"{at}/checkpoint"}
    incremental_counts.run(spark, config)
    return incremental_counts.run(spark, config)


def job2_region_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near the motif's sites, of all texts that the labels call good. The second run finds no sample changed."""
    at, given = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}", sf_dir.rstrip("/")
    config = {"documents": f"{given}/documents.parquet", "needed": f"{given}/labels.parquet", "output": f"{at}/out"}
    region_extract.run(spark, config)
    return region_extract.run(spark, config)


QUERIES = {"job1_incremental_counts": job1_incremental_counts, "job2_region_extract": job2_region_extract}

_PRIVATE = " OR ".join(f"regexp_matches(text, '{p}')" for p in PATTERNS.values())

ORACLE_SQL = {
    "job1_incremental_counts": f"""
WITH s AS (SELECT o_orderkey AS l_orderkey, c_nationkey AS sample FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT l.*, s.sample FROM lineitem l JOIN s USING (l_orderkey) WHERE sample IS NOT NULL AND l_linenumber IS NOT NULL AND l_suppkey IS NOT NULL AND l_returnflag IN ('N', 'A', 'R') AND l_quantity >= {incremental_counts.DEFAULTS['least_quality']}),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(incremental_counts.ORDER)}) = 1)
SELECT sample, l_suppkey AS site, count(*) FILTER (l_returnflag = 'N')::BIGINT AS c, count(*) FILTER (l_returnflag = 'A')::BIGINT AS m, count(*) FILTER (l_returnflag = 'R')::BIGINT AS h FROM f GROUP BY 1, 2
""",
    "job2_region_extract": f"""
WITH d AS (SELECT source AS sample, doc_id, coalesce(text, '') AS text, upper(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '.', 'g')) AS plain FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
p AS (SELECT doc_id, length(text) AS n, unnest(list_filter(range(0, length(plain)), lambda i: plain[i + 1:i + 2] = 'GH')) AS pos FROM d),
w AS (SELECT doc_id, greatest(pos - 30, 0) AS s, least(pos + 2 + 30, n) AS e FROM p),
o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o),
t AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, grp),
c AS (SELECT sample, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
l AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM c),
m AS (SELECT sample, l.doc_id, line, l.s AS "start", l.s + length(text) AS "end", text, count(*)::BIGINT AS n_targets, sum(least(l.s + length(text), t.e) - greatest(l.s, t.s))::BIGINT AS covered
      FROM l JOIN t ON l.doc_id = t.doc_id AND l.s < t.e AND l.s + length(text) > t.s WHERE text <> '' GROUP BY ALL)
SELECT sample, doc_id, line::BIGINT AS line, "start", "end", n_targets, covered, length(regexp_replace(upper(text), '[^GC]', '', 'g'))::DOUBLE / length(text) AS gc, text FROM m WHERE NOT ({_PRIVATE})
""",
}
