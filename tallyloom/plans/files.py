"""Plans over the library's own writers and readers: tables go out to a new folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..sources import readers
from .registry import plan, table


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@plan("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal, 2) END AS c_acctbal, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END AS code FROM customer""")
def tsv_round_trip(spark, sf_dir):
    """Missing values of text and numbers, ten digits, types on the way back; a column that mostly isn't a number becomes null there."""
    path = _folder(spark, "tsv")
    c = table(spark, sf_dir, "customer")
    code = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit("no "), F.col("c_nationkey").cast("string")))
    out = c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment", code.alias("code"))
    readers.write_tsv(out, path, digits=10)
    back = readers.read_tsv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, code int")
    return back.withColumn("c_acctbal", F.round("c_acctbal", 2))


@plan("""SELECT event_id, event_type, value, CASE WHEN event_id % 3 <> 0 THEN props END AS props, [user_id, event_id % 10] AS keys FROM events""")
def json_round_trip(spark, sf_dir):
    path = _folder(spark, "json")
    e = table(spark, sf_dir, "events")
    readers.write_json(e.select("event_id", "event_type", "value", F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"), F.array("user_id", F.col("event_id") % 10).alias("keys")), path)
    return readers.read_json(spark, path, "event_id long, event_type string, value double, props string, keys array<long>", lines=True)


@plan("""SELECT 'chr' || (p_partkey % 22 + 1)::VARCHAR AS chrom, p_size * 1000 + p_partkey AS start, p_size * 1000 + p_partkey + 50 AS "end",
count(*) OVER (ORDER BY p_partkey % 22 + 1, p_size * 1000 + p_partkey, p_partkey ROWS UNBOUNDED PRECEDING) AS place FROM part""")
def bed_round_trip(spark, sf_dir):
    """Intervals in the file's order: files and their lines follow each other by chromosome number and start."""
    path = _folder(spark, "bed")
    start = (F.col("p_size") * 1000 + F.col("p_partkey")).cast("long")
    readers.write_bed(table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 50).alias("end")), path)
    back = spark.read.schema("chrom string, start long, end long").csv(path, sep="\t")
    # Where a line stands: how many the files before it have, and how many before it in its own, by the writer's order within it.
    back = back.withColumn("_file", F.col("_metadata.file_name"))
    files = [r["_file"] for r in back.select("_file").distinct().orderBy("_file").collect()]  # names only
    sizes = {r["_file"]: r["count"] for r in back.groupBy("_file").count().collect()}
    before, total = {}, 0
    for f in files:
        before[f], total = total, total + sizes[f]
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("_file").orderBy(F.regexp_extract("chrom", r"(\d+)", 1).cast("int"), "start"))
    ahead = F.create_map(*[x for f, n in before.items() for x in (F.lit(f), F.lit(n))])[F.col("_file")]
    return back.select("chrom", "start", "end", (ahead + own).cast("long").alias("place"))


@plan("""SELECT doc_id AS chrom, doc_id * 7 % 50 AS start, doc_id * 7 % 50 + 40 AS "end", substr(text, (doc_id * 7 % 50 + 1)::INTEGER, 40) AS piece FROM documents""")
def interval_fetch(spark, sf_dir):
    """The characters of one half-open interval of every text."""
    d = table(spark, sf_dir, "documents")
    at = F.col("doc_id") * 7 % 50
    return readers.interval_sequence(d.select(F.col("doc_id").alias("chrom"), at.alias("start"), (at + 40).alias("end")), d.select(F.col("doc_id").alias("chrom"), F.col("text").alias("seq")))
