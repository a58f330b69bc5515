"""Targeted extraction with resume: the lines of each sample's texts that overlap its target regions.

    python jobs/region_extract.py jobs/region_extract.json [name=value ...]

Texts are contigs, their lines the reads on them. Targets are the neighbourhoods
of a motif's sites, merged, with enough sites, on the contigs that the ``needed``
table asks for. A line is extracted if it overlaps a target and holds no private
pattern. Below ``output`` the job writes

* ``reads/sample=``: the extracted lines with their place, targets and composition;
* ``targets/sample=``: the regions;
* ``done/sample=``: what the sample's input was when it was extracted, and what came out.

Samples are extracted a few at a time, and a sample is marked as done after its
reads are written. A run leaves out samples whose input is as it was when they
were done. So a run that is stopped goes on where it was, new texts or a changed
need cost their samples only, and a run without changes writes nothing. Every
write replaces whole samples.
"""

from __future__ import annotations

import json
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import scalars
from tallyloom.operators import guards, intervals
from tallyloom.sources import readers

log = logging.getLogger("tallyloom.jobs.region_extract")

DEFAULTS = {"motif": "GH", "flank": 30, "least_sites": 1, "bin_size": 256, "samples_at_once": 8}
READS = "doc_id long, line long, start long, end long, n_targets long, covered long, gc double, text string, digest long, sample string"
TARGETS = "doc_id long, start long, end long, n_sites long, digest long, sample string"
DONE = "contigs long, chars long, digest long, reads long, held long, sample string"


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of this job; one that nothing was written to yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def contigs_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(sample, doc_id, text, wanted) of texts with a name. The name must be unique; ``wanted`` says if its lines are needed."""
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("source").alias("sample"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    need = needed.where("quality = 1").select("doc_id", F.lit(True).alias("wanted")).distinct()
    return named.join(need, "doc_id", "left").na.fill({"wanted": False})


def targets_of(contigs: DataFrame, motif: str, flank: int, least_sites: int) -> DataFrame:
    """(doc_id, start, end, n_sites): merged windows of ``flank`` characters around the motif's sites, clipped to the contig."""
    # Other letters become one character each, so that no change of case moves a place.
    plain = contigs.select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", ".").alias("text"))
    sites = readers.sites_of(plain, "doc_id", "text", motif)
    length = contigs.select("doc_id", F.length("text").cast("long").alias("length"))
    around = sites.join(length, "doc_id").select("doc_id", F.greatest(F.col("pos") - flank, F.lit(0)).cast("long").alias("start"), F.least(F.col("pos") + len(motif) + flank, F.col("length")).cast("long").alias("end"))
    return intervals.clusters(around, ["doc_id"]).withColumnRenamed("members", "n_sites").where(F.col("n_sites") >= least_sites)


def lines_of(contigs: DataFrame) -> DataFrame:
    """(doc_id, line, start, end, text): the lines of each contig that are not empty, as half-open intervals of characters."""
    cut = contigs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    cut = cut.select("doc_id", F.col("line").cast("long").alias("line"), start.alias("start"), "text")
    return cut.select("doc_id", "line", "start", (F.col("start") + F.length("text")).alias("end"), "text").where("end > start")


def extract(contigs: DataFrame, targets: DataFrame, bin_size: int) -> DataFrame:
    """Lines that overlap a target: targets met, characters covered, G and C share, and whether a private pattern is in them."""
    met = intervals.overlap_join(lines_of(contigs), targets, ["doc_id"], bin_size=bin_size)
    covered = intervals.overlap_length("start", "end", "r_start", "r_end")
    reads = met.groupBy("doc_id", "line", "start", "end").agg(F.count("*").alias("n_targets"), F.sum(covered).cast("long").alias("covered"), F.any_value("text").alias("text"))
    flagged = guards.flag_text(reads.withColumn("gc", scalars.fraction_of("text")), "text")
    private = F.lit(False)
    for name in guards.PATTERNS:
        private = private | F.col(f"has_{name}")
    return flagged.select("doc_id", "line", "start", "end", "n_targets", "covered", "gc", "text", private.alias("private"))


def _replace(df: DataFrame, path: str) -> None:
    df.hint("rebalance", "sample").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)


def _among(samples: list[str | None]):
    named = [s for s in samples if s is not None]
    found = F.col("sample").isin(named) if named else F.lit(False)
    return found | F.col("sample").isNull() if None in samples else found


def states(contigs: DataFrame, config: dict) -> DataFrame:
    """One row a sample: size of its input, and a digest of the input and of the rules that apply to it."""
    rules = F.lit(f"{config['motif']} {config['flank']} {config['least_sites']}")
    return contigs.groupBy("sample").agg(F.count("*").alias("contigs"), F.sum(F.length("text")).cast("long").alias("chars"), F.bit_xor(F.xxhash64("doc_id", "text", "wanted", rules)).alias("digest"))


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Extract samples that are new or changed. Gives all extracted reads as they then stand.

    ``config`` has the paths documents, needed and output, and may set motif,
    flank, least_sites, bin_size and samples_at_once. A sample whose texts are
    gone keeps what was extracted. Null texts are empty; texts without a name are
    left out; a name that is there twice is refused.
    """
    config = DEFAULTS | config
    out = config["output"].rstrip("/")
    docs = spark.read.parquet(config["documents"])
    twice = guards.repeated_keys(docs.where("doc_id IS NOT NULL").select("doc_id"), ["doc_id"]).count()
    if twice:
        raise ValueError(f"{twice} names stand at more than one text of {config['documents']}")
    contigs = contigs_of(docs, spark.read.parquet(config["needed"]))
    # One row a sample comes to the driver: what is to be done.
    done = read_back(spark, f"{out}/done", DONE).select(F.col("sample").alias("d_sample"), F.col("digest").alias("d_digest"))
    todo = states(contigs, config).join(done, F.expr("sample <=> d_sample AND digest = d_digest"), "left_anti").orderBy("sample").collect()
    log.info("%d samples of %s to be extracted", len(todo), config["documents"])
    for k in range(0, len(todo), config["samples_at_once"]):
        some = todo[k : k + config["samples_at_once"]]
        _batch(contigs.where(_among([r.sample for r in some])), some, out, config)
    return reads(spark, out)


def _batch(contigs: DataFrame, some: list[Row], out: str, config: dict) -> None:
    """Extract a few samples, write their regions and reads, and then mark them as done."""
    spark = contigs.sparkSession
    now = F.broadcast(spark.createDataFrame([(r.sample, r.digest) for r in some], "o_sample string, digest long"))  # a few samples
    wanted = contigs.where("wanted")
    owner = wanted.select("doc_id", "sample").join(now, F.expr("sample <=> o_sample")).drop("o_sample")
    found = targets_of(wanted, config["motif"], config["flank"], config["least_sites"]).join(owner, "doc_id")
    _replace(found.select("doc_id", "start", "end", "n_sites", "digest", "sample"), f"{out}/targets")
    targets = read_back(spark, f"{out}/targets", TARGETS).where(_among([r.sample for r in some])).where(F.col("digest").isin([r.digest for r in some])).select("doc_id", "start", "end")
    lines = extract(wanted, targets, config["bin_size"]).join(owner, "doc_id").persist()
    try:
        n = {r.sample: r for r in lines.groupBy("sample").agg(F.count_if(~F.col("private")).alias("reads"), F.count_if("private").alias("held")).collect()}
        _replace(lines.where("NOT private").select(*[c.split()[0] for c in READS.split(", ")]), f"{out}/reads")
    finally:
        lines.unpersist()
    rows = [(r.contigs, r.chars, r.digest, n[r.sample].reads if r.sample in n else 0, n[r.sample].held if r.sample in n else 0, r.sample) for r in some]
    _replace(spark.createDataFrame(rows, DONE), f"{out}/done")
    for contigs_n, chars, _, written, held, sample in rows:
        log.info("sample %s: %d contigs, %d characters read; %d lines written, %d with a private pattern held back", sample, contigs_n, chars, written, held)


def reads(spark: SparkSession, output: str) -> DataFrame:
    """Extracted lines of samples that are done. What a stopped run or an earlier input left is not among them."""
    out = output.rstrip("/")
    done = read_back(spark, f"{out}/done", DONE).select(F.col("sample").alias("d_sample"), F.col("digest").alias("d_digest"))
    found = read_back(spark, f"{out}/reads", READS).join(done, F.expr("sample <=> d_sample AND digest = d_digest"), "left_semi")
    return found.select("sample", "doc_id", "line", "start", "end", "n_targets", "covered", "gc", "text")


def main(argv: list[str]) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(argv[0], encoding="utf-8") as f:
        config = json.load(f)
    for pair in argv[1:]:
        name, value = pair.split("=", 1)
        config[name] = type(DEFAULTS.get(name, ""))(value)
    spark = SparkSession.builder.appName("region extract").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
