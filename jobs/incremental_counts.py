"""Incremental site counts: new files of calls add to the counts of their sample once, however often a call is delivered.

    python jobs/incremental_counts.py jobs/incremental_counts.json [name=value ...]

Calls come as Parquet files in a growing folder. A file stream takes what its
checkpoint has not seen and stops. Each batch of files is checked by ordered
rules; of the calls that pass, the first of each (read, place) is kept, unless an
earlier batch has counted it already. Below ``output`` the job writes

* ``ledger/batch=/bucket=``: every call that was counted, once;
* ``changes/batch=/sample=``: what a batch adds to each site;
* ``totals/sample=``: counts of each sample and site up to now;
* ``checks/batch=``: how many calls each rule took, were repeats, or counted.

A batch overwrites its own partitions and those of the samples it touches, and
looks for earlier calls only in batches before it. So a batch that is run again
after a failure gives the same files, and a run without new files changes
nothing. Calls of one bucket are only compared with that bucket's ledger: the
join is on bucket, read and place, and reads the three columns alone.
"""

from __future__ import annotations

import json
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import counting

log = logging.getLogger("tallyloom.jobs.incremental_counts")

DEFAULTS = {"buckets": 16, "least_quality": 5.0, "files_per_batch": None}
#: A call's read and its place on it. Of repeats within a batch the first in this order counts.
KEY = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
STATES = {"c": "N", "m": "A", "h": "R"}

_LEDGER = "l_orderkey long, l_linenumber int, sample int, site long, state string, batch long, bucket int"
_CHANGES = "site long, c long, m long, h long, batch long, sample int"
_TOTALS = "site long, c long, m long, h long, sample int"
_CHECKS = "reason string, n long, batch long"


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of this job; one that no batch has written to yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that ``df`` has rows of. Large ones are split over tasks by the optimizer."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def judged(calls: DataFrame, samples: DataFrame, least_quality: float) -> DataFrame:
    """Calls with their sample, site, state and ``reason``: the first rule that holds, ``repeat`` within the batch, or ``kept``."""
    found = calls.join(samples, "l_orderkey", "left").withColumns({"site": F.col("l_suppkey"), "state": F.col("l_returnflag")})
    rules = [
        ("unnamed", F.col("l_orderkey").isNull() | F.col("l_linenumber").isNull()), ("no sample", F.col("sample").isNull()), ("no site", F.col("site").isNull()),
        ("no state", F.coalesce(~F.col("state").isin(*STATES.values()), F.lit(True))), ("quality", ~F.coalesce(F.col("l_quantity") >= least_quality, F.lit(False))),
    ]
    return counting.mark_repeats(counting.reject(found, rules), KEY, ORDER, F.col("reason") == "kept", "repeat")


def take(calls: DataFrame, batch: int, config: dict) -> dict[str, int]:
    """Count one batch. Gives the number of calls by reason."""
    spark, out = calls.sparkSession, config["output"].rstrip("/")
    customers = spark.read.parquet(config["customers"]).select("c_custkey", F.col("c_nationkey").cast("int").alias("sample"))
    samples = spark.read.parquet(config["orders"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "sample")
    calls = judged(calls, samples, config["least_quality"]).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(config["buckets"])).cast("int"))
    before = read_back(spark, f"{out}/ledger", _LEDGER).where(F.col("batch") < batch).select("bucket", *KEY, F.lit(True).alias("_seen"))
    calls = calls.join(before, ["bucket", *KEY], "left").withColumn("reason", F.when((F.col("reason") == "kept") & F.col("_seen"), "seen").otherwise(F.col("reason")))
    calls = calls.select("bucket", *KEY, "sample", "site", "state", "reason").persist()
    try:
        new = calls.where("reason = 'kept'").withColumn("batch", F.lit(batch))
        _replace(new.select("l_orderkey", "l_linenumber", "sample", "site", "state", "batch", "bucket"), f"{out}/ledger", "batch", "bucket")
        _replace(calls.groupBy("reason").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch)), f"{out}/checks", "batch")
    finally:
        calls.unpersist()
    counted = read_back(spark, f"{out}/ledger", _LEDGER).where(F.col("batch") == batch)
    _replace(counting.state_counts(counted, ["batch", "sample", "site"], "state", STATES), f"{out}/changes", "batch", "sample")
    changes = read_back(spark, f"{out}/changes", _CHANGES).where(F.col("batch") <= batch)
    touched = changes.where(F.col("batch") == batch).select("sample").distinct()
    totals = changes.join(touched, "sample", "left_semi").groupBy("sample", "site").agg(*(F.sum(c).alias(c) for c in STATES))
    _replace(totals, f"{out}/totals", "sample")
    return {r.reason: r.n for r in read_back(spark, f"{out}/checks", _CHECKS).where(F.col("batch") == batch).collect()}


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Count what is new and wait for it. Gives the totals (sample, site, c, m, h) as they then stand.

    ``config`` has the paths calls (a folder of Parquet files, or one file), orders, customers, output and checkpoint, and
    may set buckets, least_quality and files_per_batch (all new files at once
    unless set). Where files of one run hold different calls of one read and
    place, the first in ``ORDER`` counts; over batches, the earliest.
    """
    config = DEFAULTS | config
    calls = config["calls"].rstrip("/")
    try:
        found = spark.read.parquet(calls)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log.info("no calls in %s yet", config["calls"])
        return totals(spark, config["output"])
    stream, (folder, _, name) = spark.readStream.schema(found.schema), calls.rpartition("/")
    one = found.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name")).first()
    if one is not None and one.name == name:  # a file stream reads folders: a single file is the only one of that name in its own
        stream, calls = stream.option("pathGlobFilter", name), folder
    if config["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
    read = {"batches": 0, "calls": 0}

    def each(calls: DataFrame, batch: int) -> None:
        n = take(calls, batch, config)
        read["batches"], read["calls"] = read["batches"] + 1, read["calls"] + sum(n.values())
        log.info("batch %d read %d calls: %s", batch, sum(n.values()), ", ".join(f"{k} {v}" for k, v in sorted(n.items())))

    query = stream.parquet(calls).writeStream.foreachBatch(each).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d calls in %d new batches from %s; totals in %s/totals", read["calls"], read["batches"], config["calls"], config["output"])
    return totals(spark, config["output"])


def totals(spark: SparkSession, output: str) -> DataFrame:
    return read_back(spark, f"{output.rstrip('/')}/totals", _TOTALS).select("sample", "site", *STATES)


def main(argv: list[str]) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(argv[0], encoding="utf-8") as f:
        config = json.load(f)
    for pair in argv[1:]:
        name, value = pair.split("=", 1)
        config[name] = type(DEFAULTS[name])(value) if DEFAULTS.get(name) is not None else int(value) if name in DEFAULTS else value
    spark = SparkSession.builder.appName("incremental counts").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
