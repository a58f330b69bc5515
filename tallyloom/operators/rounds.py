"""Small tables that go from one round of an iteration to the next."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Only a local master, whose executors live
    in the driver's process, falls back to a temporary one.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallyloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def passed_on(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so the next round's plan starts there and a lost executor costs a re-read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
