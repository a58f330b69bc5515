"""Shared pieces: reading tables, word patterns, tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than ASCII white space. ``bytes.split()`` with
#: no argument splits on exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The session's ``spark.checkpoint.dir`` names it. Only a local master, whose
    executors live in the driver's process, falls back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in a folder for each value of ``by`` if given, and read it back.

    This cuts the lineage, so a lost executor costs a re-read and never a
    recomputation of everything before, and an iteration's plan stays short.
    Shuffle files of the write go when it ends, and not when the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of tables made by :func:`keep` in this process, in order.
_KEPT: list[str] = []


def mark() -> int:
    """A point in time for :func:`sweep`."""
    return len(_KEPT)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete what :func:`keep` wrote after ``since`` but for the last table, which holds the result of all the others."""
    jvm = spark.sparkContext._jvm
    for path in _KEPT[since:-1]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del _KEPT[since:-1]


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or the first of name_1, name_2, ... that no column of a table already has (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(used) + 2))) if n.lower() not in used)


def spread(text: Column, most: int, piece: int = 2000) -> Column:
    """A text of up to ``most`` characters as it is; of a longer one as many in pieces from all over it, evenly spread, with spaces between.

    For training samples whose bytes must be bounded without leaving out long texts or their ends.
    """
    n = max(1, most // piece)
    at = lambda i: (F.floor(i * (F.length(text) - piece) / max(1, n - 1)) + 1).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(text, at(i), F.lit(piece)))
    return F.when(F.length(text) > most, F.array_join(pieces, " ")).otherwise(text)


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)
