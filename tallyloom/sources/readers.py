"""Readers and writers: typed TSV, JSON, matrices, series metadata, sequences, alignments, checked files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import parse_missing


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, missing: Sequence[str] = ("", "None", "NA", "nan", "NaN", "null")) -> DataFrame:
    """Tab-separated text (gzip by extension) with a header; every spelling of missing becomes null, then columns take ``schema``."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    raw = raw.select(*[parse_missing(f"`{c}`", tuple(missing)).alias(c) for c in raw.columns])
    if schema is None:
        return raw
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    check_columns(raw, want.names)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in want.fields])


def write_tsv(df: DataFrame, path: str, missing: str = "NA", digits: int | None = None) -> None:
    """Gzipped tab-separated text with a header; doubles keep ``digits`` significant digits if given."""
    if digits:
        df = df.withColumns({c: F.format_string(f"%.{digits}g", F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue=missing, compression="gzip")


def write_bed(df: DataFrame, path: str, chrom: str = "chrom") -> None:
    """Intervals sorted by numeric chromosome, then start: a range sort, so files follow each other in order."""
    number = F.regexp_extract(chrom, r"(\d+)", 1).cast("int")
    df.orderBy(number, "start", "end").write.mode("overwrite").csv(path, sep="\t", header=False)


def write_json(df: DataFrame, path: str) -> None:
    """Gzipped JSON, a row a line, nulls written out. Spark's commit makes the folder whole or leaves it without a success mark."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path, compression="gzip")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False) -> DataFrame:
    """One document or list a file, or with ``lines`` a row a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def check_columns(df: DataFrame, names: Sequence[str], exact: bool = True) -> DataFrame:
    """Fail unless the columns are exactly (or at least) ``names``."""
    missing, extra = set(names) - set(df.columns), set(df.columns) - set(names)
    if missing or (exact and extra):
        raise ValueError(f"columns missing: {sorted(missing)}; unexpected: {sorted(extra)}")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, mtime) of the files below ``path`` without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each whole file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def target_rows(lines: DataFrame, targets: DataFrame, delimiter: str = "\t", width: int | None = None) -> DataFrame:
    """(target, fields, n): wanted rows of a text matrix by first field. A target seen twice or a row of the wrong width fails.

    The wanted names are a small table; the scan of the matrix keeps only their rows.
    """
    fields = F.split("value", f"\\Q{delimiter}\\E")
    rows = lines.select(F.regexp_replace(fields[0], '^"|"$', "").alias("target"), fields.alias("fields")).join(targets, "target", "left_semi")
    # One check after the window: a check before it could be moved below the join and see unwanted rows.
    n = F.count("*").over(Window.partitionBy("target"))
    bad = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated target "), "target")))
    if width:
        bad = bad.when((F.col("n") > 0) & (F.size("fields") != width), F.raise_error(F.lit("row of the wrong width")))
    return rows.withColumn("n", n).where(bad.cast("boolean").isNull()).drop("n")


def series_metadata(lines: DataFrame, prefix: str = "!Sample_", order: str = "line") -> DataFrame:
    """(sample, key, value) from header lines: one key a line, one sample a field; ``key: value`` fields name their own key.

    ``lines`` has (line, value). Repeated keys of a sample are joined by ' | ' in line order.
    """
    d = lines.where(F.col("value").startswith(prefix)).withColumn("f", F.split("value", "\t"))
    long = d.select(order, F.expr(f"substring(f[0], {len(prefix) + 1})").alias("key"), F.posexplode(F.slice("f", 2, 1 << 30)).alias("sample", "text"))
    text = F.regexp_replace("text", '^"|"$', "")
    own = text.rlike(r"^[^:]+: ")
    named = long.select(order, "sample", F.when(own, F.regexp_extract(text, r"^([^:]+): ", 1)).otherwise(F.col("key")).alias("key"), F.when(own, F.regexp_replace(text, r"^[^:]+: ", "")).otherwise(text).alias("value"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"])
    return named.groupBy("sample", "key").agg(F.array_join(parts, " | ").alias("value"))


def metadata_table(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy("sample").pivot("key", list(keys)).agg(F.first("value"))


def sites_of(sequences: DataFrame, name: str = "chrom", sequence: str = "seq", pattern: str = "CG") -> DataFrame:
    """(chrom, pos) of every start of ``pattern`` in each sequence, 0-based; long sequences are cut into overlapping pieces first."""
    step, over = 100_000, len(pattern) - 1
    pieces = sequences.select(name, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length(sequence) - 1, F.lit(0)).cast("long"), F.lit(step).cast("long"))).alias("_at"), sequence)
    pieces = pieces.select(name, "_at", F.upper(F.col(sequence).substr((F.col("_at") + 1).cast("int"), F.lit(step + over))).alias("_s"))
    hits = pieces.select(name, "_at", F.posexplode(F.split("_s", f"(?={pattern})")).alias("_k", "_piece"))
    before = Window.partitionBy(name, "_at").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("pos", F.col("_at") + F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
    return hits.where(F.col("_piece").startswith(pattern)).select(name, "pos")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): one row per record; records are split by the reader, never by the driver."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    return records.select(head.alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "").alias("seq"))


def interval_sequence(intervals: DataFrame, sequences: DataFrame, name: str = "chrom") -> DataFrame:
    """Add ``piece``: the sequence of each half-open interval."""
    return intervals.join(sequences, name).withColumn("piece", F.col("seq").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("seq")


_CIGAR = r"(\d+)([MIDNSHP=X])"


def read_sam(lines: DataFrame) -> DataFrame:
    """Alignment text lines (column value) to name, flag, chrom, pos (0-based), mapq, cigar, seq, quals, qs, mods.

    mods holds (query place, kind, probability byte) decoded from the MM and ML
    tags of C+m / C+h lists; the k-th entry skips that many Cs of the read as sequenced.
    """
    f = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("@")).select(f.alias("f"))
    tag = lambda t: F.regexp_extract(F.array_join(F.slice("f", 12, 1 << 20), "\t"), rf"(?:^|\t){t}:[A-Za-z]:([^\t]*)", 1)
    ops = F.regexp_extract_all(F.col("f")[5], F.lit(_CIGAR), 1)
    kinds = F.regexp_extract_all(F.col("f")[5], F.lit(_CIGAR), 2)
    cigar = F.zip_with(kinds, ops, lambda k, n: F.struct(k.alias("op"), n.cast("int").alias("len")))
    return body.select(
        F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("chrom"), (F.col("f")[3].cast("long") - 1).alias("pos"), F.col("f")[4].cast("int").alias("mapq"),
        cigar.alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("quals"), tag("qs").try_cast("double").alias("qs"), F.nullif(tag("MM"), F.lit("")).alias("mm"), F.nullif(F.regexp_replace(tag("ML"), "^C,?", ""), F.lit("")).alias("ml"),
    )


def modification_calls(reads: DataFrame, key: str = "name") -> DataFrame:
    """(key, query_place, pm, ph): probabilities of both kinds at each listed C; a byte b is (b + 0.5) / 256. Needs both kinds, else no rows."""
    parsed = reads.where(F.col("mm").isNotNull() & F.col("ml").isNotNull()).select(key, "flag", "seq", F.regexp_extract("mm", r"C\+(mh|hm)[?.]?,?([0-9,]*);", 2).alias("skips"), F.regexp_extract("mm", r"C\+(mh|hm)", 1).alias("kind"), F.split("ml", ",").alias("ml"))
    p = parsed.where(F.col("kind") != "").withColumn("reverse", F.col("flag").bitwiseAND(F.lit(16)) != 0)
    as_read = F.when(F.col("reverse"), F.translate(F.reverse("seq"), "ACGT", "TGCA")).otherwise(F.col("seq"))
    p = p.withColumn("n", F.length("seq")).withColumn("places", F.filter(F.transform(F.split(as_read, ""), lambda b, i: F.when(b == "C", i)), lambda i: i.isNotNull()))
    calls = p.select(key, "reverse", "n", "places", "kind", "ml", F.posexplode(F.split("skips", ",")).alias("k", "skip")).where("skip <> ''")
    nth = F.sum(F.col("skip").cast("int") + 1).over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - 1
    calls = calls.withColumn("place", F.get(F.col("places"), nth.cast("int")))
    byte = lambda d: (F.get(F.col("ml"), (F.col("k") * 2 + d).cast("int")).cast("double") + 0.5) / 256
    first, second = byte(0), byte(1)
    is_mh = F.col("kind") == "mh"
    return calls.where("place is not null").select(key, F.when(F.col("reverse"), F.col("n") - 1 - F.col("place")).otherwise(F.col("place")).alias("query_place"), F.when(is_mh, first).otherwise(second).alias("pm"), F.when(is_mh, second).otherwise(first).alias("ph"))
