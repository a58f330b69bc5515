"""Executable constraints: privacy patterns, value rules, set equality, required keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of text that must not leave: mail, phone, card-like numbers, sample accessions.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+\d{1,3}[ -]?)?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}",
    "address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "accession": r"\b(?:GSM|GSE|SRR|ERR|EGA[A-Z])\d{3,}\b",
}


def flag_text(df: DataFrame, column: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Add has_<name> for each pattern; a null text has none."""
    return df.withColumns({f"has_{k}": F.coalesce(F.col(column).rlike(p), F.lit(False)) for k, p in patterns.items()})


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Fail at run time on the first row where a rule is not true, naming the rule."""
    for name, rule in rules.items():
        df = df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return df


def bounded(df: DataFrame, by: Sequence[str], most: int) -> None:
    """Refuse at once a table with a group of more than ``most`` rows, for operators that hold a group in one place."""
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if largest > most:
        raise ValueError(f"a group of {', '.join(by)} has {largest} rows; this operator takes cohorts of at most {most}")


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule: (rule, n), one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("x")).select("x.*")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): keys found on one side only, in one exchange."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    g = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return g.select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def select_in_order(df: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """Rows by a list of keys, in its order; a listed key without a row fails."""
    joined = order.join(df.withColumn("_found", F.lit(True)), key, "left")
    return require(joined, {f"every {key} is present": F.col("_found").isNotNull()}).drop("_found").orderBy(place)
