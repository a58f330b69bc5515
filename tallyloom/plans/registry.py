"""Names of runnable plans: each maps to a callable (spark, sf_dir) and, where SQL can say the same, to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plan(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles: sums of doubles depend on their order."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, site, c, m, h): three states of line items per customer nation and supplier."""
    # A call without a site is no call. Saying so here gives every use of the cells the filter that joins on site infer,
    # so all uses share one scan and one exchange.
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").where("l_suppkey IS NOT NULL")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    is_ = lambda v: F.count_if(F.col("l_returnflag") == v)
    return joined.groupBy(F.col("c_nationkey").alias("sample"), F.col("l_suppkey").alias("site")).agg(is_("N").alias("c"), is_("A").alias("m"), is_("R").alias("h"))


CELLS = """cells AS (SELECT c_nationkey AS sample, l_suppkey AS site, count(*) FILTER (l_returnflag = 'N')::BIGINT AS c,
  count(*) FILTER (l_returnflag = 'A')::BIGINT AS m, count(*) FILTER (l_returnflag = 'R')::BIGINT AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

N_SAMPLES = "(SELECT count(DISTINCT sample) FROM cells)"

SUPPORT = f"""support AS (SELECT site FROM cells GROUP BY site HAVING count(*) FILTER (c + m + h >= 5) = {N_SAMPLES})"""

WINDOWS = """windows AS (SELECT sample, floor((site - 1) / 10)::BIGINT AS win, count(*)::BIGINT AS n_sites, avg(100.0 * m::DOUBLE / (c + m + h)) AS m, avg(100.0 * h::DOUBLE / (c + m + h)) AS h
  FROM cells JOIN support USING (site) GROUP BY 1, 2)"""

#: The same windows over sites with a depth of ten in every sample.
DEEP = f"""deep AS (SELECT sample, floor((site - 1) / 10)::BIGINT AS win, avg(100.0 * h::DOUBLE / (c + m + h)) AS h FROM cells
  JOIN (SELECT site FROM cells GROUP BY site HAVING count(*) FILTER (c + m + h >= 10) = {N_SAMPLES}) USING (site) GROUP BY 1, 2)"""

BASE = f"WITH {CELLS}, {SUPPORT}, {WINDOWS}"


def sample_count(cell: DataFrame) -> DataFrame:
    """Number of samples with a call. Using the counts keeps the same columns as elsewhere, so the exchange of the cells is reused."""
    return cell.where(F.col("c") + F.col("m") + F.col("h") > 0).agg(F.countDistinct("sample").alias("n_samples"))


def supported(cell: DataFrame, least: int = 5) -> DataFrame:
    """Sites with the depth in every sample, each once. The number of samples comes from one row, joined as a scalar.

    Join it as an inner join: a semi join would be moved below the cells' aggregate, and the line items read twice.
    """
    per_site = cell.groupBy("site").agg(F.count_if(F.col("c") + F.col("m") + F.col("h") >= least).alias("ok"))
    return per_site.join(F.broadcast(sample_count(cell)), F.col("ok") == F.col("n_samples")).select("site")


def windows(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """(sample, win, n_sites, m, h): equal-weight mean percents of supported sites in windows of ten."""
    from ..operators import counting

    cell = cells(spark, sf_dir)
    kept = cell.join(supported(cell, least), "site")
    pct = counting.percents(kept, ["m", "h"], ["pm", "ph"], F.col("c") + F.col("m") + F.col("h")).withColumn("win", F.floor((F.col("site") - 1) / 10))
    return counting.equal_weight_mean(pct.select("sample", "win", F.col("pm").alias("m"), F.col("ph").alias("h")), ["sample", "win"], ["m", "h"])


def names(columns: Sequence[str]) -> str:
    return ", ".join(columns)
