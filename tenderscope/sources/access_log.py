"""Append-only tab-separated access log (A14) and its filters/counts (C11).

Lines have 5 fields ``ts, role, action, resource, outcome`` or the older 4
fields ``ts, role, outcome, resource`` (action derived from the outcome).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_access_log(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse text lines (the ``value`` column of the text source); other field counts are skipped."""
    p = lines.where(F.trim(F.col(value_col)) != "").select(F.split(F.col(value_col), "\t").alias("f"))
    n = F.size("f")
    out = p.where(n.isin(4, 5)).select(
        F.col("f")[0].alias("ts"), F.col("f")[1].alias("role"),
        F.when(n == 5, F.col("f")[2]).otherwise(F.initcap(F.replace(F.col("f")[2], F.lit("_"), F.lit(" ")))).alias("action"),
        F.when(n == 5, F.col("f")[3]).otherwise(F.col("f")[3]).alias("resource"),
        F.when(n == 5, F.col("f")[4]).otherwise(F.col("f")[2]).alias("outcome"))
    return out


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Read and parse, newest first."""
    return parse_access_log(spark.read.text(path)).orderBy(F.col("ts").desc())


def filter_log(log: DataFrame, roles: list[str] | None = None, actions: list[str] | None = None,
               search: str = "") -> DataFrame:
    """C11: role ∈, action ∈, case-insensitive literal resource substring."""
    out = log
    if roles:
        out = out.where(F.col("role").isin(*roles))
    if actions:
        out = out.where(F.col("action").isin(*actions))
    if search:
        out = out.where(F.lower(F.col("resource")).contains(search.lower()))
    return out


def log_summary(log: DataFrame) -> DataFrame:
    """C11: total events, reveal actions, failed sign-ins."""
    return log.agg(F.count(F.lit(1)).alias("total_events"),
                   F.count_if(F.lower(F.col("action")).contains("reveal")).alias("reveal_actions"),
                   F.count_if(F.col("outcome") == "failure").alias("failed_events"))
