"""Leakage and integrity audits as distributed checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import _pearson_cols

# fixed values: proxy gate levels (WARN at >= 0.55, FAIL above 0.95), tautology above 0.99
PROXY_WARN = 0.55
PROXY_FAIL = 0.95
TAUTOLOGY = 0.99


def split_overlap(train: DataFrame, test: DataFrame, key: str = "contract_id", year: str = "award_year") -> DataFrame:
    """Years and ids present in both train and test (semi-join counts)."""
    yo = train.select(year).distinct().join(test.select(year).distinct(), year, "left_semi").agg(
        F.count(F.lit(1)).alias("overlapping_years"))
    io = train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi").agg(
        F.count(F.lit(1)).alias("overlapping_ids"))
    return yo.crossJoin(io)


def future_feature_violations(history: DataFrame, latest: str = "supplier_feature_latest_date",
                              focal: str = "focal_award_date") -> DataFrame:
    """Rows whose feature source date is not strictly before the focal date."""
    return history.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(latest) >= F.col(focal)).alias("violations"))


def hhi_asof_gap(full: DataFrame, asof: DataFrame) -> DataFrame:
    """Full-period HHI vs as-of HHI per (buyer, year): mean and max absolute gap."""
    j = asof.join(full.select("buyer_id", F.col("buyer_concentration_hhi").alias("_full")), "buyer_id")
    d = F.abs(F.col("_full") - F.col("hhi_asof"))
    return j.agg(F.count(F.lit(1)).alias("buyer_years"), F.avg(d).alias("mean_abs_gap"), F.max(d).alias("max_abs_gap"),
                 F.count_if(d > 1e-9).alias("differing"))


def proxy_gate(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Per feature the max |Pearson r| against the label and label inputs,
    one aggregation for all pairs, then PASS / WARN / FAIL."""
    aggs = [F.abs(_pearson_cols(F.col(f).cast("double"), F.col(t).cast("double"))).alias(f"{f}__{t}")
            for f in features for t in targets]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                   F.greatest(*[F.coalesce(F.col(f"{f}__{t}"), F.lit(0.0)) for t in targets] + [F.lit(0.0)])
                                                   .alias("max_abs_corr")) for f in features])).alias("s")).select("s.*")
    return rows.withColumn("status", F.when(F.col("max_abs_corr") > PROXY_FAIL, "FAIL")
                           .when(F.col("max_abs_corr") >= PROXY_WARN, "WARN").otherwise("PASS"))


def forbidden_columns(spark: SparkSession, model_features: list[str], forbidden: list[str]) -> DataFrame:
    """Forbidden label columns among the model features (schema check)."""
    bad = sorted(set(model_features) & set(forbidden))
    return spark.createDataFrame([(len(model_features), len(bad), ",".join(bad))],
                                 "features int, forbidden_found int, columns string")


def provenance_complete(scored: DataFrame, tag: str) -> DataFrame:
    """Every scored row carries a provenance tag; counts per tag and missing."""
    return scored.groupBy(F.coalesce(F.col(tag), F.lit("<missing>")).alias(tag)).agg(F.count(F.lit(1)).alias("rows"))


def expectation_table(spark: SparkSession, checks: list[tuple[str, float, float, float]]) -> DataFrame:
    """(check, value, lo, hi) -> status PASS when lo <= value <= hi."""
    df = spark.createDataFrame(checks, "check string, value double, lo double, hi double")
    return df.withColumn("status", F.when(F.col("value").between(F.col("lo"), F.col("hi")), "PASS").otherwise("FAIL"))


def target_tautology(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Features with |r| > 0.99 against the price target."""
    return proxy_gate(df, features, [target]).withColumn(
        "tautology", F.col("max_abs_corr") > TAUTOLOGY).drop("status")


def drift_check(current: DataFrame, baseline: DataFrame, tol_col: str = "tolerance") -> DataFrame:
    """Join current metrics to recorded baselines; within tolerance or not."""
    j = baseline.join(current.withColumnRenamed("value", "current"), "metric", "left")
    return j.withColumn("within_tolerance", F.abs(F.col("current") - F.col("value")) <= F.col(tol_col))
