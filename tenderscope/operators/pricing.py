"""Price features and price profiles (Q13, E25-E28, T16 baseline)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import mean_of
from .common import grouped_quantiles, with_quantiles


def price_proxy(contracts: DataFrame, min_priced_per_cpv: int = 300) -> DataFrame:
    """Q13: priced contracts in CPV divisions with >= gate priced rows; log prices.

    The eligible-CPV table has one row per CPV division (a bounded code list),
    so the semi-join's build side is small; Spark/AQE broadcast it by size.
    """
    priced = (contracts.where(F.col("cpv_division").isNotNull() & (F.col("cpv_division") != "UNKNOWN")
                              & (F.col("final_price") > 0)))
    eligible = (priced.groupBy("cpv_division").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= min_priced_per_cpv).select("cpv_division"))
    return (contracts.where((F.col("final_price") > 0) & (F.col("estimated_price") > 0))
            .join(eligible, "cpv_division", "left_semi")
            .select("contract_id", "buyer_id", "supplier_id", "cpv_division", "final_price",
                    F.ln(F.col("final_price") + 1).alias("log_price"), "estimated_price",
                    F.ln(F.col("estimated_price") + 1).alias("log_estimated_price"), "bid_count",
                    "procedure_type", "award_year", "contract_amendments"))


def priced_cpv_coverage(features: DataFrame, top: int = 25) -> DataFrame:
    """Priced contracts, mean and median price per CPV, top by count."""
    per = (features.groupBy("cpv_division")
           .agg(F.count(F.lit(1)).alias("priced_contracts"), mean_of(F.sum("final_price"), F.count("final_price")).alias("mean_price")))
    return with_quantiles(per, features, ["cpv_division"], "final_price", {"median_price": 0.5}) \
        .orderBy(F.col("priced_contracts").desc(), "cpv_division").limit(top)


def log_price_distribution(features: DataFrame) -> DataFrame:
    """Histogram of log price at 0.1 resolution."""
    return (features.where(F.col("log_price").isNotNull())
            .groupBy(F.round("log_price", 1).alias("log_price_band")).agg(F.count(F.lit(1)).alias("contracts")))


def price_band(p):
    return (F.when(p < 1000, "<1k").when(p < 10000, "1k-10k").when(p < 100000, "10k-100k")
            .when(p < 1000000, "100k-1m").otherwise("1m+"))


def price_distribution(features: DataFrame) -> DataFrame:
    """Contracts per price band."""
    return features.groupBy(price_band(F.col("final_price")).alias("price_band")).agg(
        F.count(F.lit(1)).alias("contracts"))


def anomaly_profile(anomalies: DataFrame, top: int = 25) -> DataFrame:
    """Per CPV priced rows, consensus anomalies, mean anomaly score; top by anomalies."""
    return (anomalies.groupBy("cpv_division")
            .agg(F.count(F.lit(1)).alias("priced_contracts"),
                 F.sum(F.when(F.col("consensus_flag"), 1).otherwise(0)).cast("long").alias("consensus_anomalies"),
                 F.avg("anomaly_score").alias("mean_anomaly_score"))
            .orderBy(F.col("consensus_anomalies").desc(), "cpv_division").limit(top))


def median_baseline_rmse(df: DataFrame, group_col: str, target: str, prediction: str) -> DataFrame:
    """RMSE of a model vs the group-median baseline (global median if a group is unseen).

    Returns one row: rmse_model, rmse_baseline, rmse_reduction, r2.
    """
    med = grouped_quantiles(df, [group_col], target, {"_gm": 0.5})
    glob = with_quantiles(df.agg(F.avg(target).alias("_mean")), df, [], target, {"_glob": 0.5})
    j = df.join(med, group_col, "left").crossJoin(F.broadcast(glob))
    base = F.coalesce(F.col("_gm"), F.col("_glob"))
    agg = j.agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col(prediction), 2))).alias("rmse_model"),
                F.sqrt(F.avg(F.pow(F.col(target) - base, 2))).alias("rmse_baseline"),
                F.sum(F.pow(F.col(target) - F.col(prediction), 2)).alias("_sse"),
                F.sum(F.pow(F.col(target) - F.col("_mean"), 2)).alias("_sst"))
    return agg.select("rmse_model", "rmse_baseline",
                      (1 - F.col("rmse_model") / F.nullif(F.col("rmse_baseline"), F.lit(0.0))).alias("rmse_reduction"),
                      (1 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).alias("r2"))
