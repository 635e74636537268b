"""Cross-analysis integration: buyer metrics (I04), unified risk (I01),
community risk profiles (I02, V20), cross-analysis EDA queries (E05-E08,
E18, E20) and viewer queries (V01-V06, V16, V17, V19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import mean_of, risk_class
from .common import minmax_scale
from .joins import assert_unique

# fixed values: unified-risk weights (dependency, governance risk, price anomaly)
UNIFIED_WEIGHTS = (0.35, 0.40, 0.25)


def buyer_metrics(network_features: DataFrame, resilience: DataFrame | None = None) -> DataFrame:
    """Mean dependency, null-skipping single-bid rate, amendment rate per buyer (+ resilience)."""
    m = network_features.groupBy("buyer_id").agg(
        F.avg("buyer_dependency_ratio").alias("buyer_dependency_normalized"),
        F.avg((F.col("bid_count") <= 1).cast("double")).alias("single_bidder_rate"),
        F.avg((F.col("contract_amendments") > 0).cast("double")).alias("amendment_rate"))
    return m.join(resilience, "buyer_id", "left") if resilience is not None else m


def unified_risk(buyers: DataFrame, predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """0.35·minmax(dependency) + 0.40·risk + 0.25·anomaly (NULL -> 0), with class.

    Anomalies collapse to one row per contract (worst case) before the join
    and the buyer table is checked unique, so the result has exactly one row
    per prediction row (J12/J13).
    """
    b = buyers.select("buyer_id", "buyer_dependency_normalized")
    assert_unique(b, ["buyer_id"], "buyer metrics")
    a = anomalies.groupBy("contract_id").agg(F.max("anomaly_score").alias("anomaly_score"),
                                             F.max("consensus_flag").alias("consensus_flag"))
    p = predictions.select("contract_id", "buyer_id", "supplier_id", "cpv_division", "award_year", "ensemble_risk_prob")
    merged = p.join(b, "buyer_id", "left").join(a, "contract_id", "left") \
        .withColumn("_dep", F.coalesce(F.col("buyer_dependency_normalized"), F.lit(0.0)))
    scaled = minmax_scale(merged, "_dep", "buyer_dependency_normalized_mm")
    w_dep, w_gov, w_anom = UNIFIED_WEIGHTS
    u = (w_dep * F.col("buyer_dependency_normalized_mm") + w_gov * F.coalesce(F.col("ensemble_risk_prob"), F.lit(0.0))
         + w_anom * F.coalesce(F.col("anomaly_score"), F.lit(0.0)))
    return (scaled.withColumn("unified_risk_score", u)
            .select("contract_id", "buyer_id", "supplier_id", "cpv_division", "award_year", "ensemble_risk_prob",
                    F.col("buyer_dependency_normalized_mm").alias("buyer_dependency_normalized"), "anomaly_score",
                    "consensus_flag", "unified_risk_score", risk_class("unified_risk_score").alias("risk_class")))


def buyer_communities(partition: DataFrame) -> DataFrame:
    """Buyer rows of a node partition as (buyer_id, community_id)."""
    return (partition.where(F.col("node_id").startswith("B_"))
            .select(F.expr("substring(node_id, 3)").alias("buyer_id"), "community_id").dropDuplicates(["buyer_id"]))


def community_profile(unified: DataFrame, communities: DataFrame) -> DataFrame:
    """Per community contracts, mean risk, anomaly rate, mean unified risk, HIGH count."""
    u = unified.join(communities, "buyer_id", "left")
    return (u.where(F.col("community_id").isNotNull()).groupBy("community_id").agg(
        F.count(F.lit(1)).alias("contract_count"), F.avg("ensemble_risk_prob").alias("mean_governance_risk"),
        F.avg(F.col("consensus_flag").cast("double")).alias("anomaly_rate"),
        F.avg("unified_risk_score").alias("mean_unified_risk"),
        F.count_if(F.col("risk_class") == "HIGH").alias("high_risk_count")))


def community_risk_table(unified: DataFrame, communities: DataFrame, min_n: int = 10, top: int = 20) -> DataFrame:
    """Communities with >= min_n contracts, largest first."""
    return (community_profile(unified, communities).where(F.col("contract_count") >= min_n)
            .orderBy(F.col("contract_count").desc(), "community_id").limit(top))


def centrality_vs_price(anomalies: DataFrame, buyers: DataFrame) -> DataFrame:
    """Per rounded dependency band, mean of buyer mean anomaly score and Σ consensus anomalies."""
    pb = anomalies.groupBy("buyer_id").agg(F.avg("anomaly_score").alias("_m"),
                                           F.sum(F.when(F.col("consensus_flag"), 1).otherwise(0)).alias("_c"))
    return (pb.join(buyers, "buyer_id").groupBy(F.round("buyer_dependency_normalized", 2).alias("centrality_band"))
            .agg(F.avg("_m").alias("mean_price_anomaly"), F.sum("_c").cast("long").alias("consensus_anomalies")))


def centrality_vs_risk(predictions: DataFrame, buyers: DataFrame) -> DataFrame:
    """Per rounded dependency band, mean governance risk and contracts."""
    return (predictions.join(buyers, "buyer_id").groupBy(F.round("buyer_dependency_normalized", 2).alias("centrality_band"))
            .agg(F.avg("ensemble_risk_prob").alias("mean_governance_risk"), F.count(F.lit(1)).alias("contracts")))


def community_vs_risk(predictions: DataFrame, communities: DataFrame, top: int = 30) -> DataFrame:
    """Per community, buyers and mean of buyer mean risk (two-stage), top by buyers."""
    rb = predictions.groupBy("buyer_id").agg(F.avg("ensemble_risk_prob").alias("_r"))
    return (communities.join(rb, "buyer_id").groupBy("community_id")
            .agg(F.count(F.lit(1)).alias("buyers"), F.avg("_r").alias("mean_governance_risk"))
            .orderBy(F.col("buyers").desc(), "community_id").limit(top))


def risk_overlap(predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """2×2 of HIGH governance risk × price anomaly (anomalies pre-aggregated per contract)."""
    cp = anomalies.groupBy("contract_id").agg(F.max(F.when(F.col("consensus_flag"), 1).otherwise(0)).alias("_pa"))
    lab = predictions.join(cp, "contract_id", "left").select(
        F.when(F.col("risk_class") == "HIGH", "High governance risk").otherwise("Other governance risk").alias("governance_group"),
        F.when(F.coalesce(F.col("_pa"), F.lit(0)) == 1, "Price anomaly").otherwise("No price anomaly").alias("price_group"))
    return lab.groupBy("governance_group", "price_group").agg(F.count(F.lit(1)).alias("contracts"))


def class_distribution(predictions: DataFrame) -> DataFrame:
    """Contracts and share per risk class (total as a one-row aggregate)."""
    g = predictions.groupBy("risk_class").agg(F.count(F.lit(1)).alias("contracts"))
    t = g.agg(F.sum("contracts").alias("_t"))
    return g.crossJoin(F.broadcast(t)).select("risk_class", "contracts", (F.col("contracts") / F.col("_t")).alias("class_share"))


def risk_feature_profile(predictions: DataFrame) -> DataFrame:
    """Contracts, mean probability and mean amendments per risk class."""
    return predictions.groupBy("risk_class").agg(F.count(F.lit(1)).alias("contracts"),
                                                 F.avg("ensemble_risk_prob").alias("mean_risk_probability"),
                                                 F.avg("contract_amendments").alias("mean_amendments"))


def cpv_year_risk(unified: DataFrame) -> DataFrame:
    """Mean unified risk per (CPV, year), UNKNOWN CPV dropped (long form of the pivot)."""
    return (unified.where(F.col("cpv_division") != "UNKNOWN").groupBy("cpv_division", "award_year")
            .agg(F.avg("unified_risk_score").alias("mean_unified_risk"), F.count(F.lit(1)).alias("contracts")))


def yearly_risk(predictions: DataFrame, buyer_id: str | None = None, supplier_id: str | None = None) -> DataFrame:
    """Yearly mean risk and contracts for everyone, one buyer or one supplier ('ALL' = no filter)."""
    p = predictions
    if buyer_id and buyer_id != "ALL":
        p = p.where(F.col("buyer_id") == buyer_id)
    if supplier_id and supplier_id != "ALL":
        p = p.where(F.col("supplier_id") == supplier_id)
    return p.groupBy("award_year").agg(F.avg("ensemble_risk_prob").alias("mean_risk"), F.count(F.lit(1)).alias("contracts"))


def evidence_table(unified: DataFrame, communities: DataFrame, centrality: DataFrame) -> DataFrame:
    """Unified risk rows with the buyer's community and centrality (two left joins on buyer)."""
    return unified.join(communities.select("buyer_id", "community_id"), "buyer_id", "left").join(centrality, "buyer_id", "left")


def integration_metrics(unified: DataFrame, communities: DataFrame, min_group: int = 10) -> DataFrame:
    """One row with counts, mean risk, the two coverage-aware correlations
    (dependency with risk, risk with anomaly), and over communities of at least
    ``min_group`` contracts the ANOVA of risk and chi-square of the consensus flag."""
    from . import stats as st
    spark = unified.sparkSession
    one = unified.agg(F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("risk_class") == "HIGH").alias("high_risk_contracts"),
                      F.avg("unified_risk_score").alias("mean_unified_risk")).first()
    corr = [st.coverage_aware_corr(unified, a, b).first() for a, b in
            (("buyer_dependency_normalized", "ensemble_risk_prob"), ("ensemble_risk_prob", "anomaly_score"))]
    placed = unified.join(communities.select("buyer_id", "community_id"), "buyer_id").where(F.col("community_id").isNotNull())
    tested = placed.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_group)
    placed = placed.join(tested.select("community_id"), "community_id", "left_semi")
    tests = {r["test"]: r for r in st.p_value_table(
        spark, st.anova_oneway(placed, "community_id", "ensemble_risk_prob", min_group),
        st.chi2_independence(placed.where(F.col("consensus_flag").isNotNull()), "community_id", "consensus_flag")).collect()}
    row = (one["contracts"], one["high_risk_contracts"], one["mean_unified_risk"], corr[0]["value"], corr[1]["value"],
           tests["anova"]["statistic"], tests["anova"]["p_value"], tests["chi2"]["statistic"], tests["chi2"]["p_value"], tested.count())
    return spark.createDataFrame([row], "contracts long, high_risk_contracts long, mean_unified_risk double, rq1_rq2_corr double, "
                                 "rq2_rq3_corr double, anova_f_statistic double, anova_p_value double, chi_square_statistic double, "
                                 "chi_square_p_value double, number_of_communities_tested long")


def risk_class_counts(df: DataFrame) -> DataFrame:
    """Rows per risk class."""
    return df.groupBy("risk_class").agg(F.count(F.lit(1)).alias("contracts"))


def top_counterparties(predictions: DataFrame, entity_col: str, entity: str, other_col: str, top: int = 20) -> DataFrame:
    """An entity's top counterparties by contracts, with mean risk."""
    return (predictions.where(F.col(entity_col) == entity).groupBy(other_col)
            .agg(F.count(F.lit(1)).alias("contracts"), F.avg("ensemble_risk_prob").alias("mean_risk"))
            .orderBy(F.col("contracts").desc(), other_col).limit(top))


def amendments_by_procedure(predictions: DataFrame) -> DataFrame:
    """Mean amendments per procedure (UNKNOWN dropped)."""
    return (predictions.where(F.col("procedure_type") != "UNKNOWN").groupBy("procedure_type")
            .agg(F.avg("contract_amendments").alias("mean_amendments"), F.count(F.lit(1)).alias("contracts")))


#: flag columns of the detectors that vote for the consensus
DETECTORS = ("lof_flag", "iso_flag", "ee_flag")


def flags_per_detector(anomalies: DataFrame, flags: tuple[str, ...] = ("gb_flag", *DETECTORS, "consensus_flag")) -> DataFrame:
    """Flagged rows per detector, long form."""
    one = anomalies.agg(*[F.count_if(F.col(c)).alias(c) for c in flags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("detector"), F.col(c).alias("flagged")) for c in flags]))
                      .alias("s")).select("s.*")


def detector_agreement(anomalies: DataFrame, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """Rows per number of agreeing detectors."""
    n = sum((F.col(c).cast("int") for c in detectors), F.lit(0))
    return anomalies.groupBy(n.alias("detectors_agreeing")).agg(F.count(F.lit(1)).alias("contracts"))


def consensus_by_cpv(anomalies: DataFrame) -> DataFrame:
    """Consensus rate per CPV plus an 'overall' row (rollup)."""
    r = anomalies.rollup("cpv_division").agg(F.avg(F.col("consensus_flag").cast("double")).alias("consensus_rate"),
                                             F.count(F.lit(1)).alias("contracts"))
    return r.select(F.coalesce(F.col("cpv_division"), F.lit("overall")).alias("cpv_division"), "consensus_rate", "contracts")


def entity_profile(predictions: DataFrame, entity_col: str) -> DataFrame:
    """Per entity modal procedure (ties: smallest name), single-bid count,
    amendment rate and mean risk ('why flagged')."""
    modal2 = (predictions.groupBy(entity_col, "procedure_type").agg(F.count(F.lit(1)).alias("_n"))
              .groupBy(entity_col).agg(F.min_by("procedure_type", F.struct((-F.col("_n")).alias("_k"), F.col("procedure_type")))
                                       .alias("modal_procedure")))
    agg = predictions.groupBy(entity_col).agg(
        F.count_if(F.col("bid_count") <= 1).alias("single_bid_contracts"),
        F.avg((F.col("contract_amendments") > 0).cast("double")).alias("amendment_rate"),
        mean_of(F.sum("ensemble_risk_prob"), F.count("ensemble_risk_prob")).alias("mean_risk"),
        F.count(F.lit(1)).alias("contracts"))
    return agg.join(modal2, entity_col)
