"""Registered integration and cross-analysis queries.

The cross-analysis queries take model outputs as input. Two inputs are used:
* the real model outputs (``i01_unified_risk_models``; rows-only check), and
* rule-based stand-ins with the same schema, built from the test tables, so the
  cross-analysis jobs themselves get exact SQL oracles:
  - predictions: ``ensemble_risk_prob`` = the procedure-risk ladder (Q12) and
    ``risk_class`` by the M06 cut-offs;
  - anomalies: three rule flags (price above 1.5× estimate, single bid,
    more than two amendments) with the 2-of-3 consensus and the 1.0/0.7/0.0 score.
The stand-ins only shape input rows; every named step of each query runs in
the library operator on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import procedure_risk, procedure_risk_sql, risk_class, risk_class_sql
from ..operators import governance as gov
from ..operators import integrate as ig
from ..operators import pricing as pr
from ..operators.graph import build as gb
from .catalogue import C, PRICE_SQL
from .ml import governance_scored, price_flags
from .registry import register


#: the rules that stand in for the three detectors
RULE_FLAGS = ("price_over_estimate_flag", "single_bid_flag", "amended_flag")


def rule_predictions(spark, sf_dir):
    c = C(spark, sf_dir).where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull()
                               & (F.col("contract_value") > 0))
    return c.select("contract_id", "buyer_id", "supplier_id", "cpv_division", "procedure_type", "award_year",
                    "contract_amendments", "bid_count", procedure_risk().alias("ensemble_risk_prob")) \
        .withColumn("risk_class", risk_class("ensemble_risk_prob"))


def rule_anomalies(spark, sf_dir):
    f = pr.price_proxy(C(spark, sf_dir))
    lof = F.col("final_price") > 1.5 * F.col("estimated_price")
    iso = F.coalesce(F.col("bid_count") == 1, F.lit(False))
    ee = F.coalesce(F.col("contract_amendments") > 2, F.lit(False))
    gbf = F.abs(F.col("log_price") - F.col("log_estimated_price")) > 1.0
    n = lof.cast("int") + iso.cast("int") + ee.cast("int")
    return f.select("contract_id", "buyer_id", "supplier_id", "cpv_division", "final_price", "estimated_price",
                    "award_year", "contract_amendments", gbf.alias("log_gap_flag"), lof.alias("price_over_estimate_flag"), iso.alias("single_bid_flag"),
                    ee.alias("amended_flag"), (n >= 2).alias("consensus_flag"),
                    F.when(n >= 2, 1.0).when(n == 1, 0.7).otherwise(0.0).alias("anomaly_score"))


def buyers(spark, sf_dir):
    c = C(spark, sf_dir)
    return ig.buyer_metrics(gov.network_features(c))


def communities(spark, sf_dir):
    return ig.buyer_communities(gb.region_partition(C(spark, sf_dir)))


STANDIN_SQL = PRICE_SQL + """,
predictions AS (
    SELECT contract_id, buyer_id, supplier_id, cpv_division, procedure_type, award_year, contract_amendments, bid_count,
        """ + procedure_risk_sql() + """ AS ensemble_risk_prob
    FROM contracts_base WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0),
preds AS (SELECT *, """ + risk_class_sql("ensemble_risk_prob") + """ AS risk_class FROM predictions),
flags AS (
    SELECT contract_id, buyer_id, supplier_id, cpv_division, final_price, estimated_price, award_year, contract_amendments,
           ABS(log_price - log_estimated_price) > 1.0 AS log_gap_flag, final_price > 1.5 * estimated_price AS price_over_estimate_flag,
           COALESCE(bid_count = 1, FALSE) AS single_bid_flag, COALESCE(contract_amendments > 2, FALSE) AS amended_flag
    FROM rq3_features),
anomalies AS (
    SELECT *, (price_over_estimate_flag::INT + single_bid_flag::INT + amended_flag::INT) >= 2 AS consensus_flag,
           CASE WHEN (price_over_estimate_flag::INT + single_bid_flag::INT + amended_flag::INT) >= 2 THEN 1.0
                WHEN (price_over_estimate_flag::INT + single_bid_flag::INT + amended_flag::INT) = 1 THEN 0.7 ELSE 0.0 END AS anomaly_score
    FROM flags),
s AS (SELECT buyer_id, supplier_id, SUM(contract_value) AS v FROM contracts_base
      WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0 GROUP BY buyer_id, supplier_id),
bd AS (SELECT buyer_id, MAX(v) / SUM(v) AS dep FROM s GROUP BY buyer_id),
nf AS (SELECT c.*, bd.dep AS buyer_dependency_ratio FROM contracts_base c LEFT JOIN bd USING (buyer_id)
       WHERE c.buyer_id IS NOT NULL AND c.supplier_id IS NOT NULL AND c.contract_value > 0),
buyer_metrics AS (
    SELECT buyer_id, AVG(buyer_dependency_ratio) AS buyer_dependency_normalized,
           AVG(CAST(bid_count <= 1 AS DOUBLE)) AS single_bidder_rate,
           AVG(CAST(contract_amendments > 0 AS DOUBLE)) AS amendment_rate
    FROM nf GROUP BY buyer_id),
communities AS (SELECT buyer_id, MIN(buyer_region) AS community_id FROM contracts_base
                WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL GROUP BY buyer_id),
a1 AS (SELECT contract_id, MAX(anomaly_score) AS anomaly_score, BOOL_OR(consensus_flag) AS consensus_flag
       FROM anomalies GROUP BY contract_id),
merged AS (SELECT p.contract_id, p.buyer_id, p.supplier_id, p.cpv_division, p.award_year, p.ensemble_risk_prob,
                  COALESCE(b.buyer_dependency_normalized, 0.0) AS dep, a1.anomaly_score, a1.consensus_flag
           FROM preds p LEFT JOIN buyer_metrics b USING (buyer_id) LEFT JOIN a1 USING (contract_id)),
mm AS (SELECT MIN(dep) AS mn, MAX(dep) AS mx FROM merged),
unified AS (
    SELECT contract_id, buyer_id, supplier_id, cpv_division, award_year, ensemble_risk_prob,
           CASE WHEN mx = mn THEN 0.0 ELSE LEAST(GREATEST((dep - mn) / (mx - mn), 0.0), 1.0) END AS buyer_dependency_normalized,
           anomaly_score, consensus_flag
    FROM merged, mm),
unified_risk AS (
    SELECT *, 0.35 * buyer_dependency_normalized + 0.40 * COALESCE(ensemble_risk_prob, 0.0) + 0.25 * COALESCE(anomaly_score, 0.0)
              AS unified_risk_score FROM unified),
unified_c AS (SELECT *, """ + risk_class_sql("unified_risk_score") + """ AS risk_class FROM unified_risk)"""


def unified_rules(spark, sf_dir):
    return ig.unified_risk(buyers(spark, sf_dir), rule_predictions(spark, sf_dir), rule_anomalies(spark, sf_dir))


@register("i04_buyer_metrics", r6=("buyer_dependency_normalized", "single_bidder_rate", "amendment_rate"),
          sql="WITH " + STANDIN_SQL + "\nSELECT * FROM buyer_metrics")
def i04_buyer_metrics(spark, sf_dir):
    """Per-buyer mean dependency, null-skipping single-bid rate, amendment rate."""
    return buyers(spark, sf_dir)


@register("i01_unified_risk", r6=("buyer_dependency_normalized", "unified_risk_score"),
          sql="WITH " + STANDIN_SQL + "\nSELECT * FROM unified_c")
def i01_unified_risk(spark, sf_dir):
    """Unified risk over buyer metrics, rule-based predictions and rule-based anomaly flags."""
    return unified_rules(spark, sf_dir)


@register("i01_unified_risk_models")
def i01_unified_risk_models(spark, sf_dir):
    """I01 on the real model outputs (ensemble scores and detector consensus)."""
    scored = governance_scored(spark, sf_dir)[0]
    flags = price_flags(spark, sf_dir)[0]
    return ig.unified_risk(buyers(spark, sf_dir), scored, flags)


@register("i02_community_profile", r6=("mean_governance_risk", "anomaly_rate", "mean_unified_risk"),
          sql="WITH " + STANDIN_SQL + """
SELECT community_id, COUNT(*) AS contract_count, AVG(ensemble_risk_prob) AS mean_governance_risk,
       AVG(CAST(consensus_flag AS DOUBLE)) AS anomaly_rate, AVG(unified_risk_score) AS mean_unified_risk,
       COUNT(*) FILTER (WHERE risk_class = 'HIGH') AS high_risk_count
FROM unified_c LEFT JOIN communities USING (buyer_id) WHERE community_id IS NOT NULL GROUP BY community_id""")
def i02_community_profile(spark, sf_dir):
    """Community risk profile of the unified risk table."""
    return ig.community_profile(unified_rules(spark, sf_dir), communities(spark, sf_dir))


@register("v20_community_risk_table", r6=("mean_governance_risk", "anomaly_rate", "mean_unified_risk"),
          sql="WITH " + STANDIN_SQL + """
SELECT community_id, COUNT(*) AS contract_count, AVG(ensemble_risk_prob) AS mean_governance_risk,
       AVG(CAST(consensus_flag AS DOUBLE)) AS anomaly_rate, AVG(unified_risk_score) AS mean_unified_risk,
       COUNT(*) FILTER (WHERE risk_class = 'HIGH') AS high_risk_count
FROM unified_c LEFT JOIN communities USING (buyer_id) WHERE community_id IS NOT NULL GROUP BY community_id
HAVING COUNT(*) >= 10 ORDER BY contract_count DESC, community_id LIMIT 20""")
def v20_community_risk_table(spark, sf_dir):
    """Communities with >= 10 contracts, top 20 by size."""
    return ig.community_risk_table(unified_rules(spark, sf_dir), communities(spark, sf_dir))


@register("e05_centrality_vs_price", r6=("centrality_band", "mean_price_anomaly"), sql="WITH " + STANDIN_SQL + """,
banded AS (SELECT buyer_id, ROUND(buyer_dependency_normalized, 2) AS centrality_band FROM buyer_metrics)
SELECT centrality_band, AVG(score) AS mean_price_anomaly, CAST(SUM(flagged) AS BIGINT) AS consensus_anomalies
FROM (SELECT centrality_band, AVG(anomaly_score) AS score, COUNT(*) FILTER (WHERE consensus_flag) AS flagged
      FROM anomalies JOIN banded USING (buyer_id) GROUP BY buyer_id, centrality_band)
GROUP BY centrality_band""")
def e05_centrality_vs_price(spark, sf_dir):
    """Price anomalies per dependency band."""
    return ig.centrality_vs_price(rule_anomalies(spark, sf_dir), buyers(spark, sf_dir))


@register("e06_centrality_vs_risk", r6=("centrality_band", "mean_governance_risk"), sql="WITH " + STANDIN_SQL + """
SELECT ROUND(b.buyer_dependency_normalized, 2) AS centrality_band, AVG(p.ensemble_risk_prob) AS mean_governance_risk,
       COUNT(*) AS contracts
FROM preds p JOIN buyer_metrics b USING (buyer_id) GROUP BY 1""")
def e06_centrality_vs_risk(spark, sf_dir):
    """Governance risk per dependency band."""
    return ig.centrality_vs_risk(rule_predictions(spark, sf_dir), buyers(spark, sf_dir))


@register("e07_community_vs_risk", r6=("mean_governance_risk",), sql="WITH " + STANDIN_SQL + """,
per_buyer AS (SELECT community_id, SUM(ensemble_risk_prob) / COUNT(*) AS risk
              FROM communities JOIN preds USING (buyer_id) GROUP BY community_id, buyer_id)
SELECT community_id, COUNT(risk) AS buyers, SUM(risk) / COUNT(risk) AS mean_governance_risk
FROM per_buyer GROUP BY community_id ORDER BY 2 DESC, 1 LIMIT 30""")
def e07_community_vs_risk(spark, sf_dir):
    """Buyers and mean buyer risk per community, top 30."""
    return ig.community_vs_risk(rule_predictions(spark, sf_dir), communities(spark, sf_dir))


@register("e08_risk_overlap", sql="WITH " + STANDIN_SQL + """,
odd AS (SELECT DISTINCT contract_id FROM anomalies WHERE consensus_flag)
SELECT IF(risk_class = 'HIGH', 'High', 'Other') || ' governance risk' AS governance_group,
       IF(contract_id IN (FROM odd), 'Price anomaly', 'No price anomaly') AS price_group, COUNT(*) AS contracts
FROM preds GROUP BY ALL""")
def e08_risk_overlap(spark, sf_dir):
    """HIGH governance risk × price anomaly 2×2 table."""
    return ig.risk_overlap(rule_predictions(spark, sf_dir), rule_anomalies(spark, sf_dir))


@register("e18_class_distribution", r6=("class_share",), sql="WITH " + STANDIN_SQL + """
SELECT risk_class, COUNT(*) AS contracts, COUNT(*) / SUM(COUNT(*)) OVER () AS class_share FROM preds GROUP BY risk_class""")
def e18_class_distribution(spark, sf_dir):
    """Risk-class counts and shares."""
    return ig.class_distribution(rule_predictions(spark, sf_dir))


@register("e20_risk_feature_profile", r6=("mean_risk_probability", "mean_amendments"), sql="WITH " + STANDIN_SQL + """
SELECT risk_class, COUNT(*) AS contracts, AVG(ensemble_risk_prob) AS mean_risk_probability,
       AVG(contract_amendments) AS mean_amendments FROM preds GROUP BY risk_class""")
def e20_risk_feature_profile(spark, sf_dir):
    """Contracts, mean probability, mean amendments per class."""
    return ig.risk_feature_profile(rule_predictions(spark, sf_dir))


@register("e27_price_anomaly_profile", r6=("mean_anomaly_score",), sql="WITH " + STANDIN_SQL + """
SELECT cpv_division, COUNT(*) AS priced_contracts, CAST(SUM(CASE WHEN consensus_flag THEN 1 ELSE 0 END) AS BIGINT) AS consensus_anomalies,
       AVG(anomaly_score) AS mean_anomaly_score FROM anomalies GROUP BY cpv_division
ORDER BY consensus_anomalies DESC, cpv_division LIMIT 25""")
def e27_price_anomaly_profile(spark, sf_dir):
    """Priced rows, consensus anomalies and mean score per CPV, top 25."""
    return pr.anomaly_profile(rule_anomalies(spark, sf_dir))


@register("v01_cpv_year_risk", r6=("mean_unified_risk",), sql="WITH " + STANDIN_SQL + """
SELECT cpv_division, award_year, AVG(unified_risk_score) AS mean_unified_risk, COUNT(*) AS contracts
FROM unified_c WHERE cpv_division <> 'UNKNOWN' GROUP BY 1, 2""")
def v01_cpv_year_risk(spark, sf_dir):
    """Mean unified risk per CPV × year."""
    return ig.cpv_year_risk(unified_rules(spark, sf_dir))


@register("v02_yearly_risk", r6=("mean_risk",), sql="WITH " + STANDIN_SQL + """
SELECT award_year, AVG(ensemble_risk_prob) AS mean_risk, COUNT(*) AS contracts FROM preds GROUP BY award_year""")
def v02_yearly_risk(spark, sf_dir):
    """Yearly mean risk and contracts (whole population)."""
    return ig.yearly_risk(rule_predictions(spark, sf_dir))


@register("v03_risk_class_counts", sql="WITH " + STANDIN_SQL + """
SELECT risk_class, COUNT(*) AS contracts FROM unified_c GROUP BY risk_class""")
def v03_risk_class_counts(spark, sf_dir):
    """Unified risk-class counts."""
    return ig.risk_class_counts(unified_rules(spark, sf_dir))


@register("v05_amendments_by_procedure", r6=("mean_amendments",), sql="WITH " + STANDIN_SQL + """
SELECT procedure_type, AVG(contract_amendments) AS mean_amendments, COUNT(*) AS contracts FROM preds
WHERE procedure_type <> 'UNKNOWN' GROUP BY procedure_type""")
def v05_amendments_by_procedure(spark, sf_dir):
    """Mean amendments per procedure (UNKNOWN dropped)."""
    return ig.amendments_by_procedure(rule_predictions(spark, sf_dir))


@register("v06_flags_per_detector", sql="WITH " + STANDIN_SQL + """
SELECT detector, flagged FROM (
    SELECT 'log_gap_flag' AS detector, COUNT(*) FILTER (WHERE log_gap_flag) AS flagged FROM anomalies
    UNION ALL SELECT 'price_over_estimate_flag', COUNT(*) FILTER (WHERE price_over_estimate_flag) FROM anomalies
    UNION ALL SELECT 'single_bid_flag', COUNT(*) FILTER (WHERE single_bid_flag) FROM anomalies
    UNION ALL SELECT 'amended_flag', COUNT(*) FILTER (WHERE amended_flag) FROM anomalies
    UNION ALL SELECT 'consensus_flag', COUNT(*) FILTER (WHERE consensus_flag) FROM anomalies)""")
def v06_flags_per_detector(spark, sf_dir):
    """Flagged rows per detector."""
    return ig.flags_per_detector(rule_anomalies(spark, sf_dir), ("log_gap_flag", *RULE_FLAGS, "consensus_flag"))


@register("v16_detector_agreement", sql="WITH " + STANDIN_SQL + """
SELECT price_over_estimate_flag::INT + single_bid_flag::INT + amended_flag::INT AS detectors_agreeing, COUNT(*) AS contracts FROM anomalies GROUP BY 1""")
def v16_detector_agreement(spark, sf_dir):
    """Detector-agreement histogram."""
    return ig.detector_agreement(rule_anomalies(spark, sf_dir), RULE_FLAGS)


@register("v17_consensus_by_cpv", r6=("consensus_rate",), sql="WITH " + STANDIN_SQL + """
SELECT cpv_division, AVG(CAST(consensus_flag AS DOUBLE)) AS consensus_rate, COUNT(*) AS contracts FROM anomalies GROUP BY cpv_division
UNION ALL SELECT 'overall', AVG(CAST(consensus_flag AS DOUBLE)), COUNT(*) FROM anomalies""")
def v17_consensus_by_cpv(spark, sf_dir):
    """Consensus rate per CPV and overall (rollup)."""
    return ig.consensus_by_cpv(rule_anomalies(spark, sf_dir))


@register("v19_buyer_profile", r6=("amendment_rate",), mean=("mean_risk",), sql="WITH " + STANDIN_SQL + """,
pc AS (SELECT buyer_id, procedure_type, COUNT(*) AS n FROM preds GROUP BY 1, 2),
modal AS (SELECT buyer_id, procedure_type AS modal_procedure FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY n DESC, procedure_type) AS rn FROM pc) WHERE rn = 1)
SELECT p.buyer_id, COUNT(*) FILTER (WHERE bid_count <= 1) AS single_bid_contracts,
       AVG(CAST(contract_amendments > 0 AS DOUBLE)) AS amendment_rate,
       AVG(ensemble_risk_prob) AS mean_risk,
       COUNT(*) AS contracts, MIN(m.modal_procedure) AS modal_procedure
FROM preds p JOIN modal m USING (buyer_id) GROUP BY p.buyer_id""")
def v19_buyer_profile(spark, sf_dir):
    """V19: 'why flagged' profile per buyer."""
    return ig.entity_profile(rule_predictions(spark, sf_dir), "buyer_id")


@register("m07_buyer_risk_profile", r6=("negotiated_or_restricted_rate", "true_single_bid_rate"), mean=("mean_risk",),
          sql="WITH " + STANDIN_SQL + """
SELECT buyer_id, COUNT(*) AS contracts, AVG(ensemble_risk_prob) AS mean_risk,
       AVG(CAST((procedure_type = 'RESTRICTED' OR procedure_type ILIKE '%NEGOTIATED%') AS DOUBLE)) AS negotiated_or_restricted_rate,
       AVG(CAST(bid_count <= 1 AS DOUBLE)) AS true_single_bid_rate
FROM preds GROUP BY buyer_id""")
def m07_buyer_risk_profile(spark, sf_dir):
    """Per-buyer mean risk, negotiated/restricted rate and null-skipping single-bid rate."""
    return gov.buyer_risk_profile(rule_predictions(spark, sf_dir))


@register("t12_amendment_enrichment", r6=("high_amendment_rate", "low_amendment_rate", "enrichment"), sql="WITH " + STANDIN_SQL + """
SELECT AVG(CASE WHEN risk_class = 'HIGH' THEN CAST(contract_amendments > 0 AS DOUBLE) END) AS high_amendment_rate,
       AVG(CASE WHEN risk_class = 'LOW' THEN CAST(contract_amendments > 0 AS DOUBLE) END) AS low_amendment_rate,
       AVG(CASE WHEN risk_class = 'HIGH' THEN CAST(contract_amendments > 0 AS DOUBLE) END)
       / NULLIF(AVG(CASE WHEN risk_class = 'LOW' THEN CAST(contract_amendments > 0 AS DOUBLE) END), 0) AS enrichment
FROM preds""")
def t12_amendment_enrichment(spark, sf_dir):
    """Amendment rate among HIGH-risk rows over the rate among LOW-risk rows."""
    return gov.amendment_enrichment(rule_predictions(spark, sf_dir))


@register("v18_anomaly_audit_trail")
def v18_anomaly_audit_trail(spark, sf_dir):
    """Top 300 anomalies of the price model with z = residual / sd and reason text."""
    from ..operators import views as vw
    return vw.anomaly_audit_trail(price_flags(spark, sf_dir)[0], 300)
