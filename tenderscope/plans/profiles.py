"""Registered profile queries: samples, centres and distributions behind the
charts, entity drill-downs, evidence tables and the integration bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import competition_risk_sql, procedure_risk_sql, risk_label_sql
from ..operators import ecosystem as eco
from ..operators import governance as gov
from ..operators import integrate as ig
from ..operators import joins
from ..operators import pricing as pr
from ..operators import sampling as smp
from ..operators import stats as st
from ..operators import views as vw
from ..operators.graph import build as gb
from .catalogue import BUYER_MASTER_SQL, PRICE_SQL, C
from .features import VALID, governance_sql
from .graph import EDGES_SQL, edges
from .history import Q11_SQL
from .integration import STANDIN_SQL, buyers, communities, rule_anomalies, rule_predictions, unified_rules
from .registry import register

ROW = ["contract_id", "supplier_id", "buyer_id", "award_date"]
SEEDED = "md5(concat_ws('|', '42', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in ROW) + "))"
ORDER = SEEDED + ", " + ", ".join(ROW)


@register("n03_price_sample", r4=("final_price",), sql=f"""
SELECT contract_id, supplier_id, final_price FROM contracts_base WHERE final_price >= 10000 AND final_price <= 5000000
ORDER BY {ORDER}, final_price LIMIT 50000""")
def n03_price_sample(spark, sf_dir):
    """Seeded sample of at most 50,000 prices between 10 thousand and 5 million."""
    c = C(spark, sf_dir).where(F.col("final_price").between(10_000, 5_000_000))
    return smp.seeded_sample(c, 50_000, 42, ROW).select("contract_id", "supplier_id", "final_price")


@register("n11_log_price_sample", r6=("log_price",), sql=f"""
SELECT contract_id, supplier_id, LOG10(1 + final_price) AS log_price FROM contracts_base WHERE final_price > 0
ORDER BY {ORDER} LIMIT 500000""")
def n11_log_price_sample(spark, sf_dir):
    """Base-10 log(price + 1) of a seeded sample of at most 500,000 rows."""
    s = smp.seeded_sample(C(spark, sf_dir).where(F.col("final_price") > 0), 500_000, 42, ROW)
    return s.select("contract_id", "supplier_id", F.log10(F.col("final_price") + 1).alias("log_price"))


@register("g04_g06_g14_centres", r6=("centre",), sql="""
WITH spend AS (SELECT LOG10(SUM(contract_value)) AS x FROM contracts_base WHERE contract_value > 0 GROUP BY buyer_id)
SELECT 'median log10 value' AS measure, MEDIAN(LOG10(contract_value)) AS centre FROM contracts_base WHERE contract_value > 0
UNION ALL SELECT 'mean log10 buyer spend', AVG(x) FROM spend
UNION ALL SELECT 'median log10 bids', MEDIAN(LOG10(bid_count)) FROM contracts_base WHERE bid_count > 0""")
def g04_g06_g14_centres(spark, sf_dir):
    """The medians and the mean drawn into the log10 histograms."""
    c = C(spark, sf_dir)
    spend = c.where(F.col("contract_value") > 0).groupBy("buyer_id").agg(F.log10(F.sum("contract_value")).alias("x"))
    parts = [vw.exact_median(c.where(F.col("contract_value") > 0), F.log10("contract_value"), "median log10 value"),
             spend.agg(F.lit("mean log10 buyer spend").alias("measure"), F.avg("x").alias("centre")),
             vw.exact_median(c.where(F.col("bid_count") > 0), F.log10("bid_count"), "median log10 bids")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("g07_dependency_histogram", r6=("bin",), sql="WITH " + BUYER_MASTER_SQL + """
SELECT LEAST(FLOOR(20 * ROUND(dependency_ratio, 9)), 19) / 20 AS bin, COUNT(*) AS buyers FROM buyer_master GROUP BY ALL""")
def g07_dependency_histogram(spark, sf_dir):
    """Buyers per 0.05-wide bin of the top-5 dependency ratio."""
    b = eco.buyer_ecosystem(C(spark, sf_dir))
    bin_ = F.least(F.floor(20 * F.round("dependency_ratio", 9)), F.lit(19)) / 20
    return b.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("buyers"))


@register("g08_hhi_cdf", r6=("hhi", "cdf"), sql="WITH " + BUYER_MASTER_SQL + """
SELECT hhi, SUM(COUNT(*)) OVER (ORDER BY hhi) / SUM(COUNT(*)) OVER () AS cdf
FROM (SELECT ROUND(buyer_concentration_hhi, 6) AS hhi FROM buyer_master) GROUP BY hhi""")
def g08_hhi_cdf(spark, sf_dir):
    """Empirical distribution function of buyer HHI (at 6 decimals)."""
    b = eco.buyer_ecosystem(C(spark, sf_dir)).select(F.round("buyer_concentration_hhi", 6).alias("hhi"))
    return vw.empirical_cdf(b, "hhi")


@register("v04_top_counterparties", r6=("mean_risk",), sql="WITH " + STANDIN_SQL + """,
largest AS (SELECT buyer_id FROM preds GROUP BY buyer_id ORDER BY COUNT(*) DESC, buyer_id LIMIT 1)
SELECT supplier_id, COUNT(*) AS contracts, AVG(ensemble_risk_prob) AS mean_risk
FROM preds JOIN largest USING (buyer_id) GROUP BY supplier_id ORDER BY contracts DESC, supplier_id LIMIT 20""")
def v04_top_counterparties(spark, sf_dir):
    """The largest buyer's 20 suppliers with most contracts, and their mean risk."""
    p = rule_predictions(spark, sf_dir)
    largest = p.groupBy("buyer_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "buyer_id").first()["buyer_id"]
    return ig.top_counterparties(p, "buyer_id", largest, "supplier_id", 20)


@register("v11_two_hop_edges", r4=("weight",), sql="WITH " + EDGES_SQL + """,
heavy AS (SELECT node_id, SUM(weight) AS w FROM inc GROUP BY node_id ORDER BY w DESC, node_id LIMIT 1),
ball AS (SELECT node_id FROM heavy UNION SELECT other FROM inc WHERE node_id IN (SELECT node_id FROM heavy))
SELECT src, dst, weight, contracts FROM edges WHERE src IN (FROM ball) OR dst IN (FROM ball)
ORDER BY weight DESC, src, dst LIMIT 150""")
def v11_two_hop_edges(spark, sf_dir):
    """Edges of the heaviest node and of its neighbours, first 150 by weight."""
    e = edges(spark, sf_dir)
    seed = (gb.incidence(e).groupBy("node_id").agg(F.sum("weight").alias("w"))
            .orderBy(F.col("w").desc(), "node_id").limit(1).select("node_id"))
    return gb.two_hop_edges(e, seed).orderBy(F.col("weight").desc(), "src", "dst").limit(150) \
        .select("src", "dst", "weight", "contracts")


@register("v20_riskiest_communities", r6=("mean_unified_risk", "anomaly_rate"), sql="WITH " + STANDIN_SQL + """
SELECT community_id, COUNT(*) AS contract_count, AVG(unified_risk_score) AS mean_unified_risk,
       AVG(CAST(consensus_flag AS DOUBLE)) AS anomaly_rate
FROM unified_c JOIN communities USING (buyer_id) GROUP BY community_id HAVING COUNT(*) >= 10
ORDER BY mean_unified_risk DESC, community_id LIMIT 40""")
def v20_riskiest_communities(spark, sf_dir):
    """The 40 communities of at least 10 contracts with the highest mean unified risk."""
    p = ig.community_profile(unified_rules(spark, sf_dir), communities(spark, sf_dir)).where(F.col("contract_count") >= 10)
    return (p.orderBy(F.col("mean_unified_risk").desc(), "community_id").limit(40)
            .select("community_id", "contract_count", "mean_unified_risk", "anomaly_rate"))


@register("v21_degree_summary", r6=("p90", "top_decile_to_mean"), sql="WITH " + EDGES_SQL + """,
degrees AS (SELECT node_id, LEFT(node_id, 1) AS kind, COUNT(*) AS d FROM inc GROUP BY ALL),
placed AS (SELECT kind, d, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY d DESC, node_id) AS place, COUNT(*) OVER (PARTITION BY kind) AS n
           FROM degrees)
SELECT IF(kind = 'B', 'buyer', 'supplier') AS node_type, QUANTILE_CONT(d, 0.9) AS p90,
       AVG(d) FILTER (WHERE place <= n // 10) / AVG(d) AS top_decile_to_mean FROM placed GROUP BY kind""")
def v21_degree_summary(spark, sf_dir):
    """90th percentile of degree and mean degree of the top decile over the mean, per node type."""
    return vw.degree_summary(gb.node_metrics(edges(spark, sf_dir)))


def _scored(spark, sf_dir):
    c = C(spark, sf_dir).where(F.col("bid_count").isNotNull())
    return c.select((F.col("bid_count") <= 1).cast("int").alias("y"), F.round(F.log10(F.greatest("contract_value", F.lit(1.0))), 2).alias("s"))


SCORED_SQL = """scored AS (SELECT CAST(bid_count <= 1 AS INT) AS y, ROUND(LOG10(GREATEST(contract_value, 1)), 2) AS s
                           FROM contracts_base WHERE bid_count IS NOT NULL),
points AS (SELECT s AS threshold, SUM(SUM(y)) OVER up AS tp, SUM(SUM(1 - y)) OVER up AS fp, SUM(SUM(y)) OVER () AS p,
                  SUM(SUM(1 - y)) OVER () AS n FROM scored GROUP BY s WINDOW up AS (ORDER BY s DESC))"""


@register("v25_roc_points", r6=("threshold", "fpr", "tpr"), sql="WITH " + SCORED_SQL + "\nSELECT threshold, fp / n AS fpr, tp / p AS tpr FROM points")
def v25_roc_points(spark, sf_dir):
    """ROC points of log value (2 decimals) for single bids, one per distinct threshold."""
    return st.curve_points(_scored(spark, sf_dir), "y", "s").select("threshold", "fpr", "tpr")


@register("v25_pr_points", r6=("threshold", "recall", "precision"), sql="WITH " + SCORED_SQL + """
SELECT threshold, tp / p AS recall, tp / (tp + fp) AS precision FROM points""")
def v25_pr_points(spark, sf_dir):
    """Precision-recall points of the same score."""
    return st.curve_points(_scored(spark, sf_dir), "y", "s").select("threshold", F.col("tpr").alias("recall"), "precision")


@register("v27_community_risk_box", r6=("min", "q1", "median", "q3", "max"), sql="WITH " + STANDIN_SQL + """,
placed AS (SELECT community_id, unified_risk_score AS x FROM unified_c JOIN communities USING (buyer_id)),
big AS (SELECT community_id FROM placed GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 15)
SELECT community_id, COUNT(*) AS n, MIN(x) AS min, QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.5) AS median,
       QUANTILE_CONT(x, 0.75) AS q3, MAX(x) AS max FROM placed WHERE community_id IN (FROM big) GROUP BY 1""")
def v27_community_risk_box(spark, sf_dir):
    """Box statistics of unified risk in the 15 largest communities."""
    d = unified_rules(spark, sf_dir).join(communities(spark, sf_dir), "buyer_id").select("community_id", "unified_risk_score")
    big = d.groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "community_id").limit(15)
    return vw.box_stats(d.join(big.select("community_id"), "community_id", "left_semi"), "community_id", "unified_risk_score")


@register("j16_evidence_table", r6=("unified_risk_score", "centrality"), sql="WITH " + STANDIN_SQL + ",\n" + EDGES_SQL + """,
degrees AS (SELECT node_id, COUNT(*) AS degree FROM inc GROUP BY node_id),
central AS (SELECT SUBSTR(node_id, 3) AS buyer_id, degree, degree / ((SELECT COUNT(*) FROM degrees) - 1) AS centrality
            FROM degrees WHERE node_id LIKE 'B!_%' ESCAPE '!')
SELECT contract_id, buyer_id, supplier_id, unified_risk_score, consensus_flag, community_id, degree, centrality
FROM unified_c LEFT JOIN communities USING (buyer_id) LEFT JOIN central USING (buyer_id)""")
def j16_evidence_table(spark, sf_dir):
    """Unified risk with the buyer's community, degree and degree centrality, one row per scored row."""
    m = gb.node_metrics(edges(spark, sf_dir)).where(F.col("node_type") == "buyer") \
        .select(F.expr("substring(node_id, 3)").alias("buyer_id"), "degree", F.col("degree_centrality").alias("centrality"))
    return ig.evidence_table(unified_rules(spark, sf_dir), communities(spark, sf_dir), m) \
        .select("contract_id", "buyer_id", "supplier_id", "unified_risk_score", "consensus_flag", "community_id", "degree", "centrality")


@register("j17_features_predictions", sql="WITH " + STANDIN_SQL + f""",
f AS (SELECT contract_id, ARG_MIN(award_date, (award_date, supplier_id, buyer_id)) AS award_date FROM contracts_base WHERE {VALID} GROUP BY 1),
p AS (SELECT contract_id, ARG_MAX(risk_class, (ensemble_risk_prob, risk_class)) AS risk_class FROM preds GROUP BY 1)
SELECT contract_id, award_date, risk_class FROM f JOIN p USING (contract_id)""")
def j17_features_predictions(spark, sf_dir):
    """First feature row and riskiest prediction of each contract, joined one to one."""
    c = C(spark, sf_dir).where(VALID)
    f = joins.first_per_key(c, ["contract_id"], [F.col("award_date"), F.col("supplier_id"), F.col("buyer_id")])
    p = joins.first_per_key(rule_predictions(spark, sf_dir), ["contract_id"], [F.col("ensemble_risk_prob").desc(), F.col("risk_class").desc()])
    return f.select("contract_id", "award_date").join(p.select("contract_id", "risk_class"), "contract_id")


@register("j18_buyers_with_resilience", r6=("buyer_dependency_normalized", "single_bidder_rate", "amendment_rate", "top_share"),
          sql="WITH " + STANDIN_SQL + """,
shares AS (SELECT buyer_id, MAX(v) / SUM(v) AS top_share, COUNT(*) AS suppliers FROM s GROUP BY buyer_id)
SELECT buyer_metrics.*, top_share, suppliers FROM buyer_metrics LEFT JOIN shares USING (buyer_id)""")
def j18_buyers_with_resilience(spark, sf_dir):
    """Buyer metrics with the share of the top supplier and the number of suppliers."""
    c = C(spark, sf_dir)
    resilience = eco.buyer_dependency(c).select("buyer_id", F.col("buyer_dependency_ratio").alias("top_share"),
                                                F.col("buyer_supplier_count").alias("suppliers"))
    return ig.buyer_metrics(gov.network_features(c), resilience)


@register("b7_stratified_fallback", sql=f"""
WITH d AS (SELECT IF(bid_count <= 1, 1, 0) AS single, {SEEDED} AS k, {", ".join(ROW)} FROM contracts_base),
r AS (SELECT single, ROW_NUMBER() OVER (PARTITION BY single ORDER BY k, {", ".join(ROW)}) AS place, COUNT(*) OVER (PARTITION BY single) AS n FROM d)
SELECT single, IF(place <= FLOOR(n * 0.25 + 0.5), 'test', 'train') AS split, COUNT(*) AS rows FROM r GROUP BY ALL""")
def b7_stratified_fallback(spark, sf_dir):
    """The year windows 2030-2031 hold no rows, so a stratified seeded 75/25 split takes their place."""
    c = C(spark, sf_dir).withColumn("single", F.when(F.col("bid_count") <= 1, 1).otherwise(0))
    s = smp.temporal_or_stratified(c, "single", (1990, 2029), (2030, 2031), seed=42, key_cols=ROW)
    return s.groupBy("single", "split").agg(F.count(F.lit(1)).alias("rows"))


@register("f4_governance_published", r6=("buyer_dependency_ratio", "buyer_concentration_hhi", "single_bid_rate", "contract_value_log"),
          sql="WITH " + governance_sql("contract_id:focal_contract", Q11_SQL) + f""",
running AS (
    SELECT buyer_id, award_year, SUM(contract_value) OVER (PARTITION BY buyer_id, supplier_id ORDER BY {{0}} ROWS UNBOUNDED PRECEDING)
           / SUM(contract_value) OVER (PARTITION BY buyer_id ORDER BY {{0}} ROWS UNBOUNDED PRECEDING) AS share FROM valid),
row_hhi AS (SELECT buyer_id, award_year, SUM(share * share) AS hhi FROM running GROUP BY ALL),
kinds AS (SELECT contract_id, {procedure_risk_sql()} AS pr, {competition_risk_sql()} AS cr FROM contracts_base)
SELECT gov.* EXCLUDE (procedure_risk, competition_risk, buyer_concentration_hhi), kinds.pr AS procedure_risk,
       kinds.cr AS competition_risk, COALESCE(row_hhi.hhi, 0) AS buyer_concentration_hhi
FROM gov LEFT JOIN kinds USING (contract_id) LEFT JOIN row_hhi USING (buyer_id, award_year)"""
          .format("award_year, award_date, supplier_id, contract_id, contract_value"))
def f4_governance_published(spark, sf_dir):
    """F4 in its published form: history and competition joined on the non-unique contract id (rows fan out), row-level HHI."""
    return gov.governance_features(C(spark, sf_dir), parity=True)


@register("i03_integration_metrics")
def i03_integration_metrics(spark, sf_dir):
    """Counts, the two coverage-aware correlations, ANOVA F and chi-square over communities, with p-values."""
    return ig.integration_metrics(unified_rules(spark, sf_dir), communities(spark, sf_dir))


@register("t04_t05_p_values")
def t04_t05_p_values(spark, sf_dir):
    """The tests of the statistics queries with their p-values."""
    c = C(spark, sf_dir).withColumn("log_value", F.ln(F.greatest(F.col("contract_value"), F.lit(1.0)))) \
        .withColumn("single", F.when(F.col("bid_count") <= 1, 1).otherwise(0))
    return st.p_value_table(spark, st.anova_oneway(c, "cpv_division", "log_value"), st.chi2_independence(c, "cpv_division", "single"))
