"""Registered chart/viewer data queries and sampling/split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import competition_risk_sql, procedure_risk_sql
from ..operators import competition as comp
from ..operators import ecosystem as eco
from ..operators import pricing as pr
from ..operators import sampling as smp
from ..operators import views as vw
from ..operators.graph import build as gb
from .catalogue import BUYER_MASTER_SQL, C, PRICE_SQL
from .graph import EDGES_SQL, REGION_SQL, edges
from .integration import STANDIN_SQL, rule_predictions
from .registry import register

ROWKEY = ["contract_id", "supplier_id", "buyer_id", "award_date", "contract_value", "bid_count", "procedure_type",
          "cpv_division", "contract_amendments", "estimated_price"]
ROWKEY_SQL = ", ".join(ROWKEY)


@register("b1_year_stratified_panel", sql=f"""
SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY award_year ORDER BY md5(contract_id), {ROWKEY_SQL}) AS rn FROM contracts_base
    WHERE award_year BETWEEN 1995 AND 2001) WHERE rn <= 100000""")
def b1_year_stratified_panel(spark, sf_dir):
    """B1: at most 100,000 rows per award year, chosen by md5(contract id) (ties by the row's columns)."""
    c = C(spark, sf_dir).where(F.col("award_year").between(1995, 2001))
    return smp.year_stratified_cap(c, 100_000, tiebreak=ROWKEY)


@register("b3_seeded_sample_10k", sql=f"""
SELECT contract_id, supplier_id, final_price, bid_count FROM contracts_base
ORDER BY md5('42|' || {" || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in ['contract_id', 'supplier_id', 'buyer_id', 'award_date', 'final_price'])}),
         contract_id, supplier_id, buyer_id, award_date, final_price LIMIT 10000""")
def b3_seeded_sample_10k(spark, sf_dir):
    """Seeded 10,000-row sample of price vs bids (md5 order; the limit is the feature)."""
    keys = ["contract_id", "supplier_id", "buyer_id", "award_date", "final_price"]
    return smp.seeded_sample(C(spark, sf_dir), 10000, 42, keys).select("contract_id", "supplier_id", "final_price", "bid_count")


@register("b8_temporal_split_counts", sql="""
SELECT CASE WHEN award_year BETWEEN 1995 AND 1999 THEN 'train' WHEN award_year = 2000 THEN 'validation' ELSE 'test' END AS split,
       COUNT(*) AS rows, AVG(CASE WHEN procedure_type IN ('NEGOTIATED', 'RESTRICTED', 'OUTRIGHT_AWARD') THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_risky_procedure
FROM contracts_base WHERE award_year BETWEEN 1995 AND 2001 GROUP BY 1""", r6=("share_risky_procedure",))
def b8_temporal_split_counts(spark, sf_dir):
    """Train / validation / test rows of the temporal split."""
    s = smp.temporal_split(C(spark, sf_dir), (1995, 1999), (2000, 2000), (2001, 2001))
    risky = F.col("procedure_type").isin("NEGOTIATED", "RESTRICTED", "OUTRIGHT_AWARD")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                  F.avg(F.when(risky, 1.0).otherwise(0.0)).alias("share_risky_procedure"))


@register("g04_log10_value_histogram", sql="""
SELECT ROUND(FLOOR(LOG10(contract_value) / 0.1) * 0.1, 6) AS log10_bin, COUNT(*) AS n FROM contracts_base
WHERE contract_value > 0 GROUP BY 1""", r6=("log10_bin",))
def g04_log10_value_histogram(spark, sf_dir):
    """log10 contract-value histogram (0.1 bins)."""
    return vw.log10_histogram(C(spark, sf_dir), "contract_value")


@register("g06_buyer_spend_histogram", sql="""
SELECT ROUND(FLOOR(LOG10(s) / 0.1) * 0.1, 6) AS log10_bin, COUNT(*) AS n
FROM (SELECT buyer_id, SUM(contract_value) AS s FROM contracts_base GROUP BY buyer_id) WHERE s > 0 GROUP BY 1""", r6=("log10_bin",))
def g06_buyer_spend_histogram(spark, sf_dir):
    """log10 buyer-spend histogram."""
    spend = C(spark, sf_dir).groupBy("buyer_id").agg(F.sum("contract_value").alias("spend"))
    return vw.log10_histogram(spend, "spend")


@register("g07_dependency_at_risk", r6=("share_above",), sql="WITH " + BUYER_MASTER_SQL + """
SELECT COUNT(dependency_ratio) AS n, COUNT(*) FILTER (WHERE dependency_ratio > 0.5) AS above,
       COUNT(*) FILTER (WHERE dependency_ratio > 0.5) / COUNT(dependency_ratio) AS share_above FROM buyer_master""")
def g07_dependency_at_risk(spark, sf_dir):
    """Share of buyers with top-5 dependency above 0.5 (at risk)."""
    return vw.share_above(eco.buyer_ecosystem(C(spark, sf_dir)), "dependency_ratio", 0.5)


@register("g08_hhi_share_above", r6=("share_above",), sql="WITH " + BUYER_MASTER_SQL + """
SELECT COUNT(buyer_concentration_hhi) AS n, COUNT(*) FILTER (WHERE buyer_concentration_hhi > 0.25) AS above,
       COUNT(*) FILTER (WHERE buyer_concentration_hhi > 0.25) / COUNT(buyer_concentration_hhi) AS share_above FROM buyer_master""")
def g08_hhi_share_above(spark, sf_dir):
    """Share of buyers with HHI above 0.25."""
    return vw.share_above(eco.buyer_ecosystem(C(spark, sf_dir)), "buyer_concentration_hhi", 0.25)


@register("g10_supplier_count_histogram", r6=("log10_bin",), sql="""
SELECT ROUND(FLOOR(LOG10(n) / 0.1) * 0.1, 6) AS log10_bin, COUNT(*) AS n
FROM (SELECT supplier_id, COUNT(*) AS n FROM contracts_base WHERE supplier_id IS NOT NULL GROUP BY supplier_id) GROUP BY 1""")
def g10_supplier_count_histogram(spark, sf_dir):
    """log10 histogram of contracts per supplier."""
    cnt = C(spark, sf_dir).where(F.col("supplier_id").isNotNull()).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"))
    return vw.log10_histogram(cnt, "n")


@register("g14_bid_histogram", r6=("log10_bin",), sql="""
SELECT ROUND(FLOOR(LOG10(bid_count) / 0.1) * 0.1, 6) AS log10_bin, COUNT(*) AS n FROM contracts_base
WHERE bid_count > 0 GROUP BY 1""")
def g14_bid_histogram(spark, sf_dir):
    """log10 bid-count histogram."""
    return vw.log10_histogram(C(spark, sf_dir), "bid_count")


@register("g17_top_cpv_log_price_box", r6=("min", "q1", "median", "q3", "max"), sql="WITH " + PRICE_SQL + """,
top6 AS (SELECT cpv_division FROM rq3_features GROUP BY cpv_division ORDER BY COUNT(*) DESC, cpv_division LIMIT 6)
SELECT cpv_division, COUNT(*) AS n, MIN(log_price) AS min, QUANTILE_CONT(log_price, 0.25) AS q1,
       MEDIAN(log_price) AS median, QUANTILE_CONT(log_price, 0.75) AS q3, MAX(log_price) AS max
FROM rq3_features WHERE cpv_division IN (SELECT cpv_division FROM top6) GROUP BY cpv_division""")
def g17_top_cpv_log_price_box(spark, sf_dir):
    """Log-price box statistics for the 6 largest CPV divisions."""
    f = pr.price_proxy(C(spark, sf_dir))
    top6 = (f.groupBy("cpv_division").agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), "cpv_division").limit(6).select("cpv_division"))
    return vw.box_stats(f.join(top6, "cpv_division", "left_semi"), "cpv_division", "log_price")


@register("g19_risk_by_procedure_buyer_type", r6=("mean_competition_risk",), sql="""
SELECT procedure_type,
       CASE WHEN regexp_matches(buyer_name, 'comune|municipio', 'i') THEN 'Local Authority / Municipality'
            WHEN regexp_matches(buyer_name, 'ministero', 'i') THEN 'Ministry / Central Gov'
            WHEN regexp_matches(buyer_name, 'azienda|asl|sanitar|ospedal', 'i') THEN 'Health Authority'
            WHEN regexp_matches(buyer_name, 'universit|scuola|istituto', 'i') THEN 'Education / Research'
            WHEN regexp_matches(buyer_name, 'provincia|regione', 'i') THEN 'Regional / Provincial Gov'
            ELSE 'Other Public Body' END AS buyer_type,
       AVG(""" + competition_risk_sql() + """) AS mean_competition_risk, COUNT(*) AS contracts
FROM contracts_base GROUP BY 1, 2""")
def g19_risk_by_procedure_buyer_type(spark, sf_dir):
    """Mean competition risk by procedure × buyer type (long form of the pivot)."""
    c = C(spark, sf_dir).withColumn("buyer_type", comp.buyer_type())
    # the competition ladder is evaluated beside each contract row (no join on the non-unique contract id)
    from ..functions.rules import competition_risk
    return (c.withColumn("competition_risk", competition_risk()).groupBy("procedure_type", "buyer_type")
            .agg(F.avg("competition_risk").alias("mean_competition_risk"), F.count(F.lit(1)).alias("contracts")))


@register("n04_dependency_ratio_2dp", sql="WITH " + BUYER_MASTER_SQL + """
SELECT ROUND(dependency_ratio, 2) AS dependency_ratio, COUNT(*) AS buyers FROM buyer_master WHERE buyer_total > 0 GROUP BY 1""",
          r6=("dependency_ratio",))
def n04_dependency_ratio_2dp(spark, sf_dir):
    """Distribution of the top-5 dependency ratio rounded to 2 dp."""
    b = eco.buyer_ecosystem(C(spark, sf_dir)).where(F.col("buyer_total") > 0)
    return b.groupBy(F.round("dependency_ratio", 2).alias("dependency_ratio")).agg(F.count(F.lit(1)).alias("buyers"))


@register("v21_degree_ccdf", r6=("ccdf",), sql="WITH " + EDGES_SQL + """,
deg AS (SELECT CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 'buyer' ELSE 'supplier' END AS node_type, node_id, COUNT(*) AS degree
        FROM inc GROUP BY node_id),
g AS (SELECT node_type, degree, COUNT(*) AS n FROM deg GROUP BY 1, 2)
SELECT node_type, degree, n, SUM(n) OVER (PARTITION BY node_type ORDER BY degree DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       / SUM(n) OVER (PARTITION BY node_type) AS ccdf FROM g""")
def v21_degree_ccdf(spark, sf_dir):
    """Degree CCDF per node type."""
    return vw.degree_ccdf(gb.node_metrics(edges(spark, sf_dir)))


@register("v22_hub_concentration", r6=("top_decile_share", "top_decile_to_mean"), sql="WITH " + EDGES_SQL + """,
deg AS (SELECT node_id, COUNT(*) AS degree FROM inc GROUP BY node_id),
n_all AS (SELECT COUNT(*) AS n FROM deg),
s AS (SELECT node_id, degree / (n - 1) AS v FROM deg, n_all WHERE node_id LIKE 'S\\_%' ESCAPE '\\'),
r AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v DESC, node_id) AS pos, COUNT(*) OVER () AS n, SUM(v) OVER () AS tot,
             AVG(v) OVER () AS mean FROM s)
SELECT MAX(n) AS nodes, SUM(v) / MAX(tot) AS top_decile_share, AVG(v) / MAX(mean) AS top_decile_to_mean
FROM r WHERE pos <= FLOOR(n / 10)""")
def v22_hub_concentration(spark, sf_dir):
    """Top-decile share of supplier degree centrality."""
    return vw.hub_concentration(gb.node_metrics(edges(spark, sf_dir)))


@register("v24_region_amendment_rates", r6=("amendment_rate", "zero_amendment_base_rate"), sql="""
WITH g AS (SELECT buyer_region, COUNT(*) AS n, AVG(CAST(contract_amendments > 0 AS DOUBLE)) AS amendment_rate
           FROM contracts_base WHERE buyer_region <> 'IT' GROUP BY buyer_region HAVING COUNT(*) >= 5),
b AS (SELECT AVG(CAST(contract_amendments = 0 AS DOUBLE)) AS zero_amendment_base_rate FROM contracts_base)
SELECT * FROM g, b""")
def v24_region_amendment_rates(spark, sf_dir):
    """Amendment rate per buyer region (n >= 5) and the zero-amendment base rate."""
    return vw.region_amendment_rates(C(spark, sf_dir))


@register("v14_risk_table", sql="WITH " + STANDIN_SQL + """
SELECT * FROM preds WHERE contains(contract_id, '7') OR contains(buyer_id, '7') OR contains(supplier_id, '7')
ORDER BY ensemble_risk_prob DESC, contract_id, supplier_id, buyer_id LIMIT 300""")
def v14_risk_table(spark, sf_dir):
    """Risk table filtered by a literal id search ('7'), top 300 by probability."""
    return vw.risk_table(rule_predictions(spark, sf_dir), search="7", top=300)


@register("v13_value_risk_deciles", r6=("mean_risk", "log_value_min", "log_value_max"), sql="""
WITH p AS (
    SELECT contract_id, supplier_id, buyer_id, LOG10(GREATEST(contract_value, 1.0)) AS lv,
        """ + procedure_risk_sql() + """ AS r
    FROM contracts_base WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0),
d AS (SELECT *, NTILE(10) OVER (ORDER BY lv, contract_id, supplier_id, buyer_id) AS decile FROM p)
SELECT decile, COUNT(*) AS contracts, AVG(r) AS mean_risk, MIN(lv) AS log_value_min, MAX(lv) AS log_value_max
FROM d GROUP BY decile""")
def v13_value_risk_deciles(spark, sf_dir):
    """Mean risk per log-value decile (NTILE 10)."""
    c = C(spark, sf_dir).where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull() & (F.col("contract_value") > 0))
    from ..functions.rules import procedure_risk
    p = c.select("contract_id", "supplier_id", "buyer_id", "contract_value", procedure_risk().alias("ensemble_risk_prob"))
    return vw.value_risk_deciles(p)


@register("v23_inter_community_matrix", r6=("intensity",), sql="WITH " + EDGES_SQL + ",\n" + REGION_SQL + """,
sizes AS (SELECT community_id, COUNT(*) AS n FROM region_part GROUP BY 1),
topc AS (SELECT community_id FROM sizes ORDER BY n DESC, community_id LIMIT 25),
pt AS (SELECT * FROM region_part WHERE community_id IN (SELECT community_id FROM topc)),
m AS (SELECT LEAST(a.community_id, b.community_id) AS community_a, GREATEST(a.community_id, b.community_id) AS community_b,
             SUM(e.contracts) AS contracts
      FROM edges e JOIN pt a ON e.src = a.node_id JOIN pt b ON e.dst = b.node_id GROUP BY 1, 2)
SELECT community_a, community_b, contracts::BIGINT AS contracts, LN(1 + contracts) / MAX(LN(1 + contracts)) OVER () AS intensity FROM m""")
def v23_inter_community_matrix(spark, sf_dir):
    """Contracts between the 25 largest (region) communities, log1p and max-normalised."""
    c = C(spark, sf_dir)
    return vw.inter_community_matrix(gb.bipartite_edges(c), gb.region_partition(c))


@register("v27_risk_dependency_fit", r6=("slope", "intercept", "r2"), sql="WITH " + STANDIN_SQL + """
SELECT REGR_SLOPE(p.ensemble_risk_prob, b.buyer_dependency_normalized) AS slope,
       REGR_INTERCEPT(p.ensemble_risk_prob, b.buyer_dependency_normalized) AS intercept,
       REGR_R2(p.ensemble_risk_prob, b.buyer_dependency_normalized) AS r2,
       REGR_COUNT(p.ensemble_risk_prob, b.buyer_dependency_normalized) AS n
FROM preds p JOIN buyer_metrics b USING (buyer_id)""")
def v27_risk_dependency_fit(spark, sf_dir):
    """Linear fit of risk on buyer dependency."""
    from .integration import buyers
    return vw.linear_fit(rule_predictions(spark, sf_dir).join(buyers(spark, sf_dir), "buyer_id"),
                         "ensemble_risk_prob", "buyer_dependency_normalized")


# ---- more sampling / model-evaluation / graph viewer queries ---------------------

@register("t16_price_baseline_rmse", r6=("rmse_model", "rmse_baseline", "rmse_reduction", "r2"), sql="WITH " + PRICE_SQL + """,
med AS (SELECT cpv_division, MEDIAN(log_price) AS gm FROM rq3_features GROUP BY 1),
glob_m AS (SELECT MEDIAN(log_price) AS g, AVG(log_price) AS mean FROM rq3_features),
j AS (SELECT f.log_price AS y, f.log_estimated_price AS p, COALESCE(m.gm, g) AS base, mean FROM rq3_features f
      LEFT JOIN med m USING (cpv_division), glob_m)
SELECT SQRT(AVG((y - p) * (y - p))) AS rmse_model, SQRT(AVG((y - base) * (y - base))) AS rmse_baseline,
       1 - SQRT(AVG((y - p) * (y - p))) / SQRT(AVG((y - base) * (y - base))) AS rmse_reduction,
       1 - SUM((y - p) * (y - p)) / SUM((y - mean) * (y - mean)) AS r2 FROM j""")
def t16_price_baseline_rmse(spark, sf_dir):
    """RMSE of a price predictor (here the log estimate) vs the CPV-median baseline, and R²."""
    f = pr.price_proxy(C(spark, sf_dir))
    return pr.median_baseline_rmse(f, "cpv_division", "log_price", "log_estimated_price")


@register("b4_class_balanced_sample", sql=f"""
WITH d AS (SELECT *, CASE WHEN bid_count <= 1 THEN 1 ELSE 0 END AS single FROM contracts_base),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY single ORDER BY md5('42|' || contract_id || '|' || supplier_id || '|' || CAST(award_date AS VARCHAR)),
                                   contract_id, supplier_id, award_date) AS rn FROM d),
pos AS (SELECT * FROM r WHERE single >= 1 AND rn <= 2000),
neg AS (SELECT * FROM r WHERE single < 1 AND rn <= 4000 - (SELECT COUNT(*) FROM pos))
SELECT single, COUNT(*) AS rows, COUNT(DISTINCT contract_id) AS contracts FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) GROUP BY single""")
def b4_class_balanced_sample(spark, sf_dir):
    """Up to n/2 positives (single bid), the rest negatives, md5-seeded; counts per class (n = 4000)."""
    c = C(spark, sf_dir).withColumn("single", F.when(F.col("bid_count") <= 1, 1).otherwise(0))
    keyed = c.withColumn("_k", F.concat_ws("|", F.col("contract_id"), F.col("supplier_id"), F.col("award_date").cast("string")))
    s = smp.class_balanced_sample(keyed, "single", 4000, 42, ["contract_id", "supplier_id", "award_date"])
    return s.groupBy("single").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("contract_id").alias("contracts"))


@register("b6_hash_split_counts")
def b6_hash_split_counts(spark, sf_dir):
    """Deterministic 75/25 hash split (xxhash64 of the row key), rows per split."""
    s = smp.hash_split(C(spark, sf_dir), ["contract_id", "supplier_id", "award_date"], 25, 42)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register("b10_stratified_folds", sql=f"""
WITH d AS (SELECT *, CASE WHEN bid_count <= 1 THEN 1 ELSE 0 END AS single FROM contracts_base),
f AS (SELECT single, (ROW_NUMBER() OVER (PARTITION BY single ORDER BY md5('42|' || contract_id || '|' || supplier_id || '|' || CAST(award_date AS VARCHAR)),
                                         contract_id, supplier_id, award_date) - 1) % 5 AS fold FROM d)
SELECT single, CAST(fold AS INTEGER) AS fold, COUNT(*) AS rows FROM f GROUP BY 1, 2""")
def b10_stratified_folds(spark, sf_dir):
    """5 stratified folds (round-robin within class in md5 order), rows per (class, fold)."""
    c = C(spark, sf_dir).withColumn("single", F.when(F.col("bid_count") <= 1, 1).otherwise(0))
    f = smp.stratified_folds(c, "single", 5, 42, ["contract_id", "supplier_id", "award_date"])
    return f.groupBy("single", "fold").agg(F.count(F.lit(1)).alias("rows"))


@register("v09_community_sizes", sql="WITH " + REGION_SQL + """
SELECT community_id, COUNT(*) AS nodes FROM region_part GROUP BY 1 ORDER BY nodes DESC, community_id LIMIT 12""")
def v09_community_sizes(spark, sf_dir):
    """The 12 largest communities (region partition)."""
    p = gb.region_partition(C(spark, sf_dir))
    return p.groupBy("community_id").agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.col("nodes").desc(), "community_id").limit(12)


@register("v12_top_nodes_by_degree", sql="WITH " + EDGES_SQL + """,
deg AS (SELECT node_id, CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 'buyer' ELSE 'supplier' END AS node_type,
               COUNT(*) AS degree FROM inc GROUP BY node_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY node_type ORDER BY degree DESC, node_id) AS rn FROM deg)
SELECT node_id, node_type, degree, rn AS rank FROM r WHERE rn <= 10""")
def v12_top_nodes_by_degree(spark, sf_dir):
    """Top 10 nodes by degree per node type (skew-safe top-k)."""
    from ..operators.common import top_k_per_group
    m = gb.node_metrics(edges(spark, sf_dir)).select("node_id", "node_type", "degree")
    return top_k_per_group(m, ["node_type"], [F.col("degree").desc(), F.col("node_id")], 10, rank_col="rank",
                           salt_col="node_id").select("node_id", "node_type", "degree", F.col("rank").cast("long").alias("rank"))


@register("v10_community_edges", r4=("weight",), sql="WITH " + EDGES_SQL + ",\n" + REGION_SQL + """,
top1 AS (SELECT community_id FROM region_part GROUP BY 1 ORDER BY COUNT(*) DESC, community_id LIMIT 1),
mem AS (SELECT node_id FROM region_part WHERE community_id IN (SELECT community_id FROM top1))
SELECT src, dst, weight, contracts FROM edges WHERE src IN (SELECT node_id FROM mem) OR dst IN (SELECT node_id FROM mem)
ORDER BY weight DESC, src, dst LIMIT 150""")
def v10_community_edges(spark, sf_dir):
    """Edges with an end in the largest community, first 150 by weight."""
    c = C(spark, sf_dir)
    p = gb.region_partition(c)
    top1 = p.groupBy("community_id").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "community_id").limit(1)
    mem = p.join(top1.select("community_id"), "community_id", "left_semi").select("node_id")
    e = gb.bipartite_edges(c)
    tagged = e
    for end in ("src", "dst"):
        tagged = tagged.join(mem.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    e = tagged.where(F.col("_src").isNotNull() | F.col("_dst").isNotNull())
    return e.orderBy(F.col("weight").desc(), "src", "dst").limit(150).select("src", "dst", "weight", "contracts")


@register("r23_neighbourhood", sql="WITH " + EDGES_SQL + """,
w AS (SELECT node_id, SUM(weight) AS exposure FROM inc GROUP BY node_id),
seed AS (SELECT node_id FROM w ORDER BY exposure DESC, node_id LIMIT 1),
cand AS (SELECT node_id, MIN(s) AS s FROM (SELECT node_id, 0 AS s FROM seed UNION ALL
         SELECT other, 1 FROM inc WHERE node_id IN (SELECT node_id FROM seed)) GROUP BY node_id)
SELECT node_id FROM cand JOIN w USING (node_id) ORDER BY s, exposure DESC, node_id LIMIT 150""")
def r23_neighbourhood(spark, sf_dir):
    """The heaviest node and its 1-hop neighbours, capped at 150 by exposure (seed first)."""
    return _neighbourhood(spark, sf_dir)[0]


def _neighbourhood(spark, sf_dir):
    e = edges(spark, sf_dir)
    w = gb.incidence(e).groupBy("node_id").agg(F.sum("weight").alias("exposure"))
    seed = w.orderBy(F.col("exposure").desc(), "node_id").limit(1).select("node_id")
    return gb.neighbourhood(e, seed, w, cap=150)


@register("r23_neighbourhood_links", r4=("weight",), sql="WITH " + EDGES_SQL + """,
heavy AS (SELECT node_id, SUM(weight) AS exposure FROM inc GROUP BY node_id),
top AS (SELECT ARG_MAX(node_id, (exposure, node_id)) AS node_id FROM heavy WHERE exposure = (SELECT MAX(exposure) FROM heavy)),
around AS (SELECT DISTINCT other AS node_id FROM inc WHERE node_id IN (FROM top)),
kept AS (SELECT node_id FROM around JOIN heavy USING (node_id) WHERE node_id NOT IN (FROM top)
         ORDER BY exposure DESC, node_id LIMIT 149)
SELECT src, dst, weight, contracts FROM edges
WHERE src IN (FROM top UNION ALL FROM kept) AND dst IN (FROM top UNION ALL FROM kept)""")
def r23_neighbourhood_links(spark, sf_dir):
    """The edges inside the neighbourhood of the heaviest node."""
    return _neighbourhood(spark, sf_dir)[1].select("src", "dst", "weight", "contracts")


@register("r16_buyer_dominant_cpv", sql="""
WITH c AS (SELECT buyer_id, cpv_division, COUNT(*) AS n FROM contracts_base WHERE buyer_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY n DESC, cpv_division) AS rn FROM c)
SELECT buyer_id, cpv_division AS dominant_cpv, n AS contracts_in_cpv FROM r WHERE rn = 1""")
def r16_buyer_dominant_cpv(spark, sf_dir):
    """Each buyer's modal CPV division (ties: smallest code), via a skew-safe top-1."""
    from ..operators.common import top_k_per_group
    c = C(spark, sf_dir).where(F.col("buyer_id").isNotNull()).groupBy("buyer_id", "cpv_division") \
        .agg(F.count(F.lit(1)).alias("n"))
    t = top_k_per_group(c, ["buyer_id"], [F.col("n").desc(), F.col("cpv_division")], 1, salt_col="cpv_division")
    return t.select("buyer_id", F.col("cpv_division").alias("dominant_cpv"), F.col("n").alias("contracts_in_cpv"))


@register("r16_sample_coverage")
def r16_sample_coverage(spark, sf_dir):
    """Edges, nodes and value retained by the 35 % decile sample; giant share of sample vs full; 0.10 gate."""
    from ..operators.graph import iterative as gi
    # both are read several times: counts, sample and component rounds
    e = gi.materialize(edges(spark, sf_dir))
    s = gi.materialize(smp.value_stratified_edge_sample(e, 0.35, 42))
    f = e.agg(F.count(F.lit(1)).alias("e"), F.sum("weight").alias("v")).first()
    m = s.agg(F.count(F.lit(1)).alias("e"), F.sum("weight").alias("v")).first()
    # every node of an edge is in one component
    full, samp = (gi.component_summary(gi.connected_components(x)).first() for x in (e, s))
    n_full, n_samp, g_full, g_samp = full["nodes"], samp["nodes"], full["giant_share"], samp["giant_share"]
    row = (m["e"] / f["e"], n_samp / n_full, m["v"] / f["v"], float(g_full), float(g_samp),
           abs(float(g_full) - float(g_samp)) <= 0.10)
    return spark.createDataFrame([row], "edge_retained double, node_retained double, value_retained double, "
                                        "giant_share_full double, giant_share_sample double, gate_pass boolean")


@register("a13_eda_sql_over_views", r6=("widest_hhi",), r4=("value_of_class",), sql="WITH " + BUYER_MASTER_SQL + """,
classed AS (SELECT dependency_class, buyer_total, buyer_concentration_hhi, supplier_count FROM buyer_master WHERE supplier_count > 1)
SELECT dependency_class, SUM(buyer_total) AS value_of_class, MAX(buyer_concentration_hhi) AS widest_hhi,
       MAX(supplier_count) AS most_suppliers FROM classed GROUP BY dependency_class""")
def a13_eda_sql_over_views(spark, sf_dir):
    """An EDA SQL text run by spark.sql over the curated-view registry: value, concentration and breadth of each
    dependency class among buyers with several suppliers."""
    from ..sources.views import register_curated_views
    register_curated_views(spark, C(spark, sf_dir), 1990, 2026)
    return spark.sql("SELECT dependency_class, sum(buyer_total) AS value_of_class, max(buyer_concentration_hhi) AS widest_hhi, "
                     "max(supplier_count) AS most_suppliers FROM buyer_master WHERE supplier_count > 1 GROUP BY dependency_class")


@register("c10_cascading_high_risk_buyers", sql="WITH " + STANDIN_SQL + """
SELECT DISTINCT buyer_id FROM preds WHERE risk_class = 'HIGH' AND award_year BETWEEN 1996 AND 2000""")
def c10_cascading_high_risk_buyers(spark, sf_dir):
    """Year-range filter, then distinct sorted buyers with at least one HIGH-risk row."""
    from ..operators import filters as flt
    p = flt.apply_risk_filter(flt.apply_common_filters(rule_predictions(spark, sf_dir), year_range=(1996, 2000)), None)
    return flt.cascading_options(p, "buyer_id")


@register("v07_conductance_histogram", sql="WITH " + EDGES_SQL + ",\n" + REGION_SQL + """,
per AS (SELECT p.community_id, COUNT(*) AS vol, COUNT(*) FILTER (WHERE p.community_id != q.community_id) AS cut
        FROM inc i JOIN region_part p ON i.node_id = p.node_id JOIN region_part q ON i.other = q.node_id GROUP BY 1),
tot AS (SELECT 2 * COUNT(*) AS v FROM edges),
c AS (SELECT cut / LEAST(vol, v - vol)::DOUBLE AS conductance FROM per, tot WHERE LEAST(vol, v - vol) > 0)
SELECT CAST(LEAST(GREATEST(FLOOR((conductance - 0.0) / 0.1), 0), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM c GROUP BY 1""")
def v07_conductance_histogram(spark, sf_dir):
    """10-bin histogram of community conductance (region partition)."""
    from ..operators.graph import metrics as gm
    c = C(spark, sf_dir)
    return vw.width_histogram(gm.conductance(gb.bipartite_edges(c), gb.region_partition(c)), "conductance", 0.0, 1.0, 10)


@register("v07_centrality_histogram", sql="WITH " + EDGES_SQL + """,
deg AS (SELECT node_id, COUNT(*) AS degree, SUM(weight) AS wd FROM inc GROUP BY node_id),
mx AS (SELECT GREATEST(MAX(degree)::DOUBLE, 1.0) AS md, GREATEST(MAX(wd), 1.0) AS mw FROM deg),
c AS (SELECT CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 'buyer' ELSE 'supplier' END AS node_type,
             0.6 * degree / md + 0.4 * wd / mw AS centrality FROM deg, mx)
SELECT node_type, CAST(LEAST(GREATEST(FLOOR(centrality / 0.05), 0), 19) AS INTEGER) AS bin, COUNT(*) AS n FROM c GROUP BY 1, 2""")
def v07_centrality_histogram(spark, sf_dir):
    """20-bin centrality histogram per node type."""
    return vw.width_histogram(gb.sql_centrality(edges(spark, sf_dir)), "centrality", 0.0, 1.0, 20, group="node_type")


@register("v15_explanations", sql="WITH " + STANDIN_SQL + """
SELECT contract_id, supplier_id, buyer_id, ensemble_risk_prob,
       CONCAT_WS('; ', CASE WHEN regexp_matches(procedure_type, 'NEGOTIATED|OUTRIGHT', 'i') THEN 'non-open procedure' END,
                       CASE WHEN bid_count <= 1 THEN 'single bid' END,
                       CASE WHEN contract_amendments > 2 THEN 'many amendments' END,
                       CASE WHEN ensemble_risk_prob >= 0.75 THEN 'high predicted risk' END) AS explanation
FROM preds""")
def v15_explanations(spark, sf_dir):
    """Per-row explanation text from the rule factors present."""
    return vw.explanation_text(rule_predictions(spark, sf_dir))


@register("k07_expectation_bands")
def k07_expectation_bands(spark, sf_dir):
    """Numeric bands computed from the data (rule consensus rate 4-8 %, unified risk in [0, 1],
    at-risk buyers 20-45 %, hub ratio > 5) as an expectation table with PASS/FAIL."""
    from ..operators import audit as au
    from .integration import rule_anomalies, unified_rules
    rate = rule_anomalies(spark, sf_dir).agg(F.avg(F.col("consensus_flag").cast("double"))).first()[0]
    u = unified_rules(spark, sf_dir).agg(F.min("unified_risk_score"), F.max("unified_risk_score")).first()
    at_risk = vw.share_above(eco.buyer_ecosystem(C(spark, sf_dir)), "dependency_ratio", 0.5).first()["share_above"]
    hub = vw.hub_concentration(gb.node_metrics(edges(spark, sf_dir))).first()["top_decile_to_mean"]
    return au.expectation_table(spark, [
        ("consensus_rate", float(rate or 0.0), 0.04, 0.08), ("unified_min", float(u[0]), 0.0, 1.0),
        ("unified_max", float(u[1]), 0.0, 1.0), ("at_risk_buyer_share", float(at_risk or 0.0), 0.20, 0.45),
        ("hub_ratio", float(hub or 0.0), 5.0, float("inf"))])


@register("v26_predicted_vs_actual")
def v26_predicted_vs_actual(spark, sf_dir):
    """Predicted vs actual log price of the market model (actual = predicted + residual)."""
    from .ml import price_residuals
    f = price_residuals(spark, sf_dir)
    return f.select("contract_id", "predicted_log_price", (F.col("predicted_log_price") + F.col("gb_residual")).alias("actual_log_price"),
                    "residual_source")
