"""Registered statistics over columns of the contract view and the governance table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from .catalogue import C
from .features import F4_SQL, features
from .registry import register


@register("t01_coverage_corr_bids_value", r6=("value", "coverage_fraction", "observed_value"), sql="""
WITH p AS (SELECT bid_count AS a, contract_value AS b FROM contracts_base
           WHERE bid_count IS NOT NULL AND NOT isnan(bid_count) AND contract_value IS NOT NULL AND NOT isnan(contract_value)),
s AS (SELECT COUNT(*) AS n_paired, MIN(a) = MAX(a) OR MIN(b) = MAX(b) AS const, CORR(a, b) AS r FROM p),
t AS (SELECT COUNT(*) AS n_total FROM contracts_base)
SELECT CASE WHEN n_paired < 3 THEN NULL WHEN const THEN 0.0 WHEN n_paired * 2 < n_total THEN NULL ELSE r END AS value,
       CASE WHEN n_paired < 3 THEN 'degenerate_low_coverage' WHEN const THEN 'measured_null'
            WHEN n_paired * 2 < n_total THEN 'degenerate_low_coverage' ELSE 'computed' END AS status,
       n_paired, n_total, n_paired / n_total AS coverage_fraction,
       CASE WHEN n_paired < 3 THEN NULL WHEN const THEN 0.0 ELSE r END AS observed_value
FROM s, t""")
def t01_coverage_corr_bids_value(spark, sf_dir):
    """Coverage-aware Pearson of bid count vs contract value."""
    return st.coverage_aware_corr(C(spark, sf_dir), "bid_count", "contract_value")


@register("t02_safe_corr_amend_value", r6=("corr",), sql="""
WITH p AS (SELECT COALESCE(contract_amendments, 0) AS a, COALESCE(contract_value, 0) AS b FROM contracts_base)
SELECT CASE WHEN COUNT(*) < 3 OR MIN(a) = MAX(a) OR MIN(b) = MAX(b) THEN 0.0 ELSE CORR(a, b) END AS corr FROM p""")
def t02_safe_corr_amend_value(spark, sf_dir):
    """Null-to-zero Pearson of amendments vs value."""
    return st.safe_corr(C(spark, sf_dir), "contract_amendments", "contract_value")


@register("t03_pearson_spearman_bids_value", r6=("pearson", "spearman"), sql="""
WITH d AS (SELECT bid_count AS a, contract_value AS b FROM contracts_base WHERE bid_count IS NOT NULL AND contract_value IS NOT NULL),
r AS (SELECT a, b, RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             RANK() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM d),
o AS (SELECT CORR(a, b) AS pearson, CORR(ra, rb) AS spearman FROM r)
SELECT pearson, spearman,
       CASE WHEN GREATEST(ABS(COALESCE(pearson, 0)), ABS(COALESCE(spearman, 0))) > 0.95 THEN 'critical'
            WHEN GREATEST(ABS(COALESCE(pearson, 0)), ABS(COALESCE(spearman, 0))) > 0.70 THEN 'suspicious' ELSE 'ok' END AS flag
FROM o""")
def t03_pearson_spearman_bids_value(spark, sf_dir):
    """Pearson and Spearman of bid count vs value, with leakage flags."""
    return st.pearson_spearman(C(spark, sf_dir), "bid_count", "contract_value")


@register("t04_anova_value_by_cpv", r6=("ssb", "ssw", "f_stat", "eta_squared", "correlation_ratio"), sql="""
WITH d AS (SELECT cpv_division AS g, LN(GREATEST(contract_value, 1)) AS x FROM contracts_base),
g AS (SELECT g, COUNT(*) AS n, SUM(x) AS s, AVG(x) AS m FROM d GROUP BY g HAVING COUNT(*) >= 10),
t AS (SELECT SUM(n) AS n_all, SUM(s) / SUM(n) AS gm, COUNT(*) AS k FROM g),
w AS (SELECT SUM((d.x - g.m) * (d.x - g.m)) AS ssw FROM d JOIN g USING (g)),
b AS (SELECT SUM(n * (m - gm) * (m - gm)) AS ssb FROM g, t)
SELECT k AS groups, n_all::BIGINT AS n, ssb, ssw, (ssb / (k - 1)) / (ssw / (n_all - k)) AS f_stat,
       ssb / (ssb + ssw) AS eta_squared, SQRT(ssb / (ssb + ssw)) AS correlation_ratio
FROM t, w, b""")
def t04_anova_value_by_cpv(spark, sf_dir):
    """One-way ANOVA of log value across CPV divisions, η² and η."""
    c = C(spark, sf_dir).withColumn("log_value", F.ln(F.greatest(F.col("contract_value"), F.lit(1.0))))
    return st.anova_oneway(c, "cpv_division", "log_value")


@register("t05_chi2_cpv_single_bid", r6=("chi2", "cramers_v"), sql="""
WITH d AS (SELECT cpv_division AS r, CASE WHEN bid_count <= 1 THEN 1 ELSE 0 END AS c FROM contracts_base),
cnt AS (SELECT r, c, COUNT(*) AS o FROM d GROUP BY r, c),
rs AS (SELECT r, SUM(o) AS rt FROM cnt GROUP BY r HAVING SUM(o) >= 5),
cnt2 AS (SELECT cnt.* FROM cnt JOIN rs USING (r)),
cs AS (SELECT c, SUM(o) AS ct FROM cnt2 GROUP BY c),
nn AS (SELECT SUM(rt) AS n, COUNT(*) AS nr FROM rs), nc AS (SELECT COUNT(*) AS ncols FROM cs),
cells AS (SELECT r, c, rt * ct / n AS e, o FROM (SELECT rs.r, cs.c, rs.rt, cs.ct FROM rs, cs) x
          LEFT JOIN cnt2 USING (r, c), nn)
SELECT SUM((COALESCE(o, 0) - e) * (COALESCE(o, 0) - e) / e) AS chi2, (MAX(nr) - 1) * (MAX(ncols) - 1) AS dof,
       MAX(n)::BIGINT AS n, SQRT(SUM((COALESCE(o, 0) - e) * (COALESCE(o, 0) - e) / e) / (MAX(n) * (LEAST(MAX(nr), MAX(ncols)) - 1))) AS cramers_v
FROM cells, nn, nc""")
def t05_chi2_cpv_single_bid(spark, sf_dir):
    """χ² independence of CPV division and the single-bid flag, Cramér's V."""
    c = C(spark, sf_dir).withColumn("single", F.when(F.col("bid_count") <= 1, 1).otherwise(0))
    return st.chi2_independence(c, "cpv_division", "single")


AUC_SQL = F4_SQL + """,
d AS (SELECT CASE WHEN risk_label >= 1 THEN 1 ELSE 0 END AS y, contract_value_log AS s FROM gov),
sc AS (SELECT s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg FROM d GROUP BY s),
roc_cum AS (SELECT s, pos, neg, SUM(pos) OVER (ORDER BY s DESC) AS tp, SUM(neg) OVER (ORDER BY s DESC) AS fp FROM sc),
tot AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM sc)"""


@register("t14_roc_pr_auc", r6=("roc_auc", "average_precision"), sql=AUC_SQL + """
SELECT p::BIGINT AS positives, n::BIGINT AS negatives,
       SUM((fp - (fp - neg)) * (tp + (tp - pos)) / 2.0) / (p * n) AS roc_auc,
       SUM(pos / p * (tp / (tp + fp))) AS average_precision
FROM roc_cum, tot GROUP BY p, n""")
def t14_roc_pr_auc(spark, sf_dir):
    """ROC-AUC and average precision of the log-value score for label >= 1."""
    f = features(spark, sf_dir).withColumn("y", (F.col("risk_label") >= 1).cast("int"))
    return st.roc_pr_auc(f, "y", "contract_value_log")


@register("t15_best_f1_threshold", r6=("threshold", "f1"), sql=AUC_SQL + """,
f AS (SELECT s, 2.0 * tp / (tp + fp + p) AS f1 FROM roc_cum, tot)
SELECT s AS threshold, f1 FROM f ORDER BY f1 DESC, s ASC LIMIT 1""")
def t15_best_f1_threshold(spark, sf_dir):
    """F1-maximising threshold of the log-value score (ties: lowest)."""
    f = features(spark, sf_dir).withColumn("y", (F.col("risk_label") >= 1).cast("int"))
    return st.best_f1_threshold(f, "y", "contract_value_log")


@register("t14_threshold_metrics", r6=("precision", "recall", "f1"), sql=F4_SQL + """,
d AS (SELECT CASE WHEN risk_label >= 1 THEN 1 ELSE 0 END AS y, procedure_risk >= 0.5 AS p FROM gov),
o AS (SELECT COUNT(*) FILTER (WHERE p AND y = 1) AS tp, COUNT(*) FILTER (WHERE p AND y <> 1) AS fp,
             COUNT(*) FILTER (WHERE NOT p AND y = 1) AS fn, COUNT(*) FILTER (WHERE NOT p AND y <> 1) AS tn FROM d)
SELECT tp, fp, fn, tn, COALESCE(tp / NULLIF(tp + fp, 0), 0.0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS recall,
       COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1 FROM o""")
def t14_threshold_metrics(spark, sf_dir):
    """Confusion matrix, precision, recall, F1 of procedure_risk >= 0.5 for label >= 1."""
    f = features(spark, sf_dir).withColumn("y", (F.col("risk_label") >= 1).cast("int"))
    return st.threshold_metrics(f, "y", "procedure_risk", 0.5)


@register("v25_calibration_curve", r6=("mean_score", "positive_rate"), sql=F4_SQL + """
SELECT CAST(LEAST(FLOOR(procedure_risk * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, AVG(procedure_risk) AS mean_score,
       AVG(CASE WHEN risk_label >= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS positive_rate
FROM gov GROUP BY 1""")
def v25_calibration_curve(spark, sf_dir):
    """10-bin calibration of procedure_risk against label >= 1."""
    f = features(spark, sf_dir).withColumn("y", (F.col("risk_label") >= 1).cast("int"))
    return st.calibration_curve(f, "y", "procedure_risk")


@register("t08_delong_value_vs_procedure", r6=("auc_a", "auc_b", "auc_diff", "se", "z", "ci_low", "ci_high"), sql=F4_SQL + """,
d AS (SELECT CASE WHEN risk_label >= 1 THEN 1 ELSE 0 END AS y, contract_value_log AS a, procedure_risk AS b FROM gov),
ta AS (SELECT a AS s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg FROM d GROUP BY a),
tb AS (SELECT b AS s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg FROM d GROUP BY b),
tot AS (SELECT COUNT(*) FILTER (WHERE y = 1) AS m, COUNT(*) FILTER (WHERE y <> 1) AS n FROM d),
ca AS (SELECT s, (SUM(neg) OVER (ORDER BY s) - 0.5 * neg) / n AS v10, (m - SUM(pos) OVER (ORDER BY s) + 0.5 * pos) / m AS v01 FROM ta, tot),
cb AS (SELECT s, (SUM(neg) OVER (ORDER BY s) - 0.5 * neg) / n AS v10, (m - SUM(pos) OVER (ORDER BY s) + 0.5 * pos) / m AS v01 FROM tb, tot),
p AS (SELECT d.y, ca.v10 AS v10_a, ca.v01 AS v01_a, cb.v10 AS v10_b, cb.v01 AS v01_b FROM d JOIN ca ON d.a = ca.s JOIN cb ON d.b = cb.s),
o AS (SELECT COUNT(*) FILTER (WHERE y = 1) AS m, COUNT(*) FILTER (WHERE y <> 1) AS n,
             AVG(v10_a) FILTER (WHERE y = 1) AS auc_a, AVG(v10_b) FILTER (WHERE y = 1) AS auc_b,
             VAR_SAMP(v10_a) FILTER (WHERE y = 1) AS s10_aa, VAR_SAMP(v10_b) FILTER (WHERE y = 1) AS s10_bb,
             COVAR_SAMP(v10_a, v10_b) FILTER (WHERE y = 1) AS s10_ab,
             VAR_SAMP(v01_a) FILTER (WHERE y <> 1) AS s01_aa, VAR_SAMP(v01_b) FILTER (WHERE y <> 1) AS s01_bb,
             COVAR_SAMP(v01_a, v01_b) FILTER (WHERE y <> 1) AS s01_ab FROM p),
v AS (SELECT *, SQRT(GREATEST((s10_aa + s10_bb - 2 * s10_ab) / m + (s01_aa + s01_bb - 2 * s01_ab) / n, 0.0)) AS se FROM o)
SELECT auc_a, auc_b, auc_a - auc_b AS auc_diff, se, (auc_a - auc_b) / se AS z,
       auc_a - auc_b - 1.959963984540054 * se AS ci_low, auc_a - auc_b + 1.959963984540054 * se AS ci_high FROM v""")
def t08_delong_value_vs_procedure(spark, sf_dir):
    """Paired DeLong test, log value vs procedure risk as scores of label >= 1."""
    f = features(spark, sf_dir).withColumn("y", (F.col("risk_label") >= 1).cast("int"))
    return st.delong_paired(f, "y", "contract_value_log", "procedure_risk")
