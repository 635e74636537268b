"""Registered audit, privacy and access-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy as pv
from ..operators import audit as au
from ..operators import ecosystem as eco
from ..operators import history as hist
from ..operators import pricing as pr
from ..sources import access_log as al
from ..sources.tables import read_table
from .catalogue import C, PRICE_SQL
from .features import F4_SQL, features
from .history import Q11_SQL
from .registry import register

SALT = "tenderscope-public-salt"   # demo salt; deployments pass their own secret


@register("p01_pseudonymized_buyers", sql=f"""
SELECT DISTINCT buyer_id,
       CASE WHEN TRIM(buyer_id) IS NULL OR TRIM(buyer_id) = '' OR LOWER(TRIM(buyer_id)) = 'none' THEN 'unknown'
            ELSE 'B#' || UPPER(SUBSTRING(SHA256('{SALT}' || TRIM(buyer_id)), 1, 6)) END AS buyer_pseudonym
FROM contracts_base""")
def p01_pseudonymized_buyers(spark, sf_dir):
    """Salted SHA-256 pseudonym per buyer id."""
    return C(spark, sf_dir).select("buyer_id", pv.pseudonym("buyer_id", SALT, "B").alias("buyer_pseudonym")).distinct()


@register("p02_pseudonymized_contracts", sql=f"""
SELECT contract_id,
       'B#' || UPPER(SUBSTRING(SHA256('{SALT}' || TRIM(buyer_id)), 1, 6)) AS buyer_id,
       'S#' || UPPER(SUBSTRING(SHA256('{SALT}' || TRIM(supplier_id)), 1, 6)) AS supplier_id,
       cpv_division, award_year, contract_value
FROM contracts_base""")
def p02_pseudonymized_contracts(spark, sf_dir):
    """Contract table with pseudonymised buyer/supplier ids and names dropped."""
    c = C(spark, sf_dir).select("contract_id", "buyer_id", "supplier_id", "buyer_name", "supplier_name",
                                "cpv_division", "award_year", "contract_value")
    return pv.pseudonymize_table(c, {"buyer_id": "B", "supplier_id": "S"}, SALT, drop=("buyer_name", "supplier_name"))


@register("p03_pseudonym_collisions", r6=("collision_rate",), sql=f"""
WITH p AS (SELECT buyer_id AS i, 'B#' || UPPER(SUBSTRING(SHA256('{SALT}' || TRIM(buyer_id)), 1, 6)) AS ps FROM contracts_base
           WHERE buyer_id IS NOT NULL AND TRIM(buyer_id) <> '' AND LOWER(TRIM(buyer_id)) <> 'none')
SELECT COUNT(DISTINCT i) AS distinct_ids, COUNT(DISTINCT ps) AS distinct_pseudonyms,
       COUNT(DISTINCT i) - COUNT(DISTINCT ps) AS collisions,
       (COUNT(DISTINCT i) - COUNT(DISTINCT ps))::DOUBLE / COUNT(DISTINCT i) AS collision_rate FROM p""")
def p03_pseudonym_collisions(spark, sf_dir):
    """Collision count and rate of the 24-bit buyer pseudonym."""
    return pv.collision_report(C(spark, sf_dir), "buyer_id", SALT, "B")


@register("k01_split_overlap", sql="""
WITH tr AS (SELECT * FROM contracts_base WHERE award_year BETWEEN 1995 AND 1999),
te AS (SELECT * FROM contracts_base WHERE award_year = 2001)
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT award_year FROM tr) WHERE award_year IN (SELECT award_year FROM te)) AS overlapping_years,
       (SELECT COUNT(*) FROM (SELECT DISTINCT contract_id FROM tr) WHERE contract_id IN (SELECT contract_id FROM te)) AS overlapping_ids""")
def k01_split_overlap(spark, sf_dir):
    """Year and contract-id overlap of the temporal train (1995-99) and test (2001) splits."""
    c = C(spark, sf_dir)
    return au.split_overlap(c.where(F.col("award_year").between(1995, 1999)), c.where(F.col("award_year") == 2001))


@register("k02_future_feature_violations", sql="WITH q11 AS (" + Q11_SQL + """)
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE supplier_feature_latest_date >= focal_award_date) AS violations FROM q11""")
def k02_future_feature_violations(spark, sf_dir):
    """Strictly-historical features never see the focal date or later."""
    return au.future_feature_violations(hist.supplier_behavior(C(spark, sf_dir)))


@register("k03_hhi_asof_gap", r6=("mean_abs_gap", "max_abs_gap"), sql="""
WITH s AS (SELECT buyer_id, supplier_id, SUM(contract_value) AS v FROM contracts_base
           WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0 GROUP BY 1, 2),
full_h AS (SELECT buyer_id, SUM(v * v) / (SUM(v) * SUM(v)) AS h FROM s GROUP BY buyer_id),
pys AS (SELECT buyer_id, supplier_id, award_year, SUM(contract_value) AS v FROM contracts_base
        WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0 GROUP BY 1, 2, 3),
yrs AS (SELECT DISTINCT buyer_id, award_year FROM pys),
cum AS (SELECT y.buyer_id, y.award_year, p.supplier_id, SUM(p.v) AS c FROM yrs y
        JOIN pys p ON p.buyer_id = y.buyer_id AND p.award_year <= y.award_year GROUP BY 1, 2, 3),
asof_h AS (SELECT buyer_id, award_year, SUM(c * c) / (SUM(c) * SUM(c)) AS h FROM cum GROUP BY 1, 2)
SELECT COUNT(*) AS buyer_years, AVG(ABS(f.h - a.h)) AS mean_abs_gap, MAX(ABS(f.h - a.h)) AS max_abs_gap,
       COUNT(*) FILTER (WHERE ABS(f.h - a.h) > 1e-9) AS differing
FROM asof_h a JOIN full_h f USING (buyer_id)""")
def k03_hhi_asof_gap(spark, sf_dir):
    """Full-period HHI vs as-of HHI (what a non-historical feature would leak)."""
    c = C(spark, sf_dir)
    return au.hhi_asof_gap(eco.buyer_dependency(c), eco.hist_hhi_asof(c))


K04_FEATURES = ["contract_value_log", "buyer_concentration_hhi", "cpv_risk_score", "supplier_cpv_diversity"]
K04_TARGETS = ["risk_label", "buyer_dependency_ratio", "contract_amendments", "procedure_risk"]


_K04_PAIRS = ",\n".join(
    f"ABS(CASE WHEN MIN({f}) = MAX({f}) OR MIN({t}) = MAX({t}) THEN NULL ELSE CORR({f}, {t}) END) AS {f}__{t}"
    for f in K04_FEATURES for t in K04_TARGETS)
_K04_ROWS = "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, GREATEST(" + ", ".join(f"COALESCE({f}__{t}, 0.0)" for t in K04_TARGETS)
    + ", 0.0) AS max_abs_corr FROM r" for f in K04_FEATURES)
K04_SQL = F4_SQL + ",\nr AS (SELECT " + _K04_PAIRS + " FROM gov),\ng AS (" + _K04_ROWS + """)
SELECT feature, max_abs_corr,
       CASE WHEN max_abs_corr > 0.95 THEN 'FAIL' WHEN max_abs_corr >= 0.55 THEN 'WARN' ELSE 'PASS' END AS status
FROM g"""


@register("k04_proxy_gate", r6=("max_abs_corr",), sql=K04_SQL)
def k04_proxy_gate(spark, sf_dir):
    """Proxy gate of governance features against the label and its inputs."""
    return au.proxy_gate(features(spark, sf_dir), K04_FEATURES, K04_TARGETS)


@register("k08_price_tautology", r6=("max_abs_corr",), sql="WITH " + PRICE_SQL + """,
r AS (SELECT ABS(CORR(log_estimated_price, log_price)) AS e, ABS(CORR(bid_count, log_price)) AS b,
             ABS(CORR(award_year, log_price)) AS y FROM rq3_features)
SELECT 'log_estimated_price' AS feature, COALESCE(e, 0.0) AS max_abs_corr, COALESCE(e, 0.0) > 0.99 AS tautology FROM r
UNION ALL SELECT 'bid_count', COALESCE(b, 0.0), COALESCE(b, 0.0) > 0.99 FROM r
UNION ALL SELECT 'award_year', COALESCE(y, 0.0), COALESCE(y, 0.0) > 0.99 FROM r""")
def k08_price_tautology(spark, sf_dir):
    """Price-model features with |r| > 0.99 against log price."""
    return au.target_tautology(pr.price_proxy(C(spark, sf_dir)), ["log_estimated_price", "bid_count", "award_year"], "log_price")


def _log_lines(spark, sf_dir):
    """Stand-in access-log lines from the events table (5-field lines; signups in the older 4-field form)."""
    e = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value", "props"])
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    role = F.when(F.col("event_type") == "error", "admin").otherwise("viewer")
    outcome = F.when(F.col("value") > 50, "failure").otherwise("success")
    five = F.concat_ws("\t", ts, role, F.col("event_type"), F.col("props"), outcome)
    four = F.concat_ws("\t", ts, role, F.lit("sign_in"), F.col("props"))
    return e.select(F.when(F.col("event_type") == "signup", four).otherwise(five).alias("value"))


LOG_SQL = """lines AS (
    SELECT CASE WHEN event_type = 'signup'
                THEN concat_ws(chr(9), strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN event_type = 'error' THEN 'admin' ELSE 'viewer' END, 'sign_in', props)
                ELSE concat_ws(chr(9), strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN event_type = 'error' THEN 'admin' ELSE 'viewer' END,
                               event_type, props, CASE WHEN value > 50 THEN 'failure' ELSE 'success' END) END AS value
    FROM events),
f AS (SELECT string_split(value, chr(9)) AS f FROM lines WHERE trim(value) <> ''),
log AS (
    SELECT f[1] AS ts, f[2] AS role,
           CASE WHEN len(f) = 5 THEN f[3] ELSE 'Sign In' END AS action,
           f[4] AS resource, CASE WHEN len(f) = 5 THEN f[5] ELSE f[3] END AS outcome
    FROM f WHERE len(f) IN (4, 5))"""


@register("a14_access_log", sql="WITH " + LOG_SQL + "\nSELECT * FROM log")
def a14_access_log(spark, sf_dir):
    """Parse 4- and 5-field tab-separated access-log lines."""
    return al.parse_access_log(_log_lines(spark, sf_dir))


@register("c11_access_log_summary", sql="WITH " + LOG_SQL + """
SELECT COUNT(*) AS total_events, COUNT(*) FILTER (WHERE contains(lower(action), 'reveal')) AS reveal_actions,
       COUNT(*) FILTER (WHERE outcome = 'failure') AS failed_events
FROM log WHERE role IN ('admin', 'viewer') AND contains(lower(resource), '"k": 1')""")
def c11_access_log_summary(spark, sf_dir):
    """C11: role/action filters, literal resource search and event counts."""
    log = al.filter_log(al.parse_access_log(_log_lines(spark, sf_dir)), roles=["admin", "viewer"], search='"k": 1')
    return al.log_summary(log)


M10_SQL = F4_SQL + ",\nr AS (SELECT " + _K04_PAIRS + """ FROM gov),
g AS (""" + _K04_ROWS + """),
cov AS (SELECT """ + ", ".join(f"COUNT({f}) / COUNT(*) AS c_{f}" for f in K04_FEATURES) + """ FROM gov),
cv AS (""" + "\nUNION ALL ".join(f"SELECT '{f}' AS feature, c_{f} AS completeness FROM cov" for f in K04_FEATURES) + """)
SELECT feature, max_abs_corr, completeness,
       CASE WHEN max_abs_corr >= 0.55 OR completeness < 0.5 THEN 'rejected' ELSE 'kept' END AS disposition,
       CASE WHEN max_abs_corr >= 0.55 THEN 'proxy_gate' WHEN completeness < 0.5 THEN 'coverage' ELSE 'passed' END AS decisive_gate
FROM g JOIN cv USING (feature)"""


@register("m10_feature_disposition", r6=("max_abs_corr", "completeness"), sql=M10_SQL)
def m10_feature_disposition(spark, sf_dir):
    """Candidate features -> kept / rejected with the decisive gate (proxy correlation, coverage)."""
    f = features(spark, sf_dir)
    gate = au.proxy_gate(f, K04_FEATURES, K04_TARGETS)
    cov = f.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in K04_FEATURES])
    cov_long = cov.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("completeness"))
                                              for c in K04_FEATURES])).alias("s")).select("s.*")
    j = gate.join(cov_long, "feature")
    rejected = (F.col("max_abs_corr") >= 0.55) | (F.col("completeness") < 0.5)
    return j.select("feature", "max_abs_corr", "completeness",
                    F.when(rejected, "rejected").otherwise("kept").alias("disposition"),
                    F.when(F.col("max_abs_corr") >= 0.55, "proxy_gate").when(F.col("completeness") < 0.5, "coverage")
                    .otherwise("passed").alias("decisive_gate"))
