"""Registered strictly-historical feature queries (Q11, Q14): the window form and
the self-join form, both against SQL over per-day totals."""

from __future__ import annotations

from ..operators import history as hist
from .catalogue import C
from .registry import register

def history_sql(frame: str) -> str:
    """CTEs ``past`` (a supplier's totals over the days before each active day, in
    ``frame``) and ``focal`` (the distinct focal contracts with their row count)."""
    totals = {"n": "COUNT(contract_id)", "all_rows": "COUNT(*)", "bids": "COUNT(bid_count)", "bid_sum": "SUM(bid_count)",
              "ones": "COUNT(*) FILTER (WHERE bid_count = 1)", "at_most_one": "COUNT(*) FILTER (WHERE bid_count <= 1)",
              "prices": "COUNT(final_price)", "price_sum": "SUM(final_price)", "dev": "SUM(final_price - center)",
              "dev2": "SUM((final_price - center) * (final_price - center))"}
    return f"""centers AS (SELECT supplier_id, AVG(final_price) AS center FROM contracts_base GROUP BY supplier_id),
debuts AS (
    SELECT supplier_id, debut AS award_date, COUNT(*) AS fresh
    FROM (SELECT supplier_id, cpv_division, MIN(award_date) AS debut FROM contracts_base
          WHERE cpv_division IS NOT NULL GROUP BY supplier_id, cpv_division)
    GROUP BY supplier_id, debut),
days AS (
    SELECT supplier_id, award_date, {", ".join(f"{v} AS {k}" for k, v in totals.items())}, COALESCE(ANY_VALUE(fresh), 0) AS fresh
    FROM contracts_base JOIN centers USING (supplier_id) LEFT JOIN debuts USING (supplier_id, award_date)
    WHERE award_date IS NOT NULL GROUP BY supplier_id, award_date),
past AS (
    SELECT supplier_id, award_date, {", ".join(f"SUM({k}) OVER earlier AS {k}" for k in [*totals, "fresh"])},
           MAX(award_date) OVER earlier AS latest
    FROM days WINDOW earlier AS (PARTITION BY supplier_id ORDER BY award_date {frame})),
focal AS (SELECT supplier_id, contract_id, award_date, COUNT(*) AS k FROM contracts_base
          WHERE supplier_id IS NOT NULL GROUP BY supplier_id, contract_id, award_date)"""


#: suppliers' history in which every earlier contract counts once: at least three of them
Q11_DISTINCT_SQL = "WITH " + history_sql("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING") + """
SELECT supplier_id, contract_id AS focal_contract, award_date AS focal_award_date, ones / n AS single_bid_rate,
       CAST(fresh AS BIGINT) AS cpv_diversity
FROM focal JOIN past USING (supplier_id, award_date) WHERE n >= 3"""

#: a focal contract of k rows counts each earlier row k times, and its price sample is k-fold
Q11_SQL = "WITH " + history_sql("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING") + """
SELECT supplier_id, contract_id AS focal_contract, award_date AS focal_award_date, CAST(k * n AS BIGINT) AS prior_contracts,
       bid_sum / bids AS avg_prior_bids, ones / n AS single_bid_rate, CAST(fresh AS BIGINT) AS cpv_diversity,
       CASE WHEN k * prices > 1 THEN SQRT(k * GREATEST(dev2 - dev * dev / prices, 0) / (k * prices - 1)) / (price_sum / prices) END
           AS price_cv,
       price_sum / prices AS avg_prior_price, latest AS supplier_feature_latest_date
FROM focal JOIN past USING (supplier_id, award_date) WHERE k * n >= 3"""

Q14_SQL = "WITH " + history_sql("RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING") + """
SELECT contract_id, supplier_id, award_date AS focal_award_date, CAST(COALESCE(k * n, 0) AS BIGINT) AS supplier_contracts_prior_365d,
       price_sum / prices AS supplier_avg_price_prior_365d,
       COALESCE(at_most_one / all_rows, 0.0) AS supplier_single_bid_rate_prior_365d, latest AS supplier_feature_latest_date
FROM focal LEFT JOIN past USING (supplier_id, award_date)"""

Q11_R6 = ("avg_prior_bids", "single_bid_rate", "price_cv")
Q11_MEAN = ("avg_prior_price",)
Q11_R4 = ()
Q14_R6 = ("supplier_single_bid_rate_prior_365d",)
Q14_MEAN = ("supplier_avg_price_prior_365d",)
Q14_R4 = ()


@register("q11_supplier_behavior", sql=Q11_SQL, r6=Q11_R6, r4=Q11_R4, mean=Q11_MEAN, headline=True)
def q11_supplier_behavior(spark, sf_dir):
    """Q11 (window form, parity counts): strictly-prior supplier history, >= 3 prior."""
    return hist.supplier_behavior(C(spark, sf_dir), parity=True)


@register("q11_supplier_behavior_selfjoin", sql=Q11_SQL, r6=Q11_R6, r4=Q11_R4, mean=Q11_MEAN)
def q11_supplier_behavior_selfjoin(spark, sf_dir):
    """Q11 via the published self join with a range residual."""
    return hist.supplier_behavior_selfjoin(C(spark, sf_dir))


@register("q14_temporal_windows", sql=Q14_SQL, r6=Q14_R6, r4=Q14_R4, mean=Q14_MEAN, headline=True)
def q14_temporal_windows(spark, sf_dir):
    """Q14 (window form, parity counts): trailing-365-day supplier activity."""
    return hist.temporal_windows(C(spark, sf_dir), parity=True)


@register("q14_temporal_windows_selfjoin", sql=Q14_SQL, r6=Q14_R6, r4=Q14_R4, mean=Q14_MEAN)
def q14_temporal_windows_selfjoin(spark, sf_dir):
    """Q14 via the published self join with a trailing-year residual."""
    return hist.temporal_windows_selfjoin(C(spark, sf_dir))
