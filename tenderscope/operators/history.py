"""Strictly-historical supplier features (Q11, Q14; joins J7, J8).

The published form is a self join of the contract table with itself on the
supplier plus a date-range residual — quadratic in the number of rows per
supplier, which a hub supplier holding a third of all rows turns into a
cluster-sized shuffle. The default form here is linear:

1. pre-aggregate every supplier's rows per award day (counts, sums, centred
   price moments, the CPV divisions first seen that day);
2. a running window per supplier over *days* (ROWS ..-1 for "all prior",
   RANGE -365..-1 on the day number for "trailing year");
3. join the per-day prior state to the focal rows on (supplier, day).

The window partitions hold one row per (supplier, day), so a hot supplier
costs one row per active day, never its contract count.

``parity=True`` reproduces the published grouping by (supplier, contract,
day): when that triple repeats, the self join multiplies counts and
replicates the price sample by the number of focal duplicates k.
``selfjoin`` variants keep the published join for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import mean_of, single_bid_zero_null
from .graph.iterative import materialize


def _day(col: str = "award_date") -> Column:
    return F.unix_date(F.col(col).cast("date"))


def _per_day(contracts: DataFrame) -> DataFrame:
    """One row per (supplier, day) with additive aggregates of that day's rows."""
    h = contracts.where(F.col("supplier_id").isNotNull() & F.col("award_date").isNotNull())
    mean_price = h.groupBy("supplier_id").agg(F.avg("final_price").alias("_m"))
    first_cpv = (h.where(F.col("cpv_division").isNotNull())
                 .groupBy("supplier_id", "cpv_division").agg(F.min(_day()).alias("_d"))
                 .groupBy("supplier_id", "_d").agg(F.count(F.lit(1)).alias("new_cpv")))
    d = F.col("final_price") - F.col("_m")
    per_day = (h.join(mean_price, "supplier_id")
               .groupBy("supplier_id", _day().alias("_d"))
               .agg(F.count("contract_id").alias("n_cid"),
                    F.count(F.lit(1)).alias("n_rows"),
                    F.count("bid_count").alias("n_bids"),
                    F.sum("bid_count").alias("s_bids"),
                    F.sum(F.when(F.col("bid_count") == 1, 1).otherwise(0)).alias("n_single_eq1"),
                    F.sum(F.when(F.col("bid_count") <= 1, 1).otherwise(0)).alias("n_single_le1"),
                    F.count("final_price").alias("n_price"),
                    F.sum("final_price").alias("s_price"),
                    F.sum(d).alias("s_dev"),
                    F.sum(d * d).alias("s_dev2")))
    return per_day.join(first_cpv, ["supplier_id", "_d"], "left").fillna(0, subset=["new_cpv"])


_ADDITIVE = ("n_cid", "n_rows", "n_bids", "s_bids", "n_single_eq1", "n_single_le1",
             "n_price", "s_price", "s_dev", "s_dev2", "new_cpv")


def _prior_state(per_day: DataFrame, frame: str) -> DataFrame:
    """Running sums strictly before each active day (frame 'all' or 'year')."""
    w = Window.partitionBy("supplier_id").orderBy("_d")
    w = w.rowsBetween(Window.unboundedPreceding, -1) if frame == "all" else w.rangeBetween(-365, -1)
    cols = [F.sum(c).over(w).alias(f"p_{c}") for c in _ADDITIVE]
    return per_day.select("supplier_id", "_d", *cols, F.max(F.date_from_unix_date("_d")).over(w).alias("p_latest"))


def _focal(contracts: DataFrame, parity: bool, key: list[str]) -> DataFrame:
    s = contracts.where(F.col("supplier_id").isNotNull())
    return s.groupBy(*key).agg(F.count(F.lit(1)).alias("k") if parity else F.lit(1).alias("k")) \
        .withColumn("_d", _day())


def supplier_behavior(contracts: DataFrame, min_prior: int = 3, parity: bool = True) -> DataFrame:
    """Q11: history strictly before each focal contract; keep >= ``min_prior`` prior contracts."""
    return _behavior(contracts, _prior_state(_per_day(contracts), "all"), min_prior, parity)


def behavior_by_day(contracts: DataFrame, min_prior: int = 3) -> DataFrame:
    """(supplier_id, _d, single_bid_rate, cpv_diversity): Q11's columns on each day on which the supplier was active,
    for all its contracts of that day; days with at least ``min_prior`` contracts before them."""
    prior = _prior_state(_per_day(contracts), "all")
    return prior.where(F.col("p_n_cid") >= min_prior).select(
        "supplier_id", "_d", (F.col("p_n_single_eq1").cast("double") / F.nullif(F.col("p_n_cid").cast("double"), F.lit(0.0))).alias("single_bid_rate"),
        F.coalesce(F.col("p_new_cpv"), F.lit(0)).cast("long").alias("cpv_diversity"))


def _behavior(contracts: DataFrame, prior: DataFrame, min_prior: int, parity: bool) -> DataFrame:
    """Q11's columns from the sums before each active day."""
    focal = _focal(contracts, parity, ["supplier_id", "contract_id", "award_date"])
    j = focal.join(prior, ["supplier_id", "_d"], "left")
    k = F.col("k").cast("double")
    n = F.coalesce(F.col("p_n_cid"), F.lit(0)) * F.col("k")
    kn = k * F.col("p_n_price")
    # sample variance of the k-fold replicated prior prices, from centred sums
    ss = F.col("p_s_dev2") - F.col("p_s_dev") * F.col("p_s_dev") / F.col("p_n_price")
    var = F.when(kn > 1, k * F.greatest(ss, F.lit(0.0)) / (kn - 1))
    avg_price = mean_of(F.col("p_s_price"), F.col("p_n_price"))
    return (j.select(
        "supplier_id", F.col("contract_id").alias("focal_contract"), F.col("award_date").alias("focal_award_date"),
        n.cast("long").alias("prior_contracts"),
        (F.col("p_s_bids") / F.col("p_n_bids")).alias("avg_prior_bids"),
        (F.col("p_n_single_eq1").cast("double") / F.nullif(F.col("p_n_cid").cast("double"), F.lit(0.0)))
        .alias("single_bid_rate"),
        F.coalesce(F.col("p_new_cpv"), F.lit(0)).cast("long").alias("cpv_diversity"),
        (F.sqrt(var) / F.nullif(avg_price, F.lit(0.0))).alias("price_cv"),
        avg_price.alias("avg_prior_price"),
        F.col("p_latest").alias("supplier_feature_latest_date"))
        .where(F.col("prior_contracts") >= min_prior))


def temporal_windows(contracts: DataFrame, parity: bool = True) -> DataFrame:
    """Q14: trailing-365-day supplier activity before each focal contract.

    An empty window gives count 0, mean price NULL and single-bid rate 0.0
    (the published left join turns the unmatched row into ELSE 0.0).
    """
    prior = _prior_state(_per_day(contracts), "year")
    focal = _focal(contracts, parity, ["contract_id", "supplier_id", "award_date"])
    j = focal.join(prior, ["supplier_id", "_d"], "left")
    return j.select(
        "contract_id", "supplier_id", F.col("award_date").alias("focal_award_date"),
        (F.coalesce(F.col("p_n_cid"), F.lit(0)) * F.col("k")).cast("long").alias("supplier_contracts_prior_365d"),
        mean_of(F.col("p_s_price"), F.col("p_n_price")).alias("supplier_avg_price_prior_365d"),
        F.coalesce(F.col("p_n_single_le1").cast("double") / F.nullif(F.col("p_n_rows").cast("double"), F.lit(0.0)),
                   F.lit(0.0)).alias("supplier_single_bid_rate_prior_365d"),
        F.col("p_latest").alias("supplier_feature_latest_date"))


# ---- published self joins (J7/J8), kept for comparison and parity tests ----

def supplier_behavior_selfjoin(contracts: DataFrame, min_prior: int = 3) -> DataFrame:
    """Q11 by the self join on the supplier with a date-range residual.

    Both sides are active days of the supplier, the history's with additive
    aggregates of its rows: pairs fold into one row a (supplier, day) at once,
    and the focal contracts of a day share them. Joining the rows themselves kept
    a row for each (focal contract, CPV division before it) until all pairs were read."""
    # the work is in the pairs, not in the bytes read: partitions are not to be merged by size
    n = max(int(contracts.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")), 1)
    h = materialize(_per_day(contracts)).repartition(n, "supplier_id")
    s = h.select("supplier_id", "_d").alias("s")
    j = s.join(h.alias("h"), (F.col("s.supplier_id") == F.col("h.supplier_id")) & (F.col("h._d") < F.col("s._d")))
    prior = j.groupBy(F.col("s.supplier_id").alias("supplier_id"), F.col("s._d").alias("_d")).agg(
        *[F.sum(f"h.{c}").alias(f"p_{c}") for c in _ADDITIVE], F.max(F.date_from_unix_date("h._d")).alias("p_latest"))
    return _behavior(contracts, prior, min_prior, parity=True)


def temporal_windows_selfjoin(contracts: DataFrame) -> DataFrame:
    s = contracts.where(F.col("supplier_id").isNotNull()).alias("s")
    h = contracts.alias("h")
    cond = ((F.col("s.supplier_id") == F.col("h.supplier_id")) & (F.col("h.award_date") < F.col("s.award_date"))
            & (F.col("h.award_date") >= F.date_sub(F.col("s.award_date"), 365)))
    j = s.join(h, cond, "left")
    return j.groupBy(F.col("s.contract_id").alias("contract_id"), F.col("s.supplier_id").alias("supplier_id"),
                     F.col("s.award_date").alias("focal_award_date")).agg(
        F.count(F.col("h.contract_id")).alias("supplier_contracts_prior_365d"),
        mean_of(F.sum("h.final_price"), F.count("h.final_price")).alias("supplier_avg_price_prior_365d"),
        F.avg(single_bid_zero_null(F.col("h.bid_count"))).alias("supplier_single_bid_rate_prior_365d"),
        F.max("h.award_date").alias("supplier_feature_latest_date"))
