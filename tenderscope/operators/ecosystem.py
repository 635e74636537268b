"""Buyer / supplier ecosystem queries: concentration and dependency.

Q02 buyer_ecosystem, Q03 supplier_ecosystem, Q10 buyer_dependency,
F3 historical HHI (row-level parity form and supplier-level as-of form),
E13-E17 and notebook variants N04, N05, N14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import dependency_class, single_bid_zero_null
from .common import global_order_prefix, ntile_from_position, segmented_prefix, top_k_per_group, with_scalar


def _valid_pairs(contracts: DataFrame) -> DataFrame:
    return contracts.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull()
                           & (F.col("contract_value") > 0))


def buyer_supplier_values(contracts: DataFrame, with_name: bool = False) -> DataFrame:
    """R01 / E14 core: one row per (buyer, supplier) with Σ value and count.

    Map-side partial aggregation makes a hot buyer cheap: only its distinct
    supplier pairs reach the shuffle.
    """
    aggs = [F.sum("contract_value").alias("total_value"), F.count(F.lit(1)).alias("contract_count")]
    if with_name:
        aggs.insert(0, F.min("buyer_name").alias("buyer_name"))
    return _valid_pairs(contracts).groupBy("buyer_id", "supplier_id").agg(*aggs)


def buyer_dependency(contracts: DataFrame) -> DataFrame:
    """Q10: top-1 supplier share, HHI of supplier shares, supplier count per buyer.

    Shares need the buyer total; instead of a partition-sum window we use
    max(v)/Σv and Σv²/(Σv)², one aggregation on the pair table.
    """
    pairs = buyer_supplier_values(contracts)
    t = F.sum("total_value")
    return (pairs.groupBy("buyer_id")
            .agg(F.max("total_value").alias("_mx"), t.alias("_t"),
                 F.sum(F.col("total_value") * F.col("total_value")).alias("_t2"),
                 F.count(F.lit(1)).alias("buyer_supplier_count"))
            .select("buyer_id",
                    (F.col("_mx") / F.nullif(F.col("_t"), F.lit(0.0))).alias("buyer_dependency_ratio"),
                    (F.col("_t2") / F.nullif(F.col("_t") * F.col("_t"), F.lit(0.0))).alias("buyer_concentration_hhi"),
                    "buyer_supplier_count"))


def buyer_ecosystem(contracts: DataFrame, top_n: int = 5, salt_buckets: int = 16) -> DataFrame:
    """Q02: buyer total, top-N supplier total, dependency ratio and class, HHI.

    The top-N suppliers per buyer come from an exact salted top-k, so a buyer
    with millions of suppliers is never sorted by one task. Ties at the N-th
    place do not change the top-N *sum*.
    """
    pairs = buyer_supplier_values(contracts, with_name=True)
    per_buyer = (pairs.groupBy("buyer_id")
                 .agg(F.min("buyer_name").alias("buyer_name"),
                      F.sum("total_value").alias("buyer_total"),
                      F.count(F.lit(1)).alias("supplier_count"),
                      F.sum(F.col("total_value") * F.col("total_value")).alias("_t2")))
    top = (top_k_per_group(pairs.select("buyer_id", "supplier_id", "total_value"), ["buyer_id"],
                           [F.col("total_value").desc(), F.col("supplier_id")], top_n,
                           salt_col="supplier_id", salt_buckets=salt_buckets)
           .groupBy("buyer_id").agg(F.sum("total_value").alias("top5_total")))
    ratio = F.col("top5_total") / F.nullif(F.col("buyer_total"), F.lit(0.0))
    return (per_buyer.join(top, "buyer_id")
            .select("buyer_id", "buyer_name", "buyer_total", "top5_total",
                    ratio.alias("dependency_ratio"),
                    dependency_class(ratio).alias("dependency_class"),
                    "supplier_count",
                    (F.col("_t2") / F.nullif(F.col("buyer_total") * F.col("buyer_total"), F.lit(0.0)))
                    .alias("buyer_concentration_hhi")))


def supplier_ecosystem(contracts: DataFrame) -> DataFrame:
    """Q03: per supplier activity, reach, diversity and the SQL single-bid rule."""
    return (contracts.where(F.col("supplier_id").isNotNull() & (F.col("contract_value") > 0))
            .groupBy("supplier_id")
            .agg(F.min("supplier_name").alias("supplier_name"),
                 F.min("supplier_region").alias("supplier_region"),
                 F.count(F.lit(1)).alias("contract_count"),
                 F.countDistinct("buyer_id").alias("buyer_count"),
                 F.countDistinct("cpv_division").alias("cpv_diversity"),
                 F.min("award_year").alias("first_year"),
                 F.max("award_year").alias("last_year"),
                 F.sum("contract_value").alias("total_value"),
                 F.avg(single_bid_zero_null()).alias("single_bid_rate"),
                 F.avg(F.when(F.col("contract_amendments") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
                 .alias("amendment_rate")))


def dependency_class_summary(buyer_master: DataFrame) -> DataFrame:
    """Buyers, mean dependency and mean HHI per dependency class."""
    return (buyer_master.groupBy("dependency_class")
            .agg(F.count(F.lit(1)).alias("buyers"),
                 F.avg("dependency_ratio").alias("mean_dependency"),
                 F.avg("buyer_concentration_hhi").alias("mean_hhi")))


def top_pairs(contracts: DataFrame, n: int = 5000) -> DataFrame:
    """The n largest buyer–supplier pairs by value (top-k is the feature)."""
    return (buyer_supplier_values(contracts)
            .orderBy(F.col("total_value").desc(), "buyer_id", "supplier_id").limit(n)
            .select("buyer_id", "supplier_id", "contract_count", "total_value"))


def hhi_lorenz(buyer_master: DataFrame) -> DataFrame:
    """Lorenz curve of buyer HHI (rank, running HHI share, buyer share).

    The published form uses un-partitioned windows; here the global order and
    running sum come from a two-level prefix sum (range buckets + offsets).
    """
    h = buyer_master.where(F.col("buyer_concentration_hhi").isNotNull()) \
        .select("buyer_id", "buyer_concentration_hhi")
    ranked = global_order_prefix(h, [F.col("buyer_concentration_hhi"), F.col("buyer_id")],
                                 {"h": F.col("buyer_concentration_hhi")})
    totals = h.agg(F.count(F.lit(1)).alias("_n"), F.sum("buyer_concentration_hhi").alias("_s"))
    return (with_scalar(ranked, totals)
            .select(F.col("_pos").alias("rank_id"), "buyer_concentration_hhi",
                    (F.col("_cum_h") / F.col("_s")).alias("cumulative_hhi_share"),
                    (F.col("_pos").cast("double") / F.nullif(F.col("_n").cast("double"), F.lit(0.0)))
                    .alias("cumulative_buyer_share")))


def supplier_concentration(supplier_master: DataFrame, n: int = 25) -> DataFrame:
    """Value share of the top-n suppliers (global total as a one-row aggregate)."""
    pos = supplier_master.where(F.col("total_value") > 0)
    total = pos.agg(F.sum("total_value").alias("_all"))
    return (with_scalar(pos, total)
            .select("supplier_id", "supplier_name", "contract_count", "total_value",
                    (F.col("total_value") / F.col("_all")).alias("value_share"))
            .orderBy(F.col("total_value").desc(), "supplier_id").limit(n)
            .drop("supplier_id"))


def supplier_tiers(supplier_master: DataFrame, tiers: int = 4) -> DataFrame:
    """NTILE(tiers) over suppliers by value (desc, ties by id) -> count and value per tier."""
    pos = supplier_master.where(F.col("total_value") > 0).select("supplier_id", "total_value")
    ranked = global_order_prefix(pos, [F.col("total_value").desc(), F.col("supplier_id")])
    n = pos.agg(F.count(F.lit(1)).alias("_n"))
    return (with_scalar(ranked, n).withColumn("tier", ntile_from_position(F.col("_pos"), F.col("_n"), tiers))
            .groupBy("tier").agg(F.count(F.lit(1)).alias("suppliers"), F.sum("total_value").alias("total_value"))
            .select(F.concat(F.lit("Tier "), F.col("tier").cast("string")).alias("supplier_tier"),
                    "suppliers", "total_value"))


def hist_hhi_asof(contracts: DataFrame) -> DataFrame:
    """F3, as-of form: HHI of supplier shares using all contracts up to each year.

    Supplier-level and bounded in (0, 1]. Without an as-of join: each
    (buyer, supplier) pair's cumulative value changes only in years where the
    pair is active, so Σ_s cum² grows by cum² − previous cum² in those years.
    Per (buyer, year) increments of Σ cum² and Σ value are summed, then run
    over the buyer's active years (a window over years, bounded by the number
    of years). One row per (buyer, award_year) with contracts.
    """
    valid = _valid_pairs(contracts)
    pys = valid.groupBy("buyer_id", "supplier_id", "award_year").agg(F.sum("contract_value").alias("_v"))
    w_pair = Window.partitionBy("buyer_id", "supplier_id").orderBy("award_year")
    cum = pys.withColumn("_cum", F.sum("_v").over(w_pair.rowsBetween(Window.unboundedPreceding, 0)))
    inc = cum.withColumn("_d2", F.col("_cum") * F.col("_cum")
                         - F.pow(F.coalesce(F.lag("_cum").over(w_pair), F.lit(0.0)), 2))
    per_year = inc.groupBy("buyer_id", "award_year").agg(F.sum("_d2").alias("_d2"), F.sum("_v").alias("_v"))
    w_buyer = Window.partitionBy("buyer_id").orderBy("award_year").rowsBetween(Window.unboundedPreceding, 0)
    run = (per_year.withColumn("_s2", F.sum("_d2").over(w_buyer))
           .withColumn("_t", F.sum("_v").over(w_buyer)))
    return run.select("buyer_id", "award_year",
                      (F.col("_s2") / F.nullif(F.col("_t") * F.col("_t"), F.lit(0.0))).alias("hhi_asof"))


def hist_hhi_rowlevel(contracts: DataFrame) -> DataFrame:
    """F3, parity form: running shares per contract *row*, squared, summed per (buyer, year).

    Reproduces the published definition (one supplier with three rows in a
    year contributes three squares). The published frame is ordered by year
    only; we add a total order (date, supplier, contract, value) so the result
    is deterministic. Both running sums are segmented prefixes: a buyer with most
    of the rows spans many tasks.
    """
    valid = _valid_pairs(contracts)
    order = [F.col("award_year"), F.col("award_date"), F.col("supplier_id"), F.col("contract_id"),
             F.col("contract_value")]
    cols = ["buyer_id", "supplier_id", "award_year", "award_date", "contract_id", "contract_value"]
    s = segmented_prefix(valid.select(*cols), ["buyer_id"], order, {"buyer": F.col("contract_value")})
    s = segmented_prefix(s, ["buyer_id", "supplier_id"], [c for c in order if c is not order[2]], {"supplier": F.col("contract_value")})
    share = F.col("_cum_supplier") / F.nullif(F.col("_cum_buyer"), F.lit(0.0))
    return (s.groupBy("buyer_id", "award_year").agg(F.sum(share * share).alias("hhi_historical")))


def market_hhi_by_year(contracts: DataFrame) -> DataFrame:
    """Market HHI (× 10,000) of supplier value shares per year."""
    v = contracts.where(F.col("supplier_id").isNotNull() & (F.col("contract_value") > 0))
    sy = v.groupBy("award_year", "supplier_id").agg(F.sum("contract_value").alias("_v"))
    return (sy.groupBy("award_year")
            .agg(F.sum("_v").alias("_t"), F.sum(F.col("_v") * F.col("_v")).alias("_t2"),
                 F.count(F.lit(1)).alias("suppliers"))
            .select("award_year", "suppliers",
                    (F.col("_t2") / (F.col("_t") * F.col("_t")) * 10000.0).alias("market_hhi")))


def top_suppliers_by_value(contracts: DataFrame, n: int = 20) -> DataFrame:
    """The n suppliers with the largest awarded value."""
    return (contracts.where(F.col("supplier_id").isNotNull())
            .groupBy("supplier_id").agg(F.sum("contract_value").alias("total_value"),
                                        F.count(F.lit(1)).alias("contract_count"))
            .orderBy(F.col("total_value").desc(), "supplier_id").limit(n))
