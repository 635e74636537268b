"""Procedure, competition, CPV and temporal queries (Q04-Q06, Q12, E01-E04,
notebook N02/N06-N10/N12/N13/N15 and chart data G00/G02/G05/G09/G11/G12/G15/G16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import competition_risk, mean_of, procedure_risk, single_bid_zero_null
from .common import with_quantiles

# fixed values: buyer-type ladder (case-insensitive patterns on the buyer name)
BUYER_TYPE_LADDER = (
    ("(?i)comune|municipio", "Local Authority / Municipality"),
    ("(?i)ministero", "Ministry / Central Gov"),
    ("(?i)azienda|asl|sanitar|ospedal", "Health Authority"),
    ("(?i)universit|scuola|istituto", "Education / Research"),
    ("(?i)provincia|regione", "Regional / Provincial Gov"),
)
BUYER_TYPE_OTHER = "Other Public Body"


def buyer_type(name="buyer_name") -> Column:
    """Buyer type from a case-insensitive regex ladder on the name."""
    n = F.col(name) if isinstance(name, str) else name
    out = F.lit(BUYER_TYPE_OTHER)
    for pat, label in reversed(BUYER_TYPE_LADDER):
        out = F.when(n.rlike(pat), F.lit(label)).otherwise(out)
    return out


def procedure_analysis(contracts: DataFrame) -> DataFrame:
    """Q04: per procedure (bid count known): count, single bidders (= 1), %, mean bids, median price."""
    single = F.sum(F.when(F.col("bid_count") == 1, 1).otherwise(0))
    known = contracts.where(F.col("bid_count").isNotNull())
    per = (known.groupBy("procedure_type")
           .agg(F.count(F.lit(1)).alias("total_contracts"), single.alias("single_bidder"),
                (100.0 * single.cast("double") / F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0)))
                .alias("single_bidder_pct"),
                F.avg("bid_count").alias("avg_bids")))
    return with_quantiles(per, known, ["procedure_type"], "final_price", {"median_price": 0.5})


def cpv_coverage(contracts: DataFrame, high_coverage_rows: int = 1000) -> DataFrame:
    """Q05: per CPV division (known, priced): rows, buyers, suppliers, mean/median price, coverage flag."""
    known = contracts.where(F.col("cpv_division").isNotNull() & (F.col("cpv_division") != "UNKNOWN") & (F.col("final_price") > 0))
    per = (known.groupBy("cpv_division")
           .agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("buyer_id").alias("buyers"),
                F.countDistinct("supplier_id").alias("suppliers"),
                mean_of(F.sum("final_price"), F.count("final_price")).alias("avg_price"),
                (F.count(F.lit(1)) >= high_coverage_rows).alias("high_coverage")))
    return with_quantiles(per, known, ["cpv_division"], "final_price", {"median_price": 0.5})


def temporal_analysis(contracts: DataFrame, year_min: int = 2006, year_max: int = 2026) -> DataFrame:
    """Q06: per award year: contracts, buyers, suppliers, value, single-bid rate (NULL -> not single)."""
    return (contracts.where(F.col("award_year").between(year_min, year_max)).groupBy("award_year")
            .agg(F.count(F.lit(1)).alias("contract_count"), F.countDistinct("buyer_id").alias("buyers"),
                 F.countDistinct("supplier_id").alias("suppliers"), F.sum("contract_value").alias("total_value"),
                 F.avg(single_bid_zero_null()).alias("single_bid_rate")))


def competition_risk_features(contracts: DataFrame) -> DataFrame:
    """Q12: procedure risk and competition risk ladders per contract row."""
    return contracts.select("contract_id", "procedure_type", "bid_count", "contract_amendments",
                            procedure_risk().alias("procedure_risk"), competition_risk().alias("competition_risk"))


def bid_band(b: Column) -> Column:
    return (F.when(b <= 1, "0-1").when(b <= 3, "2-3").when(b <= 5, "4-5").when(b <= 10, "6-10").otherwise("11+"))


def bid_count_distribution(features: DataFrame) -> DataFrame:
    """Contracts and mean competition risk per bid band (NULL bids fall in '11+')."""
    return (features.groupBy(bid_band(F.col("bid_count")).alias("bid_band"))
            .agg(F.count(F.lit(1)).alias("contracts"), F.avg("competition_risk").alias("mean_competition_risk")))


def competition_enrichment(features: DataFrame, min_rows: int = 100, top: int = 100) -> DataFrame:
    """Single-bid rate per (CPV, procedure) with >= min_rows rows; top by rate."""
    return (features.where(F.col("cpv_division").isNotNull()).groupBy("cpv_division", "procedure_type")
            .agg(F.avg(single_bid_zero_null()).alias("single_bid_rate"), F.count(F.lit(1)).alias("contracts"))
            .where(F.col("contracts") >= min_rows)
            .orderBy(F.col("single_bid_rate").desc(), "cpv_division", "procedure_type").limit(top))


def procedure_distribution(features: DataFrame, top: int = 20) -> DataFrame:
    """Contracts and mean competition risk per procedure, top by count."""
    return (features.groupBy("procedure_type")
            .agg(F.count(F.lit(1)).alias("contracts"), F.avg("competition_risk").alias("mean_competition_risk"))
            .orderBy(F.col("contracts").desc(), "procedure_type").limit(top))


def single_bidder_analysis(features: DataFrame, min_rows: int = 100, top: int = 20) -> DataFrame:
    """Single-bid rate per procedure with >= min_rows rows, top by rate."""
    return (features.groupBy("procedure_type")
            .agg(F.count(F.lit(1)).alias("contracts"), F.avg(single_bid_zero_null()).alias("single_bid_rate"))
            .where(F.col("contracts") >= min_rows)
            .orderBy(F.col("single_bid_rate").desc(), "procedure_type").limit(top))


def awards_per_year(contracts: DataFrame) -> DataFrame:
    """Awards per year (award date known)."""
    return (contracts.where(F.col("award_date").isNotNull()).groupBy(F.year("award_date").alias("year"))
            .agg(F.count(F.lit(1)).alias("count")))


def suppliers_per_year(contracts: DataFrame) -> DataFrame:
    """Distinct active suppliers per year."""
    return (contracts.where(F.col("award_date").isNotNull()).groupBy(F.year("award_date").alias("year"))
            .agg(F.countDistinct("supplier_id").alias("supplier_count")))


def procedure_counts(contracts: DataFrame) -> DataFrame:
    """Rows per procedure and share of all rows."""
    g = contracts.where(F.col("procedure_type").isNotNull()).groupBy("procedure_type") \
        .agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("_t"))
    return g.crossJoin(F.broadcast(tot)).select(
        "procedure_type", "count", (F.col("count") / F.col("_t")).alias("share"))


def single_bid_by_procedure(contracts: DataFrame) -> DataFrame:
    """Single-bid count and % per procedure (bids known)."""
    single = F.sum(F.when(F.col("bid_count") == 1, 1).otherwise(0))
    return (contracts.where(F.col("bid_count").isNotNull() & F.col("procedure_type").isNotNull())
            .groupBy("procedure_type")
            .agg(F.count(F.lit(1)).alias("total"), single.alias("single_bid_count"),
                 (100.0 * single.cast("double") / F.count(F.lit(1)).cast("double")).alias("single_bid_pct")))


def contracts_per_bid_count(contracts: DataFrame, max_bids: int = 20) -> DataFrame:
    """Contracts per bid count (<= max_bids)."""
    return (contracts.where(F.col("bid_count").isNotNull() & (F.col("bid_count") <= max_bids))
            .groupBy("bid_count").agg(F.count(F.lit(1)).alias("contract_count")))


def top_cpv(contracts: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent CPV divisions."""
    return (contracts.where(F.col("cpv_division").isNotNull()).groupBy("cpv_division")
            .agg(F.count(F.lit(1)).alias("n_records"))
            .orderBy(F.col("n_records").desc(), "cpv_division").limit(top))


def amendments_by_procedure(contracts: DataFrame) -> DataFrame:
    """Amended share per procedure."""
    amended = F.sum(F.when(F.col("contract_amendments") > 0, 1).otherwise(0))
    return (contracts.where(F.col("procedure_type").isNotNull()).groupBy("procedure_type")
            .agg(F.count(F.lit(1)).alias("total"), amended.alias("amended"),
                 (100.0 * amended.cast("double") / F.count(F.lit(1)).cast("double")).alias("amendment_pct")))


def buyer_type_summary(contracts: DataFrame) -> DataFrame:
    """Rows, distinct buyers and spend per buyer type."""
    return (contracts.groupBy(buyer_type().alias("buyer_type"))
            .agg(F.count(F.lit(1)).alias("contracts"), F.countDistinct("buyer_id").alias("buyers"),
                 F.sum("contract_value").alias("total_spend")))


def dataset_summary(contracts: DataFrame) -> DataFrame:
    """Dataset fact sheet as one row (true counts, no estimates)."""
    one = contracts.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("contract_id").alias("contracts"),
        F.countDistinct("buyer_id").alias("buyers"), F.countDistinct("supplier_id").alias("suppliers"),
        F.countDistinct("cpv_division").alias("cpv_divisions"), F.sum("contract_value").alias("total_value"),
        F.min("award_year").alias("first_year"), F.max("award_year").alias("last_year"))
    return with_quantiles(one, contracts, [], "contract_value", {"median_value": 0.5})


def top_suppliers_by_count(contracts: DataFrame, top: int = 20) -> DataFrame:
    """Suppliers with the most contract rows."""
    return (contracts.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id")
            .agg(F.count(F.lit(1)).alias("contract_count"))
            .orderBy(F.col("contract_count").desc(), "supplier_id").limit(top))


def single_bid_trend(contracts: DataFrame) -> DataFrame:
    """Null-skipping single-bid rate per year, flagging the latest year."""
    g = contracts.groupBy("award_year").agg(F.avg((F.col("bid_count") <= 1).cast("double")).alias("single_bid_rate"),
                                            F.count("bid_count").alias("known_bids"))
    latest = g.agg(F.max("award_year").alias("_ly"))
    return g.crossJoin(F.broadcast(latest)).select(
        "award_year", "single_bid_rate", "known_bids", (F.col("award_year") == F.col("_ly")).alias("is_latest"))
