"""Governance feature tables (F1, F2, F4 with the F5 label) and the buyer
risk aggregates (M07), enrichment (T12) and population reconciliation (T13).

``governance_features(parity=False)`` (default) attaches every feature to its
own contract row: one output row per input row. ``parity=True`` rebuilds the
published plan, whose joins on the non-unique ``contract_id`` fan out
(competition table and supplier-history table), and whose historical HHI is
the row-level running form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import clip, competition_risk, mean_of, procedure_risk, risk_label
from . import competition as comp
from . import ecosystem as eco
from . import history as hist


def contracts_clean(contracts: DataFrame, year_min: int = 2006, year_max: int = 2026) -> DataFrame:
    """Ids present, positive value, plausible year."""
    return contracts.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull()
                           & (F.col("contract_value") > 0) & F.col("award_year").between(year_min, year_max))


def network_features(contracts: DataFrame) -> DataFrame:
    """14 contract columns + buyer dependency (left join on a unique buyer key)."""
    bd = eco.buyer_dependency(contracts).select("buyer_id", "buyer_dependency_ratio", "buyer_concentration_hhi")
    c = contracts.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull() & (F.col("contract_value") > 0))
    return c.select("contract_id", "buyer_id", "supplier_id", "buyer_name", "supplier_name", "buyer_region",
                    "supplier_region", "cpv_division", "procedure_type", "bid_count", "contract_amendments",
                    "award_year", "award_date", "contract_value").join(bd, "buyer_id", "left")


def dense_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """DENSE_RANK() OVER (ORDER BY col) - 1 as a code table.

    Ranked over the distinct values only (a category list), so the ordering
    window never sees the fact rows; the code table is joined back by value.
    """
    d = df.select(col).distinct()
    return d.select(col, (F.dense_rank().over(Window.orderBy(F.col(col).asc_nulls_first())) - 1).cast("long").alias(out))


def governance_features(contracts: DataFrame, parity: bool = False) -> DataFrame:
    """the governance table with encodings and the 3-level risk label."""
    c = contracts.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull() & (F.col("contract_value") > 0))
    bd = eco.buyer_dependency(contracts).select("buyer_id", "buyer_dependency_ratio")
    cp = comp.cpv_coverage(contracts).select("cpv_division", "record_count", "high_coverage")
    # a row for each (buyer, year) of ``c``, also for a missing year, which has no HHI; the buyer's dependency stands beside it
    hh = eco.hist_hhi_rowlevel(contracts).withColumnRenamed("hhi_historical", "_h") if parity else \
        eco.hist_hhi_asof(contracts).withColumnRenamed("hhi_asof", "_h")
    years = (hh.join(bd, "buyer_id", "left")
             .select(F.col("buyer_id").alias("_b"), F.col("award_year").alias("_y"),
                     F.when(F.col("award_year").isNotNull(), F.col("_h")).alias("_hhi"), "buyer_dependency_ratio"))
    in_year = (F.col("buyer_id") == F.col("_b")) & F.col("award_year").eqNullSafe(F.col("_y"))
    if parity:
        # the published gate counts each prior contract once for every row of a repeated focal contract
        sb = hist.supplier_behavior(contracts, parity=True)
        cr = comp.competition_risk_features(contracts).select("contract_id", "procedure_risk", "competition_risk")
        base = (c.join(years, in_year, "left")
                .join(cr, "contract_id", "left")
                .join(sb.select(F.col("focal_contract").alias("contract_id"), "single_bid_rate", "cpv_diversity"),
                      "contract_id", "left"))
    else:
        # fact rows move twice: to their buyer's year and to their supplier's day
        days = hist.behavior_by_day(contracts).withColumnRenamed("supplier_id", "_s")
        day = F.when(F.col("contract_id").isNotNull(), F.unix_date(F.col("award_date").cast("date")))
        base = (c.withColumn("procedure_risk", procedure_risk()).withColumn("competition_risk", competition_risk())
                .join(years, in_year, "left")
                .withColumn("_day", day).join(days, (F.col("supplier_id") == F.col("_s")) & (F.col("_day") == F.col("_d")), "left"))
    base = base.join(cp, "cpv_division", "left")
    codes_p = dense_codes(c, "procedure_type", "procedure_type_encoded")
    codes_c = dense_codes(c, "cpv_division", "cpv_enc")
    # code tables hold one row per category; AQE/size stats pick a broadcast join
    base = base.join(codes_p, "procedure_type", "left").join(codes_c, "cpv_division", "left")
    dep = F.coalesce(F.col("buyer_dependency_ratio"), F.lit(0.0))
    return base.select(
        "contract_id", "buyer_id", "supplier_id", "cpv_division", "procedure_type", "procedure_risk",
        "competition_risk", "bid_count", "contract_amendments", "award_year", "contract_value",
        dep.alias("buyer_dependency_ratio"),
        F.coalesce(F.col("_hhi"), F.lit(0.0)).alias("buyer_concentration_hhi"),
        F.coalesce(F.col("single_bid_rate"), F.lit(0.0)).alias("single_bid_rate"),
        F.coalesce(F.col("cpv_diversity"), F.lit(0)).cast("long").alias("supplier_cpv_diversity"),
        F.coalesce(F.col("record_count"), F.lit(0)).cast("long").alias("cpv_record_count"),
        F.when(F.col("high_coverage"), F.lit(0.2)).otherwise(F.lit(0.7)).alias("cpv_risk_score"),
        "procedure_type_encoded", F.col("procedure_type_encoded").alias("proc_enc"), "cpv_enc",
        F.when(F.col("bid_count").isNull(), F.lit(None).cast("double"))
        .otherwise(clip("bid_count", 1, 50)).alias("bid_count_clipped"),
        F.ln(F.greatest(F.col("contract_value"), F.lit(1.0))).alias("contract_value_log"),
        risk_label(dependency=dep).alias("risk_label"))


def feature_viability(features: DataFrame) -> DataFrame:
    """Rows, mean and completeness of four features, one pass, long form."""
    feats = ["buyer_concentration_hhi", "single_bid_rate", "cpv_risk_score", "award_year"]
    one = features.agg(F.count(F.lit(1)).alias("_n"),
                       *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in feats],
                       *[F.count(f).alias(f"c_{f}") for f in feats])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col("_n").alias("rows"), F.col(f"m_{f}").alias("mean_value"),
                 (F.col(f"c_{f}") / F.col("_n")).alias("completeness")) for f in feats])).alias("s")).select("s.*")


def label_counts(features: DataFrame) -> DataFrame:
    """Counts per risk label (binary metrics use label >= 1; class 2 reported)."""
    return features.groupBy("risk_label").agg(F.count(F.lit(1)).alias("contracts"))


def buyer_risk_profile(predictions: DataFrame) -> DataFrame:
    """Per buyer mean risk, negotiated/restricted rate, null-skipping single-bid rate."""
    kind = F.col("procedure_type")
    neg = ((kind == "RESTRICTED") | kind.ilike("%NEGOTIATED%")).cast("double")
    return predictions.groupBy("buyer_id").agg(
        F.count(F.lit(1)).alias("contracts"),
        mean_of(F.sum("ensemble_risk_prob"), F.count("ensemble_risk_prob")).alias("mean_risk"),
        F.avg(neg).alias("negotiated_or_restricted_rate"),
        F.avg((F.col("bid_count") <= 1).cast("double")).alias("true_single_bid_rate"))


def amendment_enrichment(predictions: DataFrame) -> DataFrame:
    """Amendment rate among HIGH-risk rows divided by the rate among LOW-risk rows."""
    amended = (F.col("contract_amendments") > 0).cast("double")
    one = predictions.agg(F.avg(F.when(F.col("risk_class") == "HIGH", amended)).alias("high_amendment_rate"),
                          F.avg(F.when(F.col("risk_class") == "LOW", amended)).alias("low_amendment_rate"))
    return one.withColumn("enrichment", F.col("high_amendment_rate") / F.nullif(F.col("low_amendment_rate"), F.lit(0.0)))


def single_bid_reconciliation(contracts: DataFrame, split_col: str = "award_year") -> DataFrame:
    """Single-bid rate under the three denominators, with bid coverage, per split value.

    zero_null: NULL counts as not single (SQL rule); observed: NULL skipped;
    all_rows_known_only: single count over all rows. Coverage = known / rows.
    """
    b = F.col("bid_count")
    single = F.sum(F.when(b <= 1, 1).otherwise(0))
    return contracts.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("rows"), F.count(b).alias("known_bids"), single.cast("long").alias("single_bids"),
        F.avg(F.when(b <= 1, F.lit(1.0)).otherwise(F.lit(0.0))).alias("single_bid_rate_zero_null"),
        F.avg((b <= 1).cast("double")).alias("single_bid_rate_observed"),
        (F.count(b) / F.count(F.lit(1))).alias("bid_coverage"))
