"""The governance table: fact rows move to their buyer's year and their supplier's day, and keep the features of the joins on them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tenderscope.functions.rules import competition_risk
from tenderscope.operators import ecosystem as eco
from tenderscope.operators import governance as gov
from tenderscope.operators import history as hist

COLUMNS = ("contract_id string, buyer_id string, supplier_id string, cpv_division string, procedure_type string, bid_count double, "
           "contract_amendments double, award_date date, contract_value double")


def _contracts(spark):
    rng = random.Random(8)
    maybe = lambda x: None if rng.random() < 0.08 else x
    rows = [(maybe(f"c{rng.randrange(120)}"), maybe(f"b{rng.randrange(6)}"), maybe(f"s{rng.randrange(5)}"), maybe(rng.choice(["45", "30", "UNKNOWN"])),
             maybe(rng.choice(["OPEN", "RESTRICTED"])), maybe(float(rng.randrange(1, 5))), maybe(float(rng.randrange(3))),
             maybe(dt.date(2000 + rng.randrange(3), 1, rng.randrange(1, 8))), maybe(float(rng.randrange(1, 90)))) for _ in range(300)]
    df = spark.createDataFrame(rows + rows[:40], COLUMNS)
    return df.withColumn("award_year", F.year("award_date")).withColumn("final_price", F.col("contract_value")).withColumn("estimated_price", F.col("contract_value"))


def test_features_are_those_of_the_single_joins(spark):
    c = _contracts(spark).localCheckpoint()
    rows = c.where("buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0").withColumn("competition_risk", competition_risk())
    past = hist.supplier_behavior(c, parity=False).select("supplier_id", F.col("focal_contract").alias("contract_id"),
                                                          F.col("focal_award_date").alias("award_date"), "single_bid_rate", "cpv_diversity")
    want = (rows.join(eco.buyer_dependency(c).select("buyer_id", "buyer_dependency_ratio"), "buyer_id", "left")
            .join(eco.hist_hhi_asof(c), ["buyer_id", "award_year"], "left").join(past, ["supplier_id", "contract_id", "award_date"], "left"))
    key = ["contract_id", "buyer_id", "supplier_id", "award_year", "contract_value", "bid_count", "competition_risk"]
    zero = lambda x: F.round(F.coalesce(x, F.lit(0)).cast("double"), 9)
    want = want.select(*key, *[zero(F.col(x)) for x in ("buyer_dependency_ratio", "hhi_asof", "single_bid_rate", "cpv_diversity")])
    got = gov.governance_features(c).select(*key, *[zero(F.col(x)) for x in (
        "buyer_dependency_ratio", "buyer_concentration_hhi", "single_bid_rate", "supplier_cpv_diversity")])
    assert got.count() == rows.count()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_fact_rows_are_not_grouped_by_contract(spark):
    plan = gov.governance_features(_contracts(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "contract_id" in x.split("]")[0]]
    assert not [x for x in plan.splitlines() if "Join LeftOuter" in x and "contract_id" in x]
