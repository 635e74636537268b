"""Plan checks: the canonical view scan prunes partitions and columns."""

from pyspark.sql import functions as F

from tenderscope.sources.contracts import canonical_contracts


def test_year_and_column_pruning(spark):
    df = canonical_contracts(spark, "/root/testdata/sf0.001").where(F.col("award_year") == 1996).select("buyer_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(award_year" in plan and "= 1996" in plan
    assert "ReadSchema: struct<buyer_id:string>" in plan
    assert df.count() > 0
