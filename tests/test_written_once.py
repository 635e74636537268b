"""What a query reads several times is written first."""

import pytest
from pyspark.sql import functions as F

from tenderscope.operators import sampling as smp
from tenderscope.operators import stats as st
from tenderscope.operators import views as vw


def counted(spark, df):
    """``df`` that counts in an accumulator how often each of its rows is made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), seen


def test_curves_run_their_input_once(spark):
    rows = [(float(k % 7), float(k % 5), k % 3 == 0) for k in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y boolean").withColumn("y", F.col("y").cast("int"))
    got, seen = counted(spark, df)
    cdf = {r["a"]: r["cdf"] for r in vw.empirical_cdf(got, "a").collect()}
    assert cdf == {v: pytest.approx(sum(a <= v for a, *_ in rows) / 60) for v in {a for a, *_ in rows}}
    assert seen.value == 60
    got, seen = counted(spark, df)
    one, plain = st.delong_paired(got, "y", "a", "b").first(), st.delong_paired(df, "y", "a", "b").first()
    assert tuple(one) == pytest.approx(tuple(plain)) and seen.value == 60


def test_sample_reads_its_edges_once(spark):
    df = spark.createDataFrame([(f"B_{k % 9}", f"S_{k}", float(k % 11), 1) for k in range(100)], "src string, dst string, weight double, contracts long")
    got, seen = counted(spark, df)
    assert smp.value_stratified_edge_sample(got, 0.35, 42).count() == sum(round(10 * 0.35 + 1e-9) for _ in range(10))
    assert seen.value <= 200
