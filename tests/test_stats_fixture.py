"""Statistics on hand-computed inputs (FIXTURES.md H3)."""

import pytest
from pyspark.sql import functions as F

from tenderscope.operators import stats as st
from tenderscope.operators.common import minmax_scale
from tenderscope.functions.rules import risk_class


def test_auc_ap(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "y int, p double")
    r = st.roc_pr_auc(df, "y", "p").first()
    assert r["roc_auc"] == pytest.approx(0.75) and r["average_precision"] == pytest.approx(0.833333, abs=1e-6)


def test_coverage_corr_states(spark):
    rows = [(float(1000 - i) if i < 5 else None, float(i) if i < 5 else None) for i in range(1000)]
    r = st.coverage_aware_corr(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert r["status"] == "degenerate_low_coverage" and r["value"] is None and r["observed_value"] == pytest.approx(-1.0)
    rows = [(float(i) if i < 5 else None, 3.0) for i in range(100)]
    r = st.coverage_aware_corr(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert r["status"] == "measured_null" and r["value"] == 0.0
    rows = [(None, 1.0), (2.0, None), (None, None)]
    r = st.coverage_aware_corr(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert r["status"] == "degenerate_low_coverage" and r["observed_value"] is None


def test_minmax_constant(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    assert [r["s"] for r in minmax_scale(df, "x", "s").collect()] == [0.0, 0.0, 0.0]


def test_risk_class(spark):
    df = spark.createDataFrame([(0.75,), (0.45,), (0.4499,)], "p double")
    assert [r[0] for r in df.select(risk_class("p")).collect()] == ["HIGH", "MEDIUM", "LOW"]


def test_anova_chi2_pvalues():
    assert st.f_survival(3.0, 2, 10) == pytest.approx(0.0954, abs=1e-4)
    assert st.chi2_survival(3.84, 1) == pytest.approx(0.05, abs=1e-3)


def test_delong_auc_matches(spark):
    df = spark.createDataFrame([(0, .1, .2), (0, .4, .1), (1, .35, .9), (1, .8, .3), (0, .2, .5), (1, .6, .6)],
                               "y int, a double, b double")
    r = st.delong_paired(df, "y", "a", "b").first()
    ra = st.roc_pr_auc(df, "y", "a").first()["roc_auc"]
    rb = st.roc_pr_auc(df, "y", "b").first()["roc_auc"]
    assert r["auc_a"] == pytest.approx(ra) and r["auc_b"] == pytest.approx(rb)
    assert r["se"] > 0


def test_chi2_of_millions_of_rows(spark):
    d = spark.range(4_000_000).select((F.col("id") % 2).alias("r"), (F.col("id") % 2).alias("c"))
    one = st.chi2_independence(d, "r", "c").first()
    assert (one["chi2"], one["dof"], one["n"], one["cramers_v"]) == (pytest.approx(4e6), 1, 4_000_000, pytest.approx(1.0))
