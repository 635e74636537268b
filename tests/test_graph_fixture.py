"""Graph operators on the hand-computed graph H2."""

import pytest
from pyspark.sql import functions as F

from tenderscope.operators.graph import iterative as gi
from tenderscope.operators.graph import metrics as gm
from tenderscope.operators.graph import removal as grm


def test_components(h2):
    comps = gi.connected_components(h2)
    sizes = sorted(r["n"] for r in comps.groupBy("component_id").agg(F.count("*").alias("n")).collect())
    assert sizes == [2, 4]
    s = gi.component_summary(comps).first()
    assert s["giant_share"] == pytest.approx(4 / 6)


def test_modularity_components(h2):
    comps = gi.connected_components(h2).withColumnRenamed("component_id", "community_id")
    assert gm.modularity(h2, comps).first()["modularity"] == pytest.approx(0.384088, abs=1e-6)


def test_conductance(spark, h2):
    part = spark.createDataFrame([("B_b1", "A"), ("S_s1", "A"), ("S_s2", "B"), ("B_b2", "B"), ("B_b3", "C"), ("S_s3", "C")],
                                 "node_id string, community_id string")
    c = {r["community_id"]: r["conductance"] for r in gm.conductance(h2, part).collect()}
    assert c["A"] == pytest.approx(1 / 3) and c["B"] == pytest.approx(1 / 3) and c["C"] == 0.0
    s = gm.conductance_summary(gm.conductance(h2, part)).first()
    assert s["mean_conductance"] == pytest.approx(0.2222, abs=1e-4)
    assert s["median_conductance"] == pytest.approx(1 / 3)


def test_removal(spark, h2):
    sc = spark.createDataFrame([("rm_b1", "B_b1"), ("rm_s2", "S_s2")], "scenario_id string, node_id string")
    r = {x["scenario_id"]: x for x in grm.removal_impact(h2, sc).collect()}
    assert r["rm_b1"]["exposed_contract_value"] == pytest.approx(15.0)
    assert r["rm_b1"]["orphaned_counterparties"] == 1
    assert r["rm_s2"]["exposed_contract_value"] == pytest.approx(10.0)
    assert r["rm_s2"]["stranded_buyers"] == 1
    assert (r["rm_s2"]["sole_source_before"], r["rm_s2"]["sole_source_after"]) == (2, 2)
    sh = {x["scenario_id"]: x for x in grm.removal_component_shares(h2, sc).collect()}
    assert sh["rm_b1"]["largest_component_share_after"] == pytest.approx(2 / 5)
    assert sh["rm_s2"]["largest_component_share_after"] == pytest.approx(2 / 5)


def test_unknown_node_is_an_error(spark, h2):
    sc = spark.createDataFrame([("x", "B_nope")], "scenario_id string, node_id string")
    with pytest.raises(ValueError):
        grm.check_removal_set(h2, sc)


def test_ari(spark):
    a = spark.createDataFrame([(i, l) for i, l in enumerate([0, 0, 1, 1])], "node_id int, label int")
    b = spark.createDataFrame([(i, l) for i, l in enumerate([0, 0, 1, 2])], "node_id int, label int")
    assert gm.adjusted_rand_index(a, b).first()["ari"] == pytest.approx(0.571429, abs=1e-6)


def test_pagerank_invariants(h2):
    pr = gi.pagerank(h2).collect()
    assert sum(r["pagerank"] for r in pr) == pytest.approx(1.0, abs=1e-9)
    assert all(r["pagerank"] > 0 for r in pr) and len(pr) == 6
