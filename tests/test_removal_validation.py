"""R17 in full, R12 and I05 on the hand-computed graph and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tenderscope.operators.graph import communities as co
from tenderscope.operators.graph import iterative as gi
from tenderscope.operators.graph import metrics as gm
from tenderscope.operators.graph import removal as rm

EDGE = "src string, dst string, weight double, contracts long"


def scenario(spark, rows):
    return spark.createDataFrame(rows, "scenario_id string, node_id string")


def test_h2_removals(spark, h2):
    sc = scenario(spark, [("x", "S_s2"), ("y", "B_b1"), ("all", "S_s1"), ("all", "S_s2"), ("all", "S_s3")])
    shift = {(r["scenario_id"], r["buyer"]): (r["dependency_before"], r["dependency_after"]) for r in rm.dependency_shift(h2, sc).collect()}
    assert shift["x", "B_b1"] == (pytest.approx(2 / 3), 1.0) and shift["x", "B_b2"] == (1.0, 0.0)
    assert not [k for k in shift if k[0] == "y"] and shift["all", "B_b3"] == (1.0, 0.0)
    share = {r["scenario_id"]: (r["largest_component_share_before"], r["largest_component_share_after"])
             for r in rm.removal_component_shares(h2, sc).collect()}
    assert share == {"x": (pytest.approx(2 / 3), pytest.approx(2 / 5)), "y": (pytest.approx(2 / 3), pytest.approx(2 / 5)),
                     "all": (pytest.approx(2 / 3), pytest.approx(1 / 3))}
    flags = {(r["scenario_id"], r["node_id"]): r["is_articulation_point"] for r in rm.removed_cut_vertices(h2, sc).collect()}
    assert flags == {("x", "S_s2"): True, ("y", "B_b1"): True, ("all", "S_s1"): False, ("all", "S_s2"): True, ("all", "S_s3"): False}


def test_removals_against_sets(spark):
    rng = random.Random(4)
    edges = [(f"B_{b}", f"S_{s}", float(rng.randrange(1, 9)), 1) for b, s in sorted({(rng.randrange(20), rng.randrange(15)) for _ in range(90)})]
    df = spark.createDataFrame(edges, EDGE)
    cpv = {f"B_{b}": rng.choice(["a", "b", None]) for b in range(20)}
    part = {n: rng.choice("xyz") for e in edges for n in e[:2]}
    sets = {"one": {"S_3"}, "mix": {"S_1", "S_2", "B_4"}, "many": {f"S_{k}" for k in range(15)}}
    present = {n for e in edges for n in e[:2]}
    sc = scenario(spark, [(k, n) for k, v in sets.items() for n in v & present])
    got = {(r["scenario_id"], r["buyer"]): r["substitutes"] for r in rm.substitutability(
        df, sc, spark.createDataFrame(list(cpv.items()), "node_id string, category string")).collect()}
    value = {(r["scenario_id"], r["community_id"]): r["internal_value_removed_share"] for r in rm.community_value_removed(
        df, sc, spark.createDataFrame(list(part.items()), "node_id string, community_id string")).collect()}
    for k, gone in sets.items():
        hit = {b for b, s, *_ in edges if s in gone} - gone
        assert {b for (j, b) in got if j == k} == hit
        for b in hit:
            active = {s for c, s, *_ in edges if cpv[c] is not None and cpv[c] == cpv[b]}
            assert got[k, b] == len(active - gone)
        touched = {part[n] for n in gone & present}
        assert {c for (j, c) in value if j == k} == touched
        for c in touched:
            inner = [(b, s, w) for b, s, w, _ in edges if part[b] == part[s] == c]
            lost = sum(w for b, s, w in inner if b in gone or s in gone)
            assert value[k, c] == pytest.approx(lost / sum(w for *_, w in inner) if inner else 0.0)


def test_validation_row(spark, h2):
    part, q = co.louvain(h2)
    pairs = gm.pairwise_ari(co.louvain_seeds(h2, (42, 892, 7739)), 20)
    giant = gi.giant_component_edges(h2, gi.connected_components(h2))
    assert giant.agg(F.sum("weight")).first()[0] == 20.0
    scores = co.partition_scores(giant, (42, 892), 20)
    row = co.validation_row(h2, part, co.null_model_test(h2, rewires=4, rounds=2, group=3), pairs, scores,
                            gi.component_summary(gi.connected_components(h2)), 0.7, 42).collect()
    assert len(row) == 1
    r = row[0]
    assert r["modularity"] == pytest.approx(q.first()["modularity"]) and r["giant_component_frac"] == pytest.approx(4 / 6)
    assert r["modularity_giant"] == pytest.approx(scores.first()["modularity"]) and r["ari_target"] == 0.7 and r["seed"] == 42
    assert -1 <= r["ari_min"] <= r["ari_median"] <= r["ari_max"] <= 1 and 0 <= r["modularity_pvalue"] <= 1
    assert set(r.asDict()) == {
        "modularity", "modularity_null_mean", "modularity_null_std", "modularity_zscore", "modularity_pvalue", "modularity_significant",
        "conductance_mean", "conductance_median", "conductance_low_frac", "ari_mean", "ari_min", "ari_median", "ari_max", "ari_topk_mean",
        "ari_target", "seed", "giant_component_frac", "modularity_giant", "conductance_giant_mean", "conductance_giant_median",
        "conductance_giant_low_frac", "ari_giant_mean", "ari_giant_min", "ari_giant_median", "ari_giant_max"}
