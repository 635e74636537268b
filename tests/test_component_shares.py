"""Removals label the graph without the named nodes once and copy only the edges at named nodes."""

import random

import pytest

from tenderscope.operators.graph import removal as rm


def brute(edges, gone):
    left = {n for e in edges for n in e} - gone
    near = {n: set() for n in left}
    for a, b in edges:
        if a in left and b in left:
            near[a].add(b)
            near[b].add(a)
    best, seen = 0, set()
    for n in left:
        if n not in seen:
            todo, part = [n], {n}
            while todo:
                for x in near[todo.pop()] - part:
                    part.add(x)
                    todo.append(x)
            seen |= part
            best = max(best, len(part))
    return best / len(left) if left else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_component_shares_against_sets(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"B_{rng.randrange(25)}", f"S_{rng.randrange(22)}") for _ in range(34)})
    nodes = sorted({n for e in edges for n in e})
    sets = {"one": {rng.choice(nodes)}, "three": set(rng.sample(nodes, 3)), "half": set(rng.sample(nodes, len(nodes) // 2)),
            "all": set(nodes), "unknown": {"S_none"}}
    df = spark.createDataFrame([(a, b, 1.0, 1) for a, b in edges], "src string, dst string, weight double, contracts long")
    sc = spark.createDataFrame([(k, n) for k, v in sets.items() for n in v], "scenario_id string, node_id string")
    got = {r[0]: r[1:] for r in rm.removal_component_shares(df, sc).collect()}
    assert set(got) == set(sets)
    for k, gone in sets.items():
        assert got[k] == (pytest.approx(brute(edges, set())), pytest.approx(brute(edges, gone) if gone & set(nodes) != set(nodes) else 0.0)), k


def test_component_shares_copy_only_edges_of_named_nodes(spark, monkeypatch):
    edges = [(f"B_{k}", f"S_{k // 2}") for k in range(40)] + [("B_0", "S_9")]
    df = spark.createDataFrame([(a, b, 1.0, 1) for a, b in edges], "src string, dst string, weight double, contracts long")
    sizes, real = [], rm.connected_components
    monkeypatch.setattr(rm, "connected_components", lambda e, *a: (sizes.append(e.count()), real(e, *a))[1])
    sc = spark.createDataFrame([("x", "S_9"), ("y", "B_3"), ("z", "S_9"), ("z", "B_3")], "scenario_id string, node_id string")
    got = {r[0]: r[2] for r in rm.removal_component_shares(df, sc).collect()}
    assert got == {k: pytest.approx(brute(edges, g)) for k, g in {"x": {"S_9"}, "y": {"B_3"}, "z": {"S_9", "B_3"}}.items()}
    assert sum(sizes) < len(edges) + 4 * 4 + 1
    assert rm.removal_component_shares(df, sc.limit(0)).count() == 0
