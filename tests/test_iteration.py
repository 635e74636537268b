"""Iterative jobs: exactness, convergence, bounded plans; rewiring keeps degrees."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenderscope.operators.common import average_rank
from tenderscope.operators.graph import iterative as gi
from tenderscope.operators.graph.communities import rewire
from tenderscope.operators.ml.detectors import chi2_quantile
from tenderscope.operators.sampling import position_in_group

EDGE = "src string, dst string, weight double, contracts long"


def random_edges(rng, n, buyers, suppliers):
    pairs = sorted({(f"B_{rng.randrange(buyers)}", f"S_{rng.randrange(suppliers)}") for _ in range(n)})
    return [(a, b, float(rng.randrange(1, 9)), 1) for a, b in pairs]


def test_long_path_is_one_component(spark):
    n = 120
    rows = [(f"B_{k // 2:03d}", f"S_{(k + 1) // 2:03d}", 1.0, 1) for k in range(n)]
    comps = gi.connected_components(spark.createDataFrame(rows, EDGE)).collect()
    assert len(comps) == n + 1 and {r["component_id"] for r in comps} == {"B_000"}


def test_rounds_grow_with_the_logarithm_of_a_path(spark):
    n = 100_000
    # numbers along the path are dealt at random: neighbours are far apart
    path = spark.range(n).select((F.col("id") * 48271 % (n + 1)).alias("a"), ((F.col("id") + 1) * 48271 % (n + 1)).alias("b"))
    store = gi.Rounds(spark, "path")
    stars = gi.star_components(path, store)
    assert stars.agg(F.count(F.lit(1)), F.max("root"), F.countDistinct("v")).first() == (n, 0, n)
    assert store._written <= 2 * n.bit_length()
    store.close()


def test_components_of_many_graphs(spark):
    rows = [("x", "B_1", "S_1"), ("x", "B_2", "S_1"), ("y", "B_1", "S_1"), ("y", "B_2", "S_2"), ("y", "B_3", "S_2")]
    got = {(r["k"], r["node_id"]): r["component_id"] for r in gi.connected_components(spark.createDataFrame(rows, "k string, src string, dst string"), ("k",)).collect()}
    assert got == {("x", "B_1"): "B_1", ("x", "B_2"): "B_1", ("x", "S_1"): "B_1", ("y", "B_1"): "B_1", ("y", "S_1"): "B_1",
                   ("y", "B_2"): "B_2", ("y", "B_3"): "B_2", ("y", "S_2"): "B_2"}


def test_components_against_union_find(spark):
    rows = random_edges(random.Random(3), 60, 50, 50)
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b, *_ in rows:
        parent[find(a)] = find(b)
    least = {}
    for x in list(parent):
        least[find(x)] = min(least.get(find(x), x), x)
    got = {r["node_id"]: r["component_id"] for r in gi.connected_components(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {x: least[find(x)] for x in parent}


def test_pagerank_raises_when_it_does_not_converge(spark, h2):
    with pytest.raises(RuntimeError):
        gi.pagerank(h2, max_iter=2, tol=1e-12)
    ranks = gi.pagerank(h2)
    assert ranks.agg(F.sum("pagerank")).first()[0] == pytest.approx(1.0, abs=1e-6)
    # a round refers to the one before by a single scan: the plan stays small
    assert len(ranks._jdf.queryExecution().optimizedPlan().toString()) < 3000


def test_rewire_keeps_degrees(spark):
    rows = random_edges(random.Random(5), 300, 30, 40)
    df = spark.createDataFrame(rows, EDGE)
    out = [(r["src"], r["dst"]) for r in rewire(df, seed=7, rounds=4).collect()]
    assert len(out) == len(set(out)) == len(rows)
    for k in (0, 1):
        assert Counter(e[k] for e in out) == Counter(r[k] for r in rows)
    assert set(out) != {(r[0], r[1]) for r in rows}


def test_average_rank_over_all_rows(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1.0, 2.0, 2.0, 3.5, float(rng.randrange(50))]) for _ in range(200)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double")
    got = {r["id"]: r["r"] for r in average_rank(df, "v", "r").collect()}
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    for k, v in enumerate(values):
        places = [p + 1 for p, w in enumerate(order) if w == v]
        assert got[k] == pytest.approx(sum(places) / len(places))


def test_position_in_group(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(100)], "g int, k int")
    got = position_in_group(df, "g", [F.col("k").desc()]).collect()
    for r in got:
        mine = sorted((k for g, k in [(k % 3 if k % 7 else None, k) for k in range(100)] if g == r["g"]), reverse=True)
        assert (r["_rn"], r["_nd"]) == (mine.index(r["k"]) + 1, len(mine))


def test_chi2_quantiles():
    assert chi2_quantile(0.975, 4) == pytest.approx(11.1433, abs=1e-3)
    assert chi2_quantile(0.5, 4) == pytest.approx(3.3567, abs=1e-3)
    assert chi2_quantile(0.975, 1) == pytest.approx(5.0239, abs=1e-3)
