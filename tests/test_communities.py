import statistics

import pytest
from pyspark.sql import functions as F

from tenderscope.operators.graph import communities as co
from tenderscope.operators.graph.communities import _louvain, louvain, null_model_test


def test_louvain_h2(h2):
    part, q = louvain(h2)
    assert part.count() == 6
    assert q.first()["modularity"] >= 0.384088 - 1e-9


def test_louvain_two_cliques(spark):
    e = [(f"B_{i}", f"S_{j}", 1.0, 1) for i in range(3) for j in range(3)]
    e += [(f"B_{i}", f"S_{j}", 1.0, 1) for i in range(3, 6) for j in range(3, 6)]
    e += [("B_0", "S_3", 0.1, 1)]
    df = spark.createDataFrame(e, "src string, dst string, weight double, contracts long")
    part, q = louvain(df)
    c = {r["node_id"]: r["community_id"] for r in part.collect()}
    assert c["B_0"] == c["S_1"] and c["B_4"] == c["S_5"] and c["B_0"] != c["B_4"]
    assert q.first()["modularity"] > 0.45


def test_level_ends_only_when_no_vertex_wants_to_move(spark, monkeypatch):
    """One heavy pair of edges holds nearly all weight: the moves of the light cliques raise modularity by less than 1e-4."""
    e = [(f"B_h{i}", f"S_h{i}", 1e6, 1) for i in range(2)]
    e += [(f"B_{c}_{i}", f"S_{c}_{j}", 1.0, 1) for c in range(8) for i in range(4) for j in range(4)]
    levels, moving = [], co._local_moving

    def seen(w, *args):
        comm = moving(w, *args)
        levels.append((w.collect(), comm.collect()))  # the tables go with their round
        return comm

    monkeypatch.setattr(co, "_local_moving", seen)
    louvain(spark.createDataFrame(e, "src string, dst string, weight double, contracts long"))
    w, comm = levels[0]
    at, m2 = {r["vid"]: r["comm"] for r in comm}, 2 * sum(x[2] for x in e)
    k, kin, tot = {}, {}, {}
    for r in w:
        k[r["a"]] = k.get(r["a"], 0) + r["weight"]
        kin.setdefault(r["a"], {}).setdefault(at[r["b"]], []).append(r["weight"])
    for v, c in at.items():
        tot[c] = tot.get(c, 0) + k[v]
    gain = lambda v, c: sum(kin[v].get(c, [])) - (tot[c] - (k[v] if c == at[v] else 0)) * k[v] / m2
    assert not [v for v, c in at.items() if any(gain(v, d) > gain(v, c) + 1e-9 for d in kin[v])]


def test_null_model_replicates_have_a_test(spark):
    """Separate cliques against their rewired graphs: many replicates in one job, observed above all of them."""
    e = [(f"B_{c}_{i}", f"S_{c}_{j}", 1.0, 1) for c in range(6) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(e, "src string, dst string, weight double, contracts long")
    rows = null_model_test(df, rewires=12, rounds=5).collect()
    assert [r["rep"] for r in sorted(rows, key=lambda r: r["rep"])] == list(range(12))
    null, r = [r["modularity"] for r in rows], rows[0]
    assert r["null_mean"] == pytest.approx(sum(null) / 12) and r["null_std"] == pytest.approx(statistics.pstdev(null))
    assert r["observed"] == pytest.approx(1 - 1 / 6)
    assert r["p_value"] == sum(q >= r["observed"] for q in null) / 12 == 0.0 and r["significant"] and r["z"] > 0
    assert len(set(null)) > 1


def test_seeds_give_partitions_of_their_own(spark):
    import random
    rng = random.Random(1)
    e = sorted({(f"B_{rng.randrange(40)}", f"S_{rng.randrange(25)}") for _ in range(160)})
    df = spark.createDataFrame([(a, b, float(rng.randrange(1, 9)), 1) for a, b in e], "src string, dst string, weight double, contracts long")
    part = co.louvain_seeds(df, (42, 892, 7739))
    nodes = {x for p in e for x in p}
    rows = part.collect()
    assert {r["seed"] for r in rows} == {42, 892, 7739} and len(rows) == 3 * len(nodes)
    same = co.louvain_seeds(df, (42, 892, 7739)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, same))
    assert len({tuple(sorted((r["node_id"], r["community_id"]) for r in rows if r["seed"] == s)) for s in (42, 892, 7739)}) > 1


def test_rounds_hold_a_constant_number_of_tables(spark):
    """Ten rounds and a hundred leave one table a slot, and plans of one scan."""
    import os
    from tenderscope.operators.graph.iterative import Rounds
    sizes = []
    for n in (10, 100):
        rounds = Rounds(spark, "test")
        df = rounds.put("state", spark.range(50).withColumn("x", F.lit(0)))
        for _ in range(n):
            df = rounds.put("state", df.withColumn("x", F.col("x") + 1), odd=F.count_if(F.col("id") % 2 == 1))
        assert rounds.seen == {"odd": 25} and df.agg(F.sum("x")).first()[0] == 50 * n
        folder = rounds.folder.removeprefix("file:")
        assert len(rounds.tables()) == 1 and len(os.listdir(folder)) == 1
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        rounds.close()
        assert not os.path.exists(folder)
    assert sizes[0] == sizes[1]


def test_trades_keep_degrees_and_weights(spark):
    import random
    from collections import Counter
    rng = random.Random(6)
    e = sorted({(r, f"B_{rng.randrange(30)}", f"S_{rng.randrange(40)}") for _ in range(500) for r in (0, 1)})
    e += [(r, "B_hub", f"S_{k}") for r in (0, 1) for k in range(40)]
    rows = [(r, a, b, float(k % 7)) for k, (r, a, b) in enumerate(e)]
    df = spark.createDataFrame(rows, "rep int, src string, dst string, weight double")
    for block in (1 << 16, 8):
        out = [tuple(r) for r in co.trade(df, 3, 4, ("rep",), block=block).select("rep", "src", "dst", "weight").collect()]
        assert len({x[:3] for x in out}) == len(out) == len(rows)
        assert Counter((r, d) for r, _, d, _ in out) == Counter((r, d) for r, _, d, _ in rows)
        assert Counter((r, s, w) for r, s, _, w in out) == Counter((r, s, w) for r, s, _, w in rows)
        assert len({x[:3] for x in out} - {x[:3] for x in rows}) > len(rows) / 4


def test_many_graphs_end_like_one(spark):
    """A replicate's partition does not depend on the graphs that run beside it: each has the best of its own levels."""
    rows = [(0, "B_0", "S_0", 1.0), (0, "B_1", "S_1", 1.0)]
    rows += [(1, f"B_{c}_{i}", f"S_{c}_{j}", 2.0) for c in range(2) for i in range(3) for j in range(3)]
    part, q = _louvain(spark.createDataFrame(rows, "rep int, src string, dst string, weight double"), 42)
    assert q == {0: pytest.approx(0.5), 1: pytest.approx(0.5)}
    assert part.groupBy("rep").agg(F.count_distinct("community_id").alias("n")).where("n = 2").count() == 2


def test_registered_null_model_has_the_published_replicates(monkeypatch):
    from tenderscope.plans import graph
    asked = {}
    monkeypatch.setattr(graph, "edges", lambda *a: None)
    monkeypatch.setattr(graph, "_stored", lambda spark, sf_dir, name, build: build())
    monkeypatch.setattr(graph.gco, "null_model_test", lambda e, **k: asked.update(k))
    graph.r15_null_model(None, None)
    assert asked["rewires"] == 100 and asked["alpha"] == 0.01
