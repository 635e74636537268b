"""Segmented prefix sums, exact grouped quantiles and the queries that stand on them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderscope.operators import competition, pricing, views
from tenderscope.operators.common import grouped_quantiles, segmented_prefix
from tenderscope.operators.graph import metrics


def hot_rows(n=600, seed=2):
    rng = random.Random(seed)
    return [(k, rng.choice(["hot"] * 8 + ["a", "b", "c", None]), rng.choice([rng.randrange(6) * 1.0, rng.random() * 9])) for k in range(n)]


def test_running_sums_of_a_key_that_spans_ranges(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(5)
    got = segmented_prefix(df, ["g"], [F.col("v"), F.col("id")], {"v": F.col("v"), "n": F.lit(1)}, buckets=7).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, g, v in rows if g == r["g"] and (v, k) <= (r["v"], r["id"])]
        assert r["_cum_n"] == len(before) and r["_cum_v"] == pytest.approx(sum(before))


def test_a_hot_key_is_dealt_over_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id"))
    dealt = df.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 2 * sorted(r["count"] for r in dealt)[4]
    out = segmented_prefix(df, ["g"], [F.col("id")], {"n": F.lit(1)}, buckets=8).where("g = 'hot'")
    assert out.agg(F.max("_cum_n"), F.countDistinct("_cum_n")).first() == (10_000, 10_000)


def test_quantiles_equal_numpy(spark):
    rows = hot_rows() + [(1000, "nulls", None), (1001, "one", 4.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(4)
    asked = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", asked).collect()}
    assert set(got) == {"hot", "a", "b", "c", None, "one"}
    for g, r in got.items():
        values = [v for _, h, v in rows if h == g and v is not None]
        for name, q in asked.items():
            assert r[name] == pytest.approx(np.quantile(values, q))
    whole = grouped_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.median([v for *_, v in rows if v is not None]))
    assert grouped_quantiles(df.where("false"), [], "v", {"m": 0.5}).collect()[0]["m"] is None
    assert grouped_quantiles(df.where("false"), ["g"], "v", {"m": 0.5}).count() == 0


def test_no_query_holds_a_group_for_its_quantile(h1, spark):
    priced = pricing.price_proxy(h1)
    cond = spark.createDataFrame([("a", 0.2), ("b", 0.4)], "community_id string, conductance double")
    for df in (competition.procedure_analysis(h1), competition.cpv_coverage(h1), competition.dataset_summary(h1),
               pricing.priced_cpv_coverage(priced), views.box_stats(priced, "cpv_division", "log_price"),
               pricing.median_baseline_rmse(priced, "cpv_division", "log_price", "log_estimated_price"),
               metrics.conductance_summary(cond)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan and "median(" not in plan


def ari(a, b):
    from collections import Counter
    c2 = lambda n: n * (n - 1) / 2
    ij, i, j = (sum(c2(n) for n in Counter(x).values()) for x in (zip(a, b), a, b))
    expected, most = i * j / c2(len(a)), (i + j) / 2
    return 1.0 if most == expected else (ij - expected) / (most - expected)


def test_pairwise_ari(spark):
    rng = random.Random(8)
    nodes, seeds = range(80), (5, 1, 9)
    label = {s: [rng.randrange(6) if rng.random() < 0.4 else k % 5 for k in nodes] for s in seeds}
    df = spark.createDataFrame([(s, f"n{k}", str(label[s][k])) for s in seeds for k in nodes], "seed long, node_id string, community_id string")
    got = {(r["scope"], r["seed_a"], r["seed_b"]): (r["n"], r["ari"]) for r in metrics.pairwise_ari(df, top_k=2).collect()}
    sizes = sorted({x: label[1].count(x) for x in set(label[1])}.items(), key=lambda t: (-t[1], str(t[0])))
    core = [k for k in nodes if label[1][k] in {x for x, _ in sizes[:2]}]
    for a, b in ((1, 5), (1, 9), (5, 9)):
        assert got["whole", a, b] == (80, pytest.approx(ari(label[a], label[b])))
        assert got["top_k", a, b] == (len(core), pytest.approx(ari([label[a][k] for k in core], [label[b][k] for k in core])))
    one = metrics.ari_summary(metrics.pairwise_ari(df, top_k=2)).first()
    scores = sorted(got["whole", a, b][1] for a, b in ((1, 5), (1, 9), (5, 9)))
    assert (one["ari_min"], one["ari_median"], one["ari_max"]) == tuple(pytest.approx(x) for x in scores)


def test_quantiles_over_all_rows_shuffle_no_rows_by_one_key(spark):
    from tenderscope.operators.common import grouped_quantiles
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    q = grouped_quantiles(df, [], "v", {"a": 0.5, "b": 0.255})
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    r = q.first()
    assert r["a"] == 50.0 and abs(r["b"] - 25.5) < 1e-9
    assert grouped_quantiles(df.where("v IS NULL"), [], "v", {"a": 0.5}).collect()[0]["a"] is None
