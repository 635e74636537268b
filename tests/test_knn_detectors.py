"""Exact kNN (LOF building block) against brute force; detector invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderscope.operators.ml import detectors as det


def test_knn_exact(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(150, 3)), rng.normal(4, 0.05, size=(6, 3))])
    x[:30, 1] = 0.0
    cols = ["a", "b", "c"]
    ref = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(len(x)), x], columns=["rid"] + cols).astype({"rid": int}))
    got = det.knn(ref.withColumnRenamed("rid", "qid"), ref, cols, 4, window=4).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(len(x)):
        assert np.allclose(np.sort(got[got.qid == i].dist.to_numpy()), np.sort(d[i])[:4])


def equal_rows(seed=4):
    """Half of all rows are one of three points."""
    rng = np.random.default_rng(seed)
    spots = np.array([[0.0, 0.0], [1.0, 2.0], [3.0, 0.5]])
    return np.vstack([spots[rng.integers(0, 3, 120)], rng.normal(1, 1.5, size=(120, 2))])


def brute_lof(ref, query, k):
    """Novelty LOF with k neighbours counted one by one; a reference row is not its own neighbour."""
    def nearest(x, leave):
        d = np.sqrt(((ref - x) ** 2).sum(1))
        if leave is not None:
            d[leave] = np.inf
        return np.sort(d)[:k], np.argsort(d, kind="stable")[:k]
    near = [nearest(x, i) for i, x in enumerate(ref)]
    kd = np.array([d[-1] for d, _ in near])
    lrd = np.array([1 / (np.maximum(d, kd[i]).mean() + 1e-10) for d, i in near])
    out = []
    for x in query:
        d, i = nearest(x, None)
        out.append(lrd[i].mean() * (np.maximum(d, kd[i]).mean() + 1e-10))
    return np.array(out)


def test_lof_with_half_of_the_rows_equal(spark, monkeypatch):
    x = equal_rows()
    ref = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(len(x)), x], columns=["rid", "a", "b"]).astype({"rid": int}))
    query = np.vstack([x[:40], [[9.0, 9.0], [0.0, 0.0], [2.0, 1.0]]])
    q = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(len(query)), query], columns=["qid", "a", "b"]).astype({"qid": int}))
    pairs, search = [], det.weighted_knn
    monkeypatch.setattr(det, "weighted_knn", lambda *a, **k: pairs.append((a[0].count(), a[1].count())) or search(*a, **k))
    got = det.lof_scores(q, ref, ["a", "b"], 10).toPandas().sort_values("qid")["lof_score"].to_numpy()
    want = brute_lof(x, query, 10)
    # where a k-distance is 0 densities are 1e10: both are huge then
    assert len(got) == len(query) and np.allclose(got, want, rtol=1e-6)
    assert pairs[0] == (123, 123)  # distinct points only


def test_covariance_is_not_masked(spark):
    """30 % of shifted rows: their distances stay far beyond those of all others; equal runs give equal results."""
    rng = np.random.default_rng(9)
    good, bad = rng.normal(size=(700, 3)), rng.normal(6, 0.3, size=(300, 3))
    x = np.vstack([good, bad])
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, np.r_[np.zeros(700), np.ones(300)]], columns=["a", "b", "c", "bad"])).repartition(4)
    m = det.fit_robust_covariance(df, ["a", "b", "c"])
    assert np.abs(m["mean"]).max() < 0.3
    s = det.score_robust_covariance(df, m).toPandas()
    assert s[s.bad == 1]["ee_score"].min() > s[s.bad == 0]["ee_score"].quantile(0.99)
    again = det.fit_robust_covariance(df.repartition(7), ["a", "b", "c"])
    assert np.allclose(m["mean"], again["mean"]) and np.allclose(m["inv"], again["inv"])


def test_isolation_samples_are_bounded(spark):
    df = spark.range(60_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    m = det.fit_isolation_forest(df, ["a", "b"], trees=20, sample_size=64)
    assert m["psi"] == 64 and len(m["forest"]) == 20
    assert all(t[t[:, 0] < 0][:, 4].sum() == 64 for t in m["forest"])  # leaf sizes of each tree


def test_isolation_forest_ranks_outlier(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 2)), [[8.0, 8.0]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    m = det.fit_isolation_forest(df, ["a", "b"], trees=30, sample_size=64)
    s = det.score_isolation_forest(df, m).toPandas()
    assert s["iso_score"].idxmax() == 300


def test_privacy_pseudonym(spark):
    import hashlib
    from tenderscope.functions.privacy import pseudonym
    df = spark.createDataFrame([(" 42 ",), (None,), ("None",)], "x string")
    got = [r[0] for r in df.select(pseudonym("x", "salt", "B")).collect()]
    exp = "B#" + hashlib.sha256(b"salt42").hexdigest()[:6].upper()
    assert got == [exp, "unknown", "unknown"]


def test_access_log_formats(spark):
    from tenderscope.sources.access_log import parse_access_log
    lines = spark.createDataFrame([("2026-01-01\tadmin\treveal\tbuyer/1\tsuccess",), ("2026-01-02\tviewer\tsign_in\t-",),
                                   ("bad line",), ("",)], "value string")
    out = {r["ts"]: r for r in parse_access_log(lines).collect()}
    assert out["2026-01-01"]["action"] == "reveal" and out["2026-01-02"]["action"] == "Sign In"
    assert out["2026-01-02"]["outcome"] == "sign_in" and len(out) == 2


def test_access_log_stream(spark, tmp_path):
    from tenderscope.streaming.access_log import start_counts
    src = tmp_path / "log"
    src.mkdir()
    (src / "a.log").write_text("t1\tadmin\treveal\tx\tsuccess\nt2\tviewer\tview\ty\tfailure\n")
    q = start_counts(spark, str(src), str(tmp_path / "ckpt"), name="acc_counts_test")
    try:
        q.processAllAvailable()
        (src / "b.log").write_text("t3\tadmin\treveal\tz\tsuccess\n")
        q.processAllAvailable()
        rows = {(r["role"], r["action"]): r["events"] for r in spark.sql("SELECT * FROM acc_counts_test").collect()}
    finally:
        q.stop()
    assert rows[("admin", "reveal")] == 2 and rows[("viewer", "view")] == 1


def test_blocks_hold_their_rows_whatever_the_density():
    rng = np.random.default_rng(5)
    # half of the rows in a speck, the others in long tails
    x = np.vstack([rng.normal(size=(4000, 3)) * 1e-4, rng.standard_t(2, size=(4000, 3)) * 50])
    tree = det._kd_tree(x, 64)
    row, block = det._kd_blocks(tree, x)
    assert sorted(row) == list(range(len(x))) and np.bincount(block).max() <= 64
    d = np.sqrt(((x[::40, None] - x[None]) ** 2).sum(2))
    far = np.sort(d, axis=1)[:, 10]
    row_of, seen = _visited(tree, x[::40], far)
    for i in range(len(far)):
        near = set(block[np.argsort(row)][d[i] <= far[i]])
        assert near <= seen[i]  # no neighbour lies in a block that is not visited
    assert len(row_of) < 20 * len(far)  # a row visits a few of the 125 and more blocks


def _visited(tree, x, far):
    row, block = det._kd_blocks(tree, x, far)
    seen = {}
    for i, b in zip(row, block):
        seen.setdefault(int(i), set()).add(b)
    return row, seen


def test_knn_over_many_blocks_leaves_out_rows_with_nulls(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(900, 2)) * 1e-3, rng.standard_t(2, size=(300, 2)) * 20])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    ref = spark.createDataFrame(rows + [(5000 + i, float(x[i, 0]), None) for i in range(0, 1200, 3)], "rid long, a double, b double")
    query = ref.withColumnRenamed("rid", "qid")
    got = det.knn(query, ref, ["a", "b"], 6, window=1).toPandas()
    assert got["qid"].max() < 5000 and got["rid"].max() < 5000
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for qid, g in got.groupby("qid"):
        want = np.lexsort((np.arange(len(x)), d[qid]))[:6]
        assert g.sort_values(["dist", "rid"])["rid"].tolist() == want.tolist()
    assert got["qid"].nunique() == len(x)
