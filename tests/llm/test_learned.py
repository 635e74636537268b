"""Quality classifier, secret scan and neighbour search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderscope.llm import quality, secrets, trees, vamana


def test_flattened_trees_learn_and_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    for model, cut in ((trees.boosted(x[:2000], y[:2000]), 0.0), (trees.random_forest(x[:2000], y[:2000]), 0.5)):
        raw = model.raw(x[2000:])
        assert ((raw > cut) == y[2000:]).mean() > 0.95
        slow = np.full(5, model.base)
        for f, t, v in zip(model.feature, model.threshold, model.value):
            for r in range(5):
                k = 0
                while k < len(f):
                    k = 2 * k + 1 + int(x[2000 + r, f[k]] > t[k])
                slow[r] += v[k - len(f)]
        assert raw[:5] == pytest.approx(slow)
    assert trees.boosted(x, np.ones(len(x))).raw(x[:3]).min() > 0
    assert trees.random_forest(x[:0], y[:0]).raw(x[:2]).tolist() == [0.0, 0.0]
    assert len(trees.boosted(x, y).raw(x[:0])) == 0


def corpus(n, seed):
    rng = random.Random(seed)
    def good():
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 200))) + "."
    def bad():
        return " ".join("".join(rng.choice("ABC") for _ in range(4)) + rng.choice(["!!", "###", " |"]) for _ in range(rng.randrange(5, 200)))
    rows = []
    for k in range(n):
        label = int(rng.random() < 0.7)
        rows.append((k, good() if label else bad(), label))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int").withColumn("score", F.lit("taken"))
    labels = docs.where("doc_id % 2 = 0").select("doc_id", F.col("truth").alias("quality"))
    model = quality.fit(quality.labelled_sample(docs, labels, "quality"))
    out = quality.score(docs, model).where("doc_id % 2 = 1").select("truth", "score").collect()
    assert np.mean([(r[1] >= 0.5) == r[0] for r in out]) > 0.97 and all(0 <= r[1] <= 1 for r in out)
    again = quality.fit(quality.labelled_sample(docs.repartition(5), labels.repartition(3), "quality"))
    assert np.array_equal(model.threshold, again.threshold)


def test_quality_edges(edges, edge_rows, nothing, spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(quality.labelled_sample(edges, none, "quality"))
    got = quality.score(edges, model)
    assert [r[0] for r in got.select("score").collect()] == [0.5] * len(edge_rows)
    assert "label" in got.columns and quality.score(nothing, model).count() == 0


def test_secrets_are_found_and_words_left_alone(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        text = " ".join(rng.choice(["the", "quick", "brown", "token", "foxes", "internationalization", "1234567890123456"]) for _ in range(40))
        if k % 3 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" and more'
        if k == 1:
            text += " -----BEGIN RSA PRIVATE KEY----- "
        if k == 2:
            text += f" see {rng.getrandbits(160):040x} there"  # no credential name around it
        rows.append((k, text, "src/a.py"))
    rows += [(None, None, None), (999, "", None), (998, rows[0][1], "src/a.py")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit(1)).withColumn("path", F.lit(2))
    got = secrets.find_secrets(df).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]][r["start"]:r["start"] + r["length"]] == r["value"] for r in got)
    assert {r["doc_id"] for r in got if r["is_secret"]} == {k for k in range(300) if k % 3 == 0} | {1, 2, 998}
    words = secrets.dictionary(df)
    model = secrets.fit(secrets.scan(df, words))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df, words, model).collect()}
    assert clean[0].endswith('token = "[SECRET]" and more') and clean[4] == texts[4] and clean[None] is None and clean[999] == ""


def test_forest_against_an_independent_truth(spark):
    """The generator knows what it planted; half of the keys stand behind no credential name, decoys look like keys."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    vocabulary = [word() for _ in range(300)] + ["administration", "international", "configuration"]
    def key():
        return "".join(rng.choice(letters + letters.upper() + "0123456789") for _ in range(rng.randrange(24, 44)))
    def decoy():
        return rng.choice(["_".join(rng.sample(vocabulary, 5)), "".join(rng.sample(vocabulary, 5)), f"{rng.randrange(10 ** 15, 10 ** 18)}",
                           "/".join(rng.sample(vocabulary, 6)), "=" * rng.randrange(16, 60)])
    rows, truth = [], set()
    for k in range(400):
        parts = rng.choices(vocabulary, k=60)
        for at, make, secret in ((10, decoy, False), (30, key, True), (50, decoy, False)):
            if rng.random() < 0.6:
                value = make()
                named = secret and rng.random() < 0.5
                parts[at] = f'api_key = "{value}"' if named else value
                if secret:
                    truth.add((k, value))
        rows.append((k, " ".join(parts), "src/x.py"))
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("is_secret").collect()
    found = {(r["doc_id"], r["value"]) for r in got}
    right = len(found & truth)
    assert right / len(truth) > 0.95 and right / len(found) > 0.95, (right, len(truth), len(found))


def test_found_spans_are_cut_out(spark, edges, edge_rows):
    """Redaction by places equals redaction by a second scan; rows keep their columns."""
    rng = random.Random(2)
    rows = [(k, f'ü {k} password: {rng.getrandbits(120):030x} x token = "{rng.getrandbits(160):040x}" é', "en", "a", 1) for k in range(30)]
    rows += edge_rows + [rows[0], rows[0], (0, "another text of id 0", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    import corpus_pipeline as cp
    words = secrets.dictionary(df)
    found = secrets.scan(df.withColumn("_name", cp.identity()), words, "_name")
    model = secrets.fit(found)
    for limit in (16 << 20, 0):
        got = secrets.redact_found(df, secrets.judge(found, model), cp.identity(), broadcast_bytes=limit)
        want = secrets.redact(df, words, model)
        assert got.columns == df.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_statistics_of_texts_without_words(spark):
    df = spark.createDataFrame([("",), (None,), (" \n\t",), (" a b a",), ("a b a",)], "text string")
    got = [r[0] for r in df.select(quality._features("text")).collect()]
    assert got[0] == got[1] == [0.0] * len(quality.FEATURES)
    place = quality.FEATURES.index("distinct_words")
    assert got[2][place] == 0.0 and got[3][place] == got[4][place] == pytest.approx(2 / 3)


def plain_statistics(text):
    import math
    import re
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    def share(a, b):
        return a / b if b else 0.0
    def chars(of):
        return sum(c in of for c in text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [math.log1p(len(words)), share(sum(map(len, words)), len(words)), share(chars("#*$%&|<>"), len(words)), share(chars(upper), len(text)),
            share(chars("0123456789"), len(text)), share(chars(".,;:"), len(words)), share(chars("!?"), len(words)), share(chars("|"), len(words)),
            share(len(text.encode()) - len(text), len(text)), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)),
            share(len(words), text.count("\n") + 1)]


def test_statistics_against_plain_python(spark, edges, edge_rows):
    got = edges.select("text", quality._features("text").alias("f")).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert r["f"] == pytest.approx(plain_statistics(r["text"]))


def test_secrets_of_nothing(edges, nothing):
    assert secrets.find_secrets(nothing).count() == 0
    assert secrets.find_secrets(edges).count() >= 1  # one long run of a letter; no labels of either kind needed


def brute_neighbours(rows, queries, k):
    out = {}
    for q, v in queries:
        a = np.array(v, float)
        near = sorted((-float(a @ np.array(w, float) / (np.linalg.norm(a) * np.linalg.norm(w))), i) for i, w in rows if i != q)
        out[q] = near[:k]
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 16)).astype(np.float32).astype(float)
    rows = [(k, base[k].tolist()) for k in range(900)] + [(1000 + k, base[7].tolist()) for k in range(40)]
    bad = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, []),
           (None, base[3].tolist()), (2250, [1.0, 2.0]), (2300, [2.0, 1.0]), (2350, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    index = vamana.build_index(df, k=5, shard_rows=300)
    got = vamana.search_index(index, df.where("vec_id % 50 = 0"), k=5, block_rows=8).collect()
    want = brute_neighbours(rows, [r for r in rows if r[0] % 50 == 0], 5)
    found = {q: sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) for q in {r["query_id"] for r in got}}
    assert found.pop(2250) == [(1, 2300, pytest.approx(0.8))] and found.pop(2300) == [(1, 2250, pytest.approx(0.8))]
    assert set(found) == set(want)
    hits = sum(len({i for _, i, _ in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in found[1000]] == [7, 1001, 1002, 1003, 1004]
    assert all([r for r, *_ in x] == [1, 2, 3, 4, 5] for x in found.values())
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vamana.search_index(vamana.build_index(empty), empty).count() == 0


def test_graph_of_few_points():
    for n in (1, 2, 3, 30):
        x = vamana._units(np.random.default_rng(n).normal(size=(n, 8)))
        graph, start = vamana.build_graph(x)
        ids, _ = vamana.beam_search(x, graph, start, x, 40)
        assert (ids[:, 0] == np.arange(n)).all() and ((ids >= 0).sum(1) == n).all()


def test_bounded_findings_spread_over_values(spark, monkeypatch):
    """Every value has copies; no value's copies may fill the bounded sample of its label."""
    seen = []
    monkeypatch.setattr(secrets, "random_forest", lambda x, y, **p: seen.append(x))
    zeros = [0.0] * (len(secrets.FEATURES) - 1)
    rows = [(f"d{v}_{c}", 0, f"value{v}", label, [float(v), *zeros]) for label in (0, 1) for v in range(20) for c in range(50)]
    df = spark.createDataFrame(rows, "id string, start long, value string, label int, features array<float>")
    secrets.fit(df, max_findings=50)
    assert len(seen[0]) == 200 and len(set(seen[0][:50, 0])) > 10 and len(set(seen[0][50:100, 0])) > 10
