"""The Jaccard join and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tenderscope.llm import sigtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """[(id, size, component)]"""
    sets = [shingles(t, n) for _, t, *_ in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, *_), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(rng, n_groups=6):
    rows, k = [], 0
    for _ in range(n_groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 80, 250]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(3000)}"
            rows.append((k, " ".join(copy)))
            k += 1
    shared = " ".join(f"p{j}" for j in range(60))
    rows += [(k + j, shared + " " + " ".join(f"q{j}_{x}" for x in range(rng.choice([2, 5, 8, 40])))) for j in range(12)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, percent", [(1, 3, 90), (2, 5, 80)])
def test_join_finds_exactly_the_components(spark, monkeypatch, seed, n, percent):
    rows = near_copies(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(sigtree, "BLOCK", 4)  # cut cells into blocks
    got = sorted((tuple(r) for r in sigtree.near_duplicates(df, n=n, percent=percent).collect()), key=repr)
    assert got == brute(rows, n, percent)
    assert any(r[0] != r[2] for r in got)


def test_join_edges(spark, edges, edge_rows, nothing):
    got = sorted((tuple(r) for r in sigtree.near_duplicates(edges).collect()), key=repr)
    assert got == brute(edge_rows, 3, 90)
    assert sigtree.near_duplicates(nothing).count() == 0


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(3)
    universe = rng.integers(0, 2 ** 63, 5000).astype(np.uint64)
    sets = []
    for _ in range(12):
        base = rng.choice(universe, rng.choice([1, 5, 40, 400, 1180, 1230, 4000]), replace=False)
        for _ in range(rng.integers(1, 9)):
            keep = rng.random(len(base)) > 0.04
            sets.append(np.unique(np.concatenate((base[keep], rng.choice(universe, rng.integers(0, 3))))))
    sets = [s for s in sets if len(s)]
    sets.sort(key=len)
    sizes, (maps, counts) = np.array([len(s) for s in sets]), sigtree.unpacked([sigtree.signature(s) for s in sets])
    comps = np.arange(len(sets))
    tree = sigtree.Tree(sizes, maps, counts, comps)
    for percent in (80, 90):
        found = {(a, b) for i, j in sigtree.traverse(tree, tree, percent) for a, b in zip(i, j)}
        true = set()
        for b in range(len(sets)):
            for a in range(b):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    true.add((a, b))
        assert true <= found and true
        half = len(sets) // 3
        other = {(a, b + half) for i, j in sigtree.traverse(sigtree.Tree(sizes[:half], maps[:half], counts[:half], comps[:half]),
                 sigtree.Tree(sizes[half:], maps[half:], counts[half:], comps[half:]), percent) for a, b in zip(i, j)}
        assert {(a, b) for a, b in true if a < half <= b} <= other
    same = sigtree.Tree(sizes, maps, counts, np.zeros(len(sets), np.int64))
    assert not list(sigtree.traverse(same, same, 80))


def test_pipeline_stages(spark, edge_rows, tmp_path):
    import corpus_pipeline as cp
    rng = random.Random(9)
    from pyspark.sql import functions as F
    from .conftest import CLASH, words
    good = [(100 + k, words(rng, 120, 3000), "en", rng.choice("abc"), 1) for k in range(60)]
    copies = [(300 + k, good[0][1] + f" tail{k}", "en", "a", 1) for k in range(5)] + [good[1], good[1]]
    keyed = [(400, words(rng, 80, 3000) + f' token = "{rng.getrandbits(160):040x}" end', "en", "b", 1)]
    junk = [(500 + k, "### $$$ " * 60 + words(rng, 10), "en", "c", 1) for k in range(40)]
    rows = good + copies + keyed + junk + edge_rows  # a very long text among them
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
         .withColumns({c: F.lit("other") for c in CLASH}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1) for r in good] + [(r[0], 0) for r in junk]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
    kept = {r["doc_id"] for r in seen["quality"]}
    assert {r[0] for r in good} <= kept and not kept & {r[0] for r in junk}
    # one row of each component, and all rows without words
    before = [tuple(r) for r in seen["quality"]]
    part = brute(before, 5, 80)
    groups = {c for _, n, c in part if n}
    blank = sum(1 for _, n, _ in part if not n)
    assert len(seen["dedupe"]) == len(groups) + blank
    assert sorted((r["doc_id"] for r in seen["dedupe"] if shingles(r["text"], 5)), key=repr) == sorted(groups, key=repr)
    assert len(seen["secrets"]) == len(seen["dedupe"])
    hidden = [r for r in seen["secrets"] if r["doc_id"] == 400][0]
    assert hidden["text"].endswith('token = "[SECRET]" end') and hidden["n_chars"] == len(hidden["text"])
    texts = Counter((r["doc_id"], r["text"]) for r in seen["secrets"])
    mixed = Counter((r["doc_id"], r["text"]) for r in seen["mix"])
    assert mixed and all(n <= 2 * texts[x] for x, n in mixed.items())
    whole = {}
    for p in seen["pack"]:
        whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
    assert sum(whole.values()) == sum(p["length"] for p in seen["pack"])
    assert set(whole) == {r["doc_id"] for r in seen["mix"]}


def test_pipeline_of_an_empty_table(spark, nothing, tmp_path):
    import corpus_pipeline as cp
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("component", [-7, -1, 7])
def test_traversal_drops_pairs_of_one_component(component):
    """Component ids are signed: a negative one is a component like any other."""
    sets = [np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)] * 100
    bitmaps, counts = sigtree.unpacked([sigtree.signature(s) for s in sets])
    components = np.full(100, component, np.int64)
    components[50] = 3
    tree = sigtree.Tree(np.full(100, 40), bitmaps, counts, components)
    pairs = {(int(a), int(b)) for i, j in sigtree.traverse(tree, tree, 80) for a, b in zip(i, j)}
    assert pairs == {(min(k, 50), max(k, 50)) for k in range(100) if k != 50}


def family(rng, copies, words, changed):
    """Copies of one text in which each has some words of its own."""
    base = [f"v{rng.randrange(10 ** 6)}" for _ in range(words)]
    rows = []
    for k in range(copies):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("changed, most, groups", [(6, 1000, 1), (22, 20 * 300, 300)])
def test_large_families_are_not_paired_out(spark, monkeypatch, changed, most, groups):
    """300 linked copies meet through leaders; 300 copies just below the threshold fall to the counted signatures."""
    df = spark.createDataFrame(family(random.Random(7), 300, 1000, changed), "doc_id long, text string").repartition(3)
    pairs, verify = [], sigtree._verified
    monkeypatch.setattr(sigtree, "_verified", lambda found, *a, **k: pairs.append(found.count()) or verify(found, *a, **k))
    got = sigtree.near_duplicates(df, n=3, percent=90).collect()
    assert len({r["component_id"] for r in got}) == groups
    assert sum(pairs) < most, pairs


def test_signatures_are_held_once_and_meet_the_last_cells_in_parts(spark, monkeypatch):
    """While cells are searched one table holds signatures and none holds routes; the last round's cells come in parts."""
    import os
    df = spark.createDataFrame(family(random.Random(8), 60, 200, 3), "doc_id long, text string").repartition(3)
    held, last, folders, survivors, scratch = [], [], [], sigtree._survivors, sigtree.scratch
    monkeypatch.setattr(sigtree, "scratch", lambda *a: folders.append(scratch(*a)) or folders[-1])

    def seen(some, signatures, percent, leaders):
        tables = os.listdir(folders[0].removeprefix("file:"))
        columns = {t: spark.read.parquet(f"{folders[0]}/{t}").columns for t in tables}
        held.append([t for t, c in columns.items() if {"signature", "route"} & set(c)])
        if not leaders:
            last.append({r["cell"] for r in some.select("cell").distinct().collect()})
        return survivors(some, signatures, percent, leaders)

    monkeypatch.setattr(sigtree, "_survivors", seen)
    sigtree.near_duplicates(df, n=3, percent=90).collect()
    assert held and all(t == ["signatures"] for t in held)
    assert len(last) > 1 and sum(map(len, last)) == len(set().union(*last)) > 1
    assert max(map(len, last)) < sum(map(len, last))
