"""Merkle manifest, main text and ns-bounds clusters against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderscope.llm import maintext, merkle, nsbounds


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(hashes, fanout):
    """(root, path of every leaf)"""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, a in enumerate(at):
            run = hashes[a - a % fanout:a - a % fanout + fanout]
            paths[k].append(("".join(run[:a % fanout]), "".join(run[a % fanout + 1:])))
        at = [a // fanout for a in at]
        hashes = [sha("".join(hashes[a:a + fanout])) for a in range(0, len(hashes), fanout)]
    return hashes[0], paths


def brute_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[g] = (members, *brute_tree([brute_leaf(r) for r in members], fanout))
    root, above = brute_tree([trees[g][1] for g in langs], fanout)
    out = []
    for g, up in zip(langs, above):
        members, subroot, paths = trees[g]
        for r, path in zip(members, paths):
            path = path + up
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = brute_leaf((*r[:4], r[4] + 1)) if bad else brute_leaf(r)
            for before, after in path:
                acc = sha(before + acc + after)
            out.append((r[0], brute_leaf(r), subroot, root, sha("".join(b + a for b, a in path)), acc, acc == root))
    return sorted(out, key=repr)


def manifest(df, fanout):
    def leaf(n):
        return merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(F.col("n_chars") + 1))
    m = merkle.merkle_manifest(df, F.col("lang"), F.col("doc_id"), leaf(F.col("n_chars")), {"doc_id": F.col("doc_id"), "bad": bad}, fanout)
    m = m.select("doc_id", "leaf", "subroot", "root", merkle.path_hash(F.col("path")).alias("p"),
                 merkle.fold(F.coalesce("bad", "leaf"), F.col("path")).alias("f"))
    return sorted((tuple(r) for r in m.withColumn("ok", F.col("f") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_brute_force(spark, edges, edge_rows, fanout):
    got = manifest(edges, fanout)
    assert got == brute_manifest(edge_rows, fanout)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_many_rows_and_one_hot_group(spark):
    rng = random.Random(4)
    rows = [(k, f"t{rng.random()}", rng.choice(["hot"] * 20 + ["a", None, "é", "z"]), "s", k) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert manifest(df, 2) == brute_manifest(rows, 2)


def test_manifest_of_one_row_and_of_none(spark, nothing):
    one = [(5, "x", None, None, 1)]
    df = spark.createDataFrame(one, nothing.schema)
    assert manifest(df, 2) == brute_manifest(one, 2)
    assert manifest(nothing, 2) == []


# ---------------------------------------------------------------- main text

P = "<p>A long enough paragraph of the article, number {}, with <a href='x'>a link</a> &amp; more&nbsp;text in it.</p>"
ARTICLE = "".join(P.format(k) for k in range(5))
WANT = "\n".join(f"A long enough paragraph of the article, number {k}, with a link & more text in it." for k in range(5))
AROUND = ("<html><head><title>T</title><script>if (a<b) '</p>'</script><style>p{}</style></head><body class='has-sidebar'>"
          "<header><h1>Site</h1></header><nav><ul><li><a href=1>one</a><li><a href=2>two</a></ul></nav><!-- x -->"
          "<div class='cookie-notice'>We use cookies, as all do, and say so in many words here.</div>%s"
          "<div id='sidebar'><p>Popular things that nobody reads, with many words to it.</p></div>"
          "<div class=x><a href=1>link one</a> <a href=2>link two</a> <a href=3>link three</a></div>"
          "<section id=comments><h2>Comments</h2>" + "<article class=comment><p>A reader says a long thing about it all here.</p></article>" * 9 +
          "</section><form><p>Name <input name=a></p></form><footer>&copy; all</footer></body></html>")


@pytest.mark.parametrize("middle, want", [
    (f"<article><h1>Head &lt;line&gt;</h1>{ARTICLE}</article>", "Head <line>\n" + WANT),
    (f"<div class=post><div>{ARTICLE}</div></div>", WANT),
    (f"<main>{ARTICLE}</main>", WANT),
    (f"<div><div>{ARTICLE}</div><div>{ARTICLE}</div></div>", WANT + "\n" + WANT),
    ("<article><p>one<br>two  \n three<p><b>fo</b>ur<ul><li>a<li>b</ul><aside>x</aside><script>y</script>five</article>", "one two three\nfour\na\nb\nfive"),
    ("<article><p>Short.</p></article>", "Short."),
    ("<article><header><h1>Own title</h1></header><p>Body of it.</p><footer>tags</footer></article>", "Own title\nBody of it."),
    (f"<table><tr><td><p>x</p><td>{ARTICLE}</table>", WANT)])
def test_article_is_found(middle, want):
    assert maintext.main_text(AROUND % middle) == want


def test_text_odd_pages():
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<html><body></body></html>") == ""
    assert maintext.main_text("plain  text\nonly") == "plain text only"
    assert maintext.main_text("<div class=comments><p>only this</p></div>") == "only this"
    assert maintext.main_text("</p></div><p>a<p>b</i></p>&#233;&bogus;") == "a\nb\né&bogus;"
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert maintext.main_text(deep) == "deep"
    long = " ".join(f"w{k}" for k in range(200_000))
    assert maintext.main_text(f"<article><p>{long}</p></article>") == long


def brute_density(page):
    """Densities from the definition, each subtree walked anew."""
    import math
    n = len(page.parent)
    def below(k):
        return [k] + [x for c in range(n) if page.parent[c] == k for x in below(c)]
    def counts(k):
        ks = below(k)
        return (sum(page.chars[x] for x in ks), len(ks), sum(page.link_chars[x] for x in ks), sum(page.link[x] for x in ks))
    body = counts(0)
    out = []
    for k in range(n):
        c, t, lc, lt = counts(k)
        b = math.log(c / (c - lc or 1) * lc + body[2] / (body[0] or 1) * c + math.e)
        out.append(c / t * max(math.log(c / (lc or 1) * t / (lt or 1)), 0) / math.log(1 + b) if c else 0.0)
    return out, [sum(out[c] for c in range(n) if page.parent[c] == k) for k in range(n)]


def test_densities_follow_the_definition():
    page = maintext._read(AROUND % f"<article>{ARTICLE}</article>", labels=False)
    for got, want in zip(maintext.densities(page), brute_density(page)):
        assert got == pytest.approx(want)


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit("n"), "_html": F.lit(1)})
    got = sorted((tuple(r) for r in maintext.extract_main_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert maintext.extract_main_text(df.where("false")).count() == 0


# ---------------------------------------------------------------- clusters

def brute_clusters(rows, dims, clusters, rounds, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))
    centroids = [v for _, v in kept[:clusters]]
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, found) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centroids


def vectors(rng, n, dims, spots):
    at = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(spots)]
    return [(k, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(at)]) for k in range(n)]


@pytest.mark.parametrize("seed, n, spots", [(1, 400, 8), (2, 60, 20), (3, 5, 2)])
def test_clusters_equal_plain_rounds(spark, seed, n, spots):
    rng = random.Random(seed)
    rows = vectors(rng, n, 6, spots)
    rows += [(n, None), (n + 1, [0.1] * 5), (n + 2, [0.1] * 5 + [None]), (n + 3, [0.1] * 5 + [float("nan")]),
             (n + 4, [float("inf")] * 6), (None, [0.5] * 6), (0, rows[0][1]), (0, rows[0][1]), (n + 5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3) \
        .withColumns({c: F.lit("x") for c in ("id", "v", "cluster", "bounds", "since", "distance", "evaluated")})
    got, history = nsbounds.cluster_vectors(df, dims=6, clusters=8, rounds=10)
    want, centroids = brute_clusters(rows, 6, 8, 10, 1024)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got.collect()), key=repr) == want
    assert history[-1].tolist() == centroids
    full = nsbounds.with_inertia(got, history[-1]).collect()
    assert len(full) == len(want) and {r["inertia"] for r in full} == {sum(r[2] for r in want)}
    for r in full:
        assert r["cluster_inertia"] == sum(x[2] for x in want if x[1] == r["cluster"])
        assert r["centroid_sha256"] == sha(",".join(map(str, centroids[r["cluster"]])))


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    spots = rng.integers(-2000, 2000, (8, 16))
    v = spots[rng.integers(0, 8, 3000)] + rng.integers(-150, 150, (3000, 16))
    history = v[:8][None].astype(np.int64)
    cluster, bounds, since = np.full(len(v), -1), np.zeros((len(v), 8)), np.zeros((len(v), 8), np.int64)
    counts = []
    for _ in range(25):
        cluster, bounds, since, count = nsbounds.assign(v, cluster, bounds, since, history)
        d = ((v[:, None] - history[-1]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        # ns-bounds never exceed the true distances
        now = len(history) - 1
        loose = np.sqrt(((history - history[now]) ** 2).sum(2))[since, np.arange(8)]
        assert (bounds - loose <= np.sqrt(d) + 1e-6).all()
        counts.append(count)
        means = [v[cluster == k].sum(0) // max((cluster == k).sum(), 1) if (cluster == k).any() else history[-1][k] for k in range(8)]
        history = np.concatenate((history, np.array(means)[None]))
    assert counts[0] == 8 * len(v) and sum(counts[5:]) < 0.2 * 20 * 8 * len(v)


def test_no_vectors_and_too_large_ones(spark):
    df = spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="2\\*\\*27"):
        nsbounds.cluster_vectors(df, dims=4)[0].collect()
    got, history = nsbounds.cluster_vectors(df.where("false"), dims=4)
    assert nsbounds.with_inertia(got, history[-1]).count() == 0
