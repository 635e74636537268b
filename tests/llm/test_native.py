"""Shards, rule cascade and mixture against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tenderscope.llm import cascade
from tenderscope.llm.mixing import curriculum, mixture_plan
from tenderscope.llm.sharding import shard_bounds, shard_by_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(rows):
    return sorted(rows, key=repr)


def test_shards_cover_all_rows_in_order(spark, edges, edge_rows):
    got = [tuple(r) for r in shard_by_bytes(edges, shards=4).collect()]
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows]
    assert key(r[:3] for r in got) == key(want)
    total, at = sum(r[1] for r in want), 0
    slots = Counter()
    for r in sorted(got, key=lambda r: (r[3], r[4])):  # shard, slot: the global order
        assert r[3] == min(3, at * 4 // total) and r[4] == slots[r[3]]
        slots[r[3]] += 1
        at += r[1]
    ids = [(r[0] is not None, r[0] or 0) for r in sorted(got, key=lambda r: (r[3], r[4]))]
    assert ids == sorted(ids)


def test_shards_are_balanced(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, "x" * rng.randrange(200)) for k in range(5000)], "doc_id long, text string")
    sizes = [r["bytes"] for r in shard_bounds(shard_by_bytes(df)).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 400


def test_empty_tables(nothing):
    assert shard_by_bytes(nothing).count() == 0
    assert mixture_plan(nothing).count() == 0
    assert cascade.quality_cascade(nothing).count() == 0


def brute_statistics(text):
    ws = WORD.findall(text or "")
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {k + d for k, x in enumerate(zip(ws, ws[1:], ws[2:])) if seen[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(ws)
    return (n, sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_cascade_statistics(spark, edges, edge_rows):
    got = cascade.quality_cascade(edges).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                "base_failed").collect()
    assert key(tuple(r) for r in got) == key((i, *brute_statistics(t)) for i, t, *_ in edge_rows)


def test_cascade_verdict_does_not_depend_on_the_order(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["word", "another", "Thing", "##", "LOUD!!", "ok.", "a|b"]) + str(rng.randrange(50)) * rng.randrange(2)
                      for _ in range(120)) for _ in range(40)] + [" ".join(f"plain{k}" for k in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = cascade.default_rules()
    one = cascade.quality_cascade(df, rules=rules).select("doc_id", "kept").collect()
    two = cascade.quality_cascade(df, rules=rules[::-1], sample_rows=5).select("doc_id", "kept").collect()
    assert key(map(tuple, one)) == key(map(tuple, two))
    assert {r["doc_id"]: r["kept"] for r in one}[len(texts) - 1]
    assert any(not r["kept"] for r in one)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Repeated resharing of what is over, as the definition says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def brute_taken(rows):
    sizes = Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, out = brute_targets(sizes), []
    for s in sizes:
        at = 0
        mine = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), i is not None, i or 0,
                 len(WORD.findall(t or "")), i) for i, t, _, z, _ in rows if z == s]
        for _, _, _, n, i in sorted(mine):
            limit = int(target[s] + 1e-9)
            out.append((i, n, sizes[s], sum(max(0, min(n, limit - at - e * sizes[s])) for e in (0, 1))))
            at += n
    return target, out


def test_mixture_against_the_definition(spark, edges, edge_rows):
    plan = mixture_plan(edges)
    target, want = brute_taken(edge_rows)
    got = plan.select("doc_id", "size", "source_size", "taken", "source", "target", "lang").collect()
    assert key((r[0], r[1], r[2], r[3]) for r in got) == key(want)
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got)
    again = mixture_plan(edges.repartition(7)).select("doc_id", "size", "source_size", "taken", "source", "target", "lang").collect()
    assert key(map(tuple, got)) == key(map(tuple, again))


def test_mixture_order_and_whole_documents(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 40))), "en", rng.choice("abcabbb"), 0) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixture_plan(df, whole_documents=True)
    by = plan.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 40 for r in by)
    copies = curriculum(plan).select("position", "source", "size", "taken").collect()
    assert all(r["taken"] == r["size"] for r in copies)
    places = [r["position"] for r in copies]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    # the first source falls from 1.5 to 0.5 times its mean rate, the last one rises
    def early(s):
        mine = [r for r in copies if r["source"] == s]
        return sum(r["size"] for r in mine if r["position"] < 0.5) / sum(r["size"] for r in mine)
    assert early("a") == pytest.approx(0.625, abs=0.05) and early("c") == pytest.approx(0.375, abs=0.05)
