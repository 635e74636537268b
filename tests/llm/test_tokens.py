"""Token counts, ids, packing and Simple-8b against the tokenizer library."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderscope.llm import simple8b, tokens, transducer
from tenderscope.llm.common import scratch
from tenderscope.llm.packing import OpenWindows, decode, pack

ODD = ["a", "s", "'", "'s", "'re", "'ve", "'LL", "r", "e", "v", "l", "T", " ", "  ", "\n", "\t", "1", "0", "٣", "é", "É", "×", "÷",
       "ß", "ÿ", "你", "!", "?", " ", "　", "<|endoftext|>", "<|", "d", "m", "ſ", "́", "🙂", "X", "\x00", "\x0b",
       "\x85", "İ", "ǆ", "‘", "word", " the", "ing"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 300, 900]))) for _ in range(n)]


def exact(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_transducer_counts_odd_texts(vocabulary):
    path, texts = vocabulary("byte_bpe_50k.json"), odd_texts(1500, 1)
    counter = transducer.Counter(path, transducer.class_runs(path), ("<|endoftext|>",), remembered=300)
    counter.merger.max_states = 500  # forget often
    assert counter(texts).tolist() == [len(x) for x in exact(path, texts)]


def test_splitter_maps_do_not_depend_on_the_chunk(vocabulary, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    texts, runs = odd_texts(300, 2), transducer.class_runs(path)
    monkeypatch.setattr(transducer, "CHUNK", 2)
    monkeypatch.setattr(transducer, "GROUP_CHARS", 50)
    small = transducer.Counter(path, runs, ("<|endoftext|>",))(texts)
    assert small.tolist() == [len(x) for x in exact(path, texts)]


def test_count_tokens_edges(edges, edge_rows, nothing, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    got = sorted((tuple(r) for r in transducer.count_tokens(edges, path).collect()), key=repr)
    texts = [t or "" for _, t, *_ in edge_rows]
    want = [(i, len(t.encode()), len(x), len(x) > 512) for (i, *_), t, x in zip(edge_rows, texts, exact(path, texts))]
    assert got == sorted(want, key=repr)
    assert transducer.count_tokens(nothing, path).count() == 0


def test_word_tokenizer_is_exact(vocabulary, monkeypatch):
    path, texts = vocabulary("word_bpe_49k.json"), odd_texts(1500, 3)
    monkeypatch.setattr(tokens, "BUFFER", 3000)
    made = tokens.WordTokenizer(path, remembered=500)
    assert [x.tolist() for x in made(texts)] == exact(path, texts)
    assert [x.tolist() for x in made([None, "", "hi"], 2)] == [[2], [2], exact(path, ["hi"])[0] + [2]]


@given(st.lists(st.integers(1, 300), max_size=80), st.integers(1, 6), st.integers(0, 20))
@settings(max_examples=60, deadline=None)
def test_open_windows(lengths, limit, slack):
    packer, made = OpenWindows(64, limit, slack), []
    for k, n in enumerate(lengths):
        for window in packer.add(k, n):
            assert sum(x[2] for x in window) >= 64 - slack
            made.append(window)
        assert len(packer.windows) <= limit
    made += [w for _, w in packer.rest()]
    parts = defaultdict(list)
    for window in made:
        assert 0 < sum(x[2] for x in window) <= 64
        for k, start, n in window:
            parts[k].append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, m in sorted(parts[k]):
            assert start == at
            at += m
        assert at == n


def check_pieces(pieces, rows, path, length):
    texts = [t or "" for _, t, *_ in rows]
    want = sorted((i is not None, i or 0, tuple(x) + (2,)) for (i, *_), x in zip(rows, exact(path, texts)))
    windows, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        parts[p["doc_id"]].append((p["start"], p["length"], tuple(decode(bytes(p["ids"])).tolist()), p["doc_tokens"]))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= length
    total = sum(len(x[2]) for x in want)
    assert sum(p["length"] for p in pieces) == total
    for known, i, ids in want:
        mine = parts[i if known else None]
        spans = [(s, n, x) for s, n, x, whole in mine if whole == len(ids) and x == ids[s:s + n] and n == len(x)]
        assert {k for s, n, _ in spans for k in range(s, s + n)} == set(range(len(ids)))
    return len(windows), total


def test_pack_edges(edges, edge_rows, nothing, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    pieces = pack(edges, path, length=128, open_windows=3, slack=8).collect()
    made, total = check_pieces(pieces, edge_rows, path, 128)
    assert made * 128 - total <= made * 8 + 128
    assert pack(nothing, path).count() == 0


@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2 ** 32 - 1)), max_size=200), max_size=6))
@settings(max_examples=100, deadline=None)
def test_simple8b_block_round_trip(documents):
    arrays = [np.array(d, np.uint32) for d in documents]
    ids, lengths = simple8b.decode_block(simple8b.encode_block(arrays))
    assert ids.tolist() == [x for d in documents for x in d] and lengths.tolist() == [len(d) for d in documents]


def test_simple8b_words_are_full():
    assert len(simple8b.pack_words(np.zeros(600, np.uint32) + 1)) == 10
    assert len(simple8b.pack_words(np.full(300, (1 << 20) - 1, np.uint32))) == 100
    with pytest.raises(ValueError):
        simple8b.decode_block(b"x" * 40)


def test_simple8b_file(spark, edges, edge_rows, nothing, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    for df, rows in ((edges, edge_rows), (nothing, [])):
        out = scratch(spark, "test-s8b")
        simple8b.write_tokens(df, out, path, block_ids=500)
        got = simple8b.read_tokens(spark, out).collect()
        texts = [t or "" for _, t, *_ in rows]
        want = sorted((i is not None, i or 0, tuple(x) + (2,)) for (i, *_), x in zip(rows, exact(path, texts)))
        got = sorted(got, key=lambda r: r["start"])
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
            at += r["n_tokens"]
        assert [(r[0] is not None, r[0] or 0) for r in got] == [w[:2] for w in want]
        assert sorted((r[0] is not None, r[0] or 0, tuple(decode(bytes(r["ids"])).tolist())) for r in got) == want


def test_special_strings_inside_texts(spark, vocabulary):
    df = spark.createDataFrame([(1, "x<|endoftext|>y <|endoftext|>")], "doc_id long, text string")
    assert transducer.count_tokens(df, vocabulary("byte_bpe_50k.json")).where(F.col("n_tokens") == 5).count() == 1
