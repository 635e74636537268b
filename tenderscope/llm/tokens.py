"""Token ids of whole texts with a lower-casing word-level BPE tokenizer file.

The tokenizer normalises (NFC, lower case), splits at white space and between
letters, digits and symbols, and merges inside those pieces only. So a text may
be cut wherever both neighbours are certain to lie in different pieces: at
ASCII white space, and between ASCII or Latin-1 letters, digits and ASCII
symbols. Each distinct key between such cuts goes through the library once; its
ids are remembered by the key's hash, and a text's ids are gathered from there.
Texts with a special token's string go through the library whole.
"""

from __future__ import annotations

import json

import numpy as np

from .byteops import cut_at_blanks, groups_by_size, ragged, segment_hashes

BUFFER = 1 << 20
_SPLIT, _LETTER, _DIGIT, _SYMBOL, _UNSURE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kind = np.arange(256, dtype=np.uint8), np.full(256, _UNSURE, np.uint8)
    lower[65:91] += 32
    kind[33:127] = _SYMBOL
    kind[ord("'")] = _UNSURE
    kind[48:58] = _DIGIT
    kind[97:123] = kind[65:91] = _LETTER
    kind[[9, 10, 13, 32]] = _SPLIT
    return lower, kind


_LOWER, _KIND = _tables()


class WordTokenizer:
    """ids of many texts at once; one per worker process."""

    def __init__(self, path: str, remembered: int = 1_000_000):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        self.zero = spec["model"]["vocab"]["0" + (spec["model"].get("end_of_word_suffix") or "")]
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def __call__(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """One uint32 array per text (null: empty text), with ``end`` appended."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        pieces, owner = [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                out[k].append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            for piece in cut_at_blanks(text.encode(), BUFFER):
                pieces.append(piece)
                owner.append(k)
        for a, b in groups_by_size([len(p) + 1 for p in pieces], BUFFER):
            for k, ids in zip(owner[a:b], self._ids(pieces[a:b])):
                out[k].append(ids)
        tail = [] if end is None else [np.array([end], np.uint32)]
        return [np.concatenate(parts + tail) if parts or tail else np.zeros(0, np.uint32) for parts in out]

    def _ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join(pieces), np.uint8)
        low, kind = _LOWER[data], _KIND[data]
        # two-byte letters of Latin-1 (all of U+00C0..U+00FF but the signs at 97 and B7)
        lead = np.flatnonzero(low[:-1] == 0xC3)
        after = low[lead + 1]
        lead, after = lead[(after != 0x97) & (after != 0xB7)], after[(after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead[after <= 0x9E] + 1] += 0x20
        filled = kind != _SPLIT
        before = np.concatenate(([_SPLIT], kind[:-1]))
        sure = (kind != _UNSURE) & (before != _UNSURE)
        begins = filled & ((before == _SPLIT) | (sure & ((kind != before) | (kind == _DIGIT))))
        ends = filled & np.append(begins[1:] | ~filled[1:], True)
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashes, where, back = np.unique(segment_hashes(low, begin, end), return_index=True, return_inverse=True)
        at = self._learn(low, begin, end, hashes, where)
        first, count = self.first[at][back], self.count[at][back].astype(np.int64)
        ids = self.pool[ragged(first, count)]
        lengths = np.array([len(p) + 1 for p in pieces])
        stops = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begin, np.cumsum(lengths) - 1)]
        return np.split(ids, stops[:-1])

    def _learn(self, low, begin, end, hashes, where) -> np.ndarray:
        """Places of the keys in the memory, after the missing ones have been encoded."""
        at = np.searchsorted(self.keys, hashes)
        missing = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if not len(missing):
            return at
        if len(self.keys) + len(missing) > self.remembered and len(self.keys):
            self._forget()
            return self._learn(low, begin, end, hashes, where)
        raw = low.tobytes()
        found = self._encode([raw[begin[k]:end[k]].decode() for k in where[missing]])
        count = np.array([len(x) for x in found], np.int32)
        first = len(self.pool) + np.concatenate(([0], np.cumsum(count)[:-1]))
        self.pool = np.concatenate([self.pool, *found])
        self.keys = np.insert(self.keys, at[missing], hashes[missing])
        self.first = np.insert(self.first, at[missing], first)
        self.count = np.insert(self.count, at[missing], count)
        return np.searchsorted(self.keys, hashes)

    def _encode(self, keys: list[str]) -> list[np.ndarray]:
        """ids of each key: joined by a digit, which always is a piece of its own."""
        plain = [k for k, x in enumerate(keys) if "0" not in x]
        out: list = [None] * len(keys)
        for a in range(0, len(plain), 10_000):
            part = plain[a:a + 10_000]
            ids = np.array(self.library.encode(" 0 ".join(keys[k] for k in part), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(ids == self.zero)
            assert len(stops) == len(part) - 1
            for k, x in zip(part, np.split(ids, stops)):
                out[k] = x[1:] if k != part[0] else x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.library.encode_batch([keys[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, np.uint32)
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer for the file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]
