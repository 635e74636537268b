"""Token counts by finite-state transduction.

A byte-level BPE vocabulary is compiled into two deterministic transducers.

*Splitter.* Twelve states over character classes find the pre-token starts of
the splitting pattern; a transition says whether a start lies before the current
or the previous character, which settles the pattern's look-ahead. Texts are cut
into chunks, each chunk yields its map from every entry state to the exit state
(all chunks step in lockstep), the maps of a text compose through a parallel
prefix scan, and with the entry states known a second lockstep pass emits the
starts.

*Merger.* Reads the bytes of a pre-token; a transition carries the change of the
token count. A sequence of tokens is the BPE result exactly when each pair of
neighbours is its own BPE result, so the last token of every prefix is
determined, and a state needs only the suffixes that can still grow into a
token, each with the last token and the relative count before it. States and
transitions are made on first use and kept while a bound on their number holds;
counts of whole pre-tokens are remembered by hash.

Defined results: a null or empty text has 0 tokens; a special token's string
inside a text is that one token, as the library has it by default; repeated rows
give repeated results; null ids pass through; further columns do not matter; an
empty table gives no rows; texts of any length are read whole (only one group of texts is in memory).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byteops import groups_by_size, segment_hashes
from .common import batches_of

CHUNK = 256
GROUP_CHARS = 400_000

# character classes
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE, _QUOTE, _ONE, _R, _V, _L, _E, _PAD = range(12)
# splitter states
_FRESH, _IN_LETTERS, _IN_NUMBERS, _IN_OTHER, _Q, _QR, _QV, _QL, _BLANK1, _BLANKS, _SPACE1, _SPACES = range(12)
_LETTERS = (_LETTER, _ONE, _R, _V, _L, _E)
_HERE, _BACK = 1, 2  # a start before this character; before the previous one


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for (state, class)."""
    goto, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    fresh = {c: _IN_LETTERS for c in _LETTERS} | {_OTHER: _IN_OTHER, _NUMBER: _IN_NUMBERS, _BLANK: _BLANK1,
                                                  _SPACE: _SPACE1, _QUOTE: _Q}
    joined = {c: _IN_LETTERS for c in _LETTERS} | {_OTHER: _IN_OTHER, _NUMBER: _IN_NUMBERS, _QUOTE: _IN_OTHER}
    for c, first in fresh.items():
        def rule(state, to, o, c=c):
            goto[state, c], out[state, c] = to, o
        blank = c in (_BLANK, _SPACE)
        rule(_FRESH, first, _HERE)
        for state, stay in ((_IN_LETTERS, _LETTERS), (_IN_NUMBERS, (_NUMBER,)), (_IN_OTHER, (_OTHER, _QUOTE))):
            rule(state, *((state, 0) if c in stay else (first, _HERE)))
        rule(_Q, *{_ONE: (_FRESH, 0), _R: (_QR, 0), _V: (_QV, 0), _L: (_QL, 0), _OTHER: (_IN_OTHER, 0),
                   _QUOTE: (_IN_OTHER, 0)}.get(c, (first, _HERE)))
        for state, last in ((_QR, _E), (_QV, _E), (_QL, _L)):  # else the letter begins a run of its own
            rule(state, *((_FRESH, 0) if c == last else (_IN_LETTERS, _BACK) if c in _LETTERS else (first, _BACK | _HERE)))
        run = _BLANKS if c == _BLANK else _SPACES
        rule(_BLANK1, *((run, 0) if blank else (joined[c], 0)))
        rule(_SPACE1, *((run, 0) if blank else (first, _HERE)))
        rule(_BLANKS, *((run, 0) if blank else (joined[c], _BACK)))
        rule(_SPACES, *((run, 0) if blank else (first, _BACK | _HERE)))
    goto[:, _PAD] = np.arange(12)
    return goto, out


def class_runs(path: str) -> tuple[list[int], list[int]]:
    """Run lengths and classes of all code points, as the tokenizer file's own splitter sees them.

    Code points that no Unicode version has assigned are in no class but
    "other"; the large blocks of ideographs and syllables are letters in all
    versions; the rest is put to the splitter."""
    import unicodedata
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    classes = np.full(0x110000, _OTHER, np.uint8)
    for a, b in ((0x4E00, 0x9FCC), (0xAC00, 0xD7A3), (0x20000, 0x2A6D6)):
        classes[a:b + 1] = _LETTER
    points = np.array([p for p in range(0x110000) if classes[p] != _LETTER
                       and unicodedata.category(chr(p)) not in ("Cn", "Co", "Cs")])
    def joins(pattern: str) -> np.ndarray:
        """Whether each point stays in one pre-token with the character before it."""
        found = []
        for part in np.array_split(points, 64):
            text = "".join(pattern.replace("?", chr(p)) for p in part)
            starts = np.zeros(len(text) + 1, bool)
            starts[[span[0] for _, span in split(text)]] = True
            found.append(~starts[1:len(text):len(pattern)])
        return np.concatenate(found)
    letter, number, other = joins("a?\n"), joins("0?\n"), joins("!?\n")
    classes[points[letter]], classes[points[number]] = _LETTER, _NUMBER
    classes[points[~(letter | number | other)]] = _SPACE
    for chars, c in ((" ", _BLANK), ("'", _QUOTE), ("stmd", _ONE), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        classes[[ord(x) for x in chars]] = c
    cuts = np.flatnonzero(np.diff(classes)) + 1
    bounds = np.concatenate(([0], cuts, [len(classes)]))
    return np.diff(bounds).tolist(), classes[bounds[:-1]].tolist()


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """Deterministic transducer from the bytes of a pre-token to its token count."""

    def __init__(self, path: str, max_states: int = 200_000):
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte_of, vocab = _byte_symbols(), model["vocab"]
        self.token = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.text = {i: s for s, i in self.token.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.single = [self.token[bytes([b])] for b in range(256)]
        self.grows = {s[:k] for s in self.token for k in range(1, len(s))}
        self.max_states = max_states
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple, bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self._state(((b"", None, 0),))

    def _state(self, key: tuple) -> int:
        found = self.ids.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
            self.moves.append({})
        return found

    def _merged(self, data: bytes) -> list[int]:
        out = [self.single[b] for b in data]
        while len(out) > 1:
            best = min(((*self.merge[p], k) for k, p in enumerate(zip(out, out[1:])) if p in self.merge),
                       key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            out[best[2]:best[2] + 2] = [best[1]]
        return out

    def _neighbours(self, last: int | None, token: int) -> bool:
        if (last, token) not in self.fits:
            both = [token] if last is None else [last, token]
            self.fits[last, token] = self._merged(b"".join(self.text[t] for t in both)) == both
        return self.fits[last, token]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        tail, grown, ended = bytes([byte]), [], None
        for suffix, last, before in self.states[state]:
            suffix += tail
            token = self.token.get(suffix)
            if token is not None and ended is None and self._neighbours(last, token):
                ended = (token, before + 1)
            if suffix in self.grows:
                grown.append((suffix, last, before))
        token, count = ended  # a single byte always is a token
        key = (*((s, last, before - count) for s, last, before in grown), (b"", token, 0))
        self.moves[state][byte] = move = (self._state(key), count)
        return move

    def count(self, data: bytes) -> int:
        if len(self.states) > self.max_states:
            self.reset()
        state, total, moves = self.start, 0, self.moves
        for byte in data:
            state, more = moves[state].get(byte) or self._move(state, byte)
            total += more
            if len(moves) > 4 * self.max_states:  # inside one huge pre-token
                state = self._carry_over(state)
                moves = self.moves
        return total

    def _carry_over(self, state: int) -> int:
        key = self.states[state]
        self.reset()
        return self._state(key)


class Counter:
    """Token counts of texts; one per worker process."""

    def __init__(self, path: str, runs: tuple[list[int], list[int]], special: tuple[str, ...], remembered: int = 1_500_000):
        self.classes = np.repeat(np.array(runs[1], np.uint8), runs[0])
        goto, out = _splitter()
        self.goto, self.out = goto.ravel(), out.ravel()
        self.merger, self.special, self.remembered = Merger(path), special, remembered
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def starts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Flags of the characters that begin a pre-token; ``lengths`` > 0 are those of the texts in ``codes``."""
        chunks = -(-lengths // CHUNK)
        first = np.concatenate(([0], np.cumsum(chunks)[:-1]))
        grid = np.full(int(chunks.sum()) * CHUNK, _PAD, np.uint8)
        text_at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        places = np.repeat(first * CHUNK - text_at, lengths) + np.arange(len(codes))
        grid[places] = self.classes[codes]
        steps = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
        n = steps.shape[1]
        # maps of all entry states, every chunk in lockstep
        maps = np.tile(np.arange(12, dtype=np.uint8), (n, 1))
        for classes in steps:
            maps = self.goto[maps.astype(np.intp) * 12 + classes[:, None]]
        # compose the maps along each text: inclusive scan by doubling
        index, shift = np.arange(n) - np.repeat(first, chunks), 1
        while shift <= int(chunks.max()) - 1:
            later = np.flatnonzero(index >= shift)
            maps[later] = np.take_along_axis(maps[later], maps[later - shift].astype(np.intp), 1)
            shift *= 2
        state = np.full(n, _FRESH, np.uint8)
        inner = np.flatnonzero(index > 0)
        state[inner] = maps[inner - 1, _FRESH]
        emitted = np.zeros_like(steps)
        for k, classes in enumerate(steps):
            at = state.astype(np.intp) * 12 + classes
            emitted[k], state = self.out[at], self.goto[at]
        marks = emitted.T.ravel()[places]
        flags = (marks & _HERE) > 0
        flags[:-1] |= (marks[1:] & _BACK) > 0
        final = state[first + chunks - 1]  # padding keeps the state
        ends = text_at + lengths - 1
        flags[ends[(final >= _QR) & (final <= _QL)]] = True
        return flags

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                pieces = [p for piece in pieces for p in piece.split(s)]
            extra[k] = len(pieces) - 1
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(k)
        for a, b in groups_by_size([len(p) for p in parts], GROUP_CHARS):
            np.add.at(extra, owner[a:b], self._group(parts[a:b]))
        return extra

    def _group(self, parts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in parts])
        begin = np.flatnonzero(self.starts(codes, lengths))
        end = np.append(begin[1:], len(codes))
        hashes, where, back = np.unique(segment_hashes(codes, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        missing = np.flatnonzero(np.append(self.known, np.uint64(0))[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(missing):
            fresh = [self.merger.count(codes[begin[k]:end[k]].tobytes().decode("utf-32-le").encode()) for k in where[missing]]
            if len(self.known) + len(missing) > self.remembered:
                self.known, self.counts = self.known[:0], self.counts[:0]
                return self._group(parts) if len(missing) < len(hashes) else self._sum(np.array(fresh), back, begin, lengths)
            self.known = np.insert(self.known, at[missing], hashes[missing])
            self.counts = np.insert(self.counts, at[missing], fresh)
            at = np.searchsorted(self.known, hashes)
        return self._sum(self.counts[at], back, begin, lengths)

    @staticmethod
    def _sum(counts: np.ndarray, back: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        owner = np.searchsorted(np.cumsum(lengths), begin, side="right")
        return np.bincount(owner, weights=counts[back], minlength=len(lengths)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; ``path`` names a byte-level BPE tokenizer file."""
    import pyarrow as pa

    batches_of(df.sparkSession, 500)
    runs = class_runs(path)
    special = tuple(x["content"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"])
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, runs, special)
        for batch in batches:
            counts = _COUNTERS[path](batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
