"""Jaccard join of word n-gram sets with signature trees.

*Sets.* A document's set holds 64-bit hashes of its distinct word n-grams. Equal
sets are one node of the link graph from the start; a node's key is a 64-bit
hash of its set.

*Routing.* Two sets with Jaccard t or more share one of the first
n - ceil(t * n) + 1 elements of both in any common order. The order puts
elements of frequent hash buckets last (one count per bucket, over all
documents), so that elements which many documents share seldom route. Documents
of about one size that share a routing element form a cell; cells with the same
members are one.

*Signature tree.* Inside a cell every document has a bitmap of its hashed
elements and its size. Sorted by size, documents become leaves; a node holds the
OR of the bitmaps below, their size range and their largest excess (elements
beyond one per set bit). Two documents below a pair of nodes have at most
min(sizes, common bits + excess) common elements. Large sets, whose bitmaps are
full, also have element counts per bucket; nodes hold their maximum, and the sum
of the smaller counts bounds the overlap too. A dual traversal from the pair of
roots drops every pair of nodes for which that is too little. Large cells are
cut into blocks, and each pair of blocks is traversed by itself.

*Exactness.* Surviving pairs are verified on the full sets. A group of near
copies would survive with all its pairs, so a few rounds pair documents only
with leaders of their cell, other ones each time, over a few routing elements
of each document: those that other documents share, in the common order (an
element of one document alone leads to nobody). What they verify gives
provisional components. The last round, over all routing
elements, drops pairs that already are in one component and verifies all others.
So each linked pair is in one component or verified itself. A pair that meets in
many cells comes out of the first one in the common order, which the documents'
first shared elements tell; pairs without a common one among these may come out
several times, and are told apart after.

Defined results: null or empty texts have an empty set, no links and their own
id as component; texts with fewer words than n have one element, the whole
sequence; null ids are nodes like others (the smallest non-null id names a
component); repeated rows are all returned; an empty table gives no rows;
further columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph.iterative import connected_components
from .byteops import cut_at_blanks, groups_by_size, mix, segment_hashes
from .common import batches_of, discard, scratch, settle, shuffle_width, written

BUCKET_BITS = 18
BITS = 2048
#: sets from this size on also have counts of their elements in so many buckets; ANY stands for any count
COUNTED, COUNTS, ANY = 400, 512, 255
BUFFER = 1 << 20
#: documents of a cell that one task compares with one another or with another block
BLOCK = 2048
FANOUT = 8
#: parts of the last round's cells that meet the signatures one after the other, so that one part's copies are on disk at a time
PARTS = 3
#: shared routing elements by which a cell sees that two documents have met in an earlier one
FIRSTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- sets

def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in texts]
    pieces, owner = [], []
    for k, text in enumerate(texts):
        for piece in cut_at_blanks(text.encode(), BUFFER) if text else ():
            pieces.append(piece)
            owner.append(k)
    for a, b in groups_by_size([len(p) + 1 for p in pieces], BUFFER):
        codes = _LOWER[np.frombuffer(b"\n".join(pieces[a:b]), np.uint8)]
        filled = np.concatenate(([False], ~_BLANK[codes], [False]))
        edges = np.flatnonzero(filled[1:] != filled[:-1])
        begin, end = edges[::2], edges[1::2]
        hashes = segment_hashes(codes, begin, end)
        stops = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in pieces[a:b]]))
        for k, x in zip(owner[a:b], np.split(hashes, stops[:-1])):
            out[k].append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def shingle_sets(texts: list[str], n: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    out = []
    for words in _word_hashes(texts):
        if len(words) < n:
            h = np.zeros(min(len(words), 1), np.uint64)
            for w in words:
                h = mix(h * _M1 + w + _M2)
        else:
            h = np.full(len(words) - n + 1, n, np.uint64)
            for k in range(n):
                h = mix(h * _M1 + words[k:len(words) - n + 1 + k])
        out.append(np.unique(h))
    return out


def needed(size: int | np.ndarray, percent: int):
    """ceil(t * size): what a set of this size must share with any partner."""
    return -(-size * percent // 100)


def signature(elements: np.ndarray) -> bytes:
    """The bitmap, and for large sets the counts of elements per bucket."""
    bits = np.zeros(BITS, np.uint8)
    bits[(elements >> np.uint64(20)) % np.uint64(BITS)] = 1
    out = np.packbits(bits).tobytes()
    if len(elements) >= COUNTED:
        counts = np.bincount(((elements >> np.uint64(32)) % np.uint64(COUNTS)).astype(np.intp), minlength=COUNTS)
        out += np.minimum(counts, ANY).astype(np.uint8).tobytes()
    return out


def unpacked(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps, counts); a set without counts may have any number in a bucket."""
    bitmaps = np.frombuffer(b"".join(s[:BITS // 8] for s in signatures), np.uint64).reshape(-1, BITS // 64)
    blank = bytes([ANY]) * COUNTS
    return bitmaps, np.frombuffer(b"".join(s[BITS // 8:] or blank for s in signatures), np.uint8).reshape(-1, COUNTS)


def set_key(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def routing_elements(elements: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """The first elements in the common order (late buckets last, then by hash)."""
    n = len(elements)
    order = np.argsort(late[(elements >> np.uint64(64 - BUCKET_BITS)).astype(np.intp)], kind="stable")
    return elements[order[:n - int(needed(n, percent)) + 1]] if n else elements


# ---------------------------------------------------------------- tree

class Tree:
    """Signature tree over documents sorted by size; level 0 are the documents.

    A level is (lowest size, highest size, largest excess, OR bitmap, component,
    largest counts, whether the documents below are in several components)."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, counts: np.ndarray, components: np.ndarray):
        excess = sizes - np.bitwise_count(bitmaps).sum(1)
        self.levels = [(sizes, sizes, excess, bitmaps, components, counts, np.zeros(len(sizes), bool))]
        while len(self.levels[-1][0]) > 1:
            low, high, excess, ors, comp, counts, mixed = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            several = np.minimum.reduceat(comp, cuts) != np.maximum.reduceat(comp, cuts)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                                np.maximum.reduceat(excess, cuts), np.bitwise_or.reduceat(ors, cuts, axis=0),
                                comp[cuts], np.maximum.reduceat(counts, cuts, axis=0),
                                several | np.logical_or.reduceat(mixed, cuts)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def _possible(a, b, percent: int) -> np.ndarray:
    """Which of the node pairs may hold a linked pair of two components."""
    fits = (100 * a[1] >= percent * b[0]) & (100 * b[1] >= percent * a[0]) & ((a[4] != b[4]) | a[6] | b[6])
    k = np.flatnonzero(fits)
    common = np.bitwise_count(a[3][k] & b[3][k]).sum(1).astype(np.int64) + np.minimum(a[2][k], b[2][k])
    top = np.minimum(common, np.minimum(a[1][k], b[1][k]))
    ok = (100 + percent) * top >= percent * (a[0][k] + b[0][k])
    fits[k] = ok
    k = k[ok & (np.minimum(a[1][k], b[1][k]) >= COUNTED)]
    for s in range(0, len(k), 2048):
        part = k[s:s + 2048]
        top = np.minimum(a[5][part], b[5][part]).sum(1, dtype=np.int64)
        fits[part] = ((100 + percent) * top >= percent * (a[0][part] + b[0][part])) \
            | ((a[5][part] == ANY) & (b[5][part] == ANY)).any(1)
    return fits


def traverse(left: Tree, right: Tree, percent: int):
    """Arrays (i, j) of document pairs that survive; i < j when a tree meets itself."""
    stack = [(max(len(left.levels), len(right.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = np.arange(FANOUT)
    while stack:
        level, i, j = stack.pop()
        ok = _possible([x[i] for x in left.level(level)], [x[j] for x in right.level(level)], percent)
        if level == 0 and left is right:
            ok &= i < j
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        # a shallower tree waits at its root
        down = [i[:, None] * FANOUT + step if level < len(left.levels) else i[:, None],
                j[:, None] * FANOUT + step if level < len(right.levels) else j[:, None]]
        pi = np.repeat(down[0], down[1].shape[1], axis=1).ravel()
        pj = np.tile(down[1], (1, down[0].shape[1])).ravel()
        ok = (pi < len(left.level(level - 1)[0])) & (pj < len(right.level(level - 1)[0]))
        if left is right:
            ok &= pi <= pj
        pi, pj = pi[ok], pj[ok]
        stack += [(level - 1, pi[a:a + 8192], pj[a:a + 8192]) for a in range(0, len(pi), 8192)]


def leader_pairs(sizes: np.ndarray, bitmaps: np.ndarray, counts: np.ndarray, components: np.ndarray, order: np.ndarray, percent: int):
    """(leader, document): each document with the first one in ``order`` of another component that it may be linked with."""
    nodes = Tree(sizes, bitmaps, counts, components)
    free = np.ones(len(sizes), bool)
    for k in order:
        if free[k]:
            one = Tree(sizes[k:k + 1], bitmaps[k:k + 1], counts[k:k + 1], components[k:k + 1])
            near = np.concatenate([j for _, j in traverse(one, nodes, percent)] or [np.zeros(0, np.int64)])
            near = near[free[near] & (near != k)]
            free[near] = free[k] = False
            yield np.full(len(near), k), near


def met_before(firsts: np.ndarray, known: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether documents i and j share one of their first elements before this cell (``known`` of each)."""
    at = np.arange(firsts.shape[1])
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 2048):
        a, b = i[s:s + 2048], j[s:s + 2048]
        same = firsts[a][:, :, None] == firsts[b][:, None, :]
        same &= (at < known[a][:, None])[:, :, None] & (at < known[b][:, None])[:, None, :]
        out[s:s + 2048] = same.any((1, 2))
    return out


def small_pairs(starts: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray], percent: int):
    """Surviving pairs of keys of all cells of at most FANOUT documents in a batch: under one node a traversal
    compares its leaves, here those of all cells at once. ``columns`` as in a batch of _survivors."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, FANOUT + 1):
        a, b = np.triu_indices(m, 1)
        at = starts[sizes == m][:, None]
        i.append((at + a).ravel())
        j.append((at + b).ravel())
    i, j = np.concatenate(i), np.concatenate(j)
    keys, size, comp, bitmaps, counts, firsts, known = columns[4:]
    ok = (comp[i] != comp[j]) & (100 * size[i] >= percent * size[j]) & (100 * size[j] >= percent * size[i])
    i, j = i[ok], j[ok]
    new = ~met_before(firsts, known, i, j)
    i, j = i[new], j[new]
    excess, mixed = size - np.bitwise_count(bitmaps).sum(1), np.zeros(len(size), bool)
    leaf = (size, size, excess, bitmaps, comp, counts, mixed)
    for s in range(0, len(i), 8192):
        a, b = i[s:s + 8192], j[s:s + 8192]
        fits = _possible([x[a] for x in leaf], [x[b] for x in leaf], percent)
        yield keys[a[fits]], keys[b[fits]]


def cell_pairs(keys: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, counts: np.ndarray, components: np.ndarray,
               side: np.ndarray, percent: int, leaders: int, firsts: np.ndarray, known: np.ndarray):
    """Surviving pairs of keys in one cell or pair of blocks."""
    order = np.argsort(sizes, kind="stable")
    keys, sizes, bitmaps, counts, components, side, firsts, known = (
        x[order] for x in (keys, sizes, bitmaps, counts, components, side, firsts, known))
    if leaders:
        for i, j in leader_pairs(sizes, bitmaps, counts, components, np.argsort(mix(keys.view(np.uint64) + np.uint64(leaders)), kind="stable"), percent):
            yield keys[i], keys[j]
        return
    parts = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [Tree(sizes[p], bitmaps[p], counts[p], components[p]) for p in parts]
    for i, j in traverse(trees[0], trees[-1], percent):
        i, j = parts[0][i], parts[-1][j]
        new = ~met_before(firsts, known, i, j)
        yield keys[i[new]], keys[j[new]]


# ---------------------------------------------------------------- jobs

def _bucket_counts(rows: DataFrame, n: int) -> np.ndarray:
    """How many set elements of all documents fall into each of 2**BUCKET_BITS buckets."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for elements in shingle_sets(batch.column("text").to_pylist(), n):
                total += np.bincount((elements >> np.uint64(64 - BUCKET_BITS)).astype(np.intp), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int32())], names=["bucket", "n"])

    # at most 2**BUCKET_BITS rows reach the driver
    found = rows.select("text").mapInArrow(run, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _late(counts: np.ndarray) -> np.ndarray:
    """Class of each bucket: 0 for counts that chance explains (six deviations), more for each doubling beyond."""
    usual = counts.mean() + 6 * np.sqrt(max(counts.mean(), 1.0))
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / usual))).astype(np.int8)


def _signatures(rows: DataFrame, late: np.ndarray, n: int, percent: int) -> DataFrame:
    """(id, size, key, route, signature) of every document."""
    import pyarrow as pa
    schema = T.StructType([rows.schema["id"], T.StructField("size", T.LongType()), T.StructField("key", T.LongType()),
                           T.StructField("route", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            routes = [routing_elements(s, late, percent) for s in sets]
            stops = np.concatenate(([0], np.cumsum([len(r) for r in routes])))
            flat = np.concatenate([*routes, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat)),
                pa.array([signature(s) for s in sets], pa.binary())], names=schema.names)

    return rows.select("id", "text").mapInArrow(run, schema)


def _met(cells: DataFrame) -> DataFrame:
    """The rows of cells (cell, key, place, comp) in which pairs of two components can meet, with the number of the cell's blocks."""
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"),
                                       F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
                                       F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by("place", "key").alias("at"))
    # cells with one component have nothing to find; of cells with the same members the first in the common order is enough
    counts = counts.where("c0 <> c1").groupBy("m", "x", "y").agg(F.min(F.struct("at", "cell")).alias("c")) \
                   .select(F.col("c.cell").alias("cell"), "m")
    return cells.join(counts.select("cell", F.ceil(F.col("m") / BLOCK).alias("blocks")), "cell")


def _survivors(met: DataFrame, signatures: DataFrame, percent: int, leaders: int) -> DataFrame:
    """(a, b): keys of pairs that survive the trees of the cells (cell, key, place, comp, blocks).

    ``leaders`` 0: all pairs of two components; else only pairs with leaders, in an order of that number."""
    import pyarrow as pa

    rows = met.join(signatures, "key").withColumn("own", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "key",
                       "size", "comp", "signature", "place", "firsts")
    width = shuffle_width(met.sparkSession)
    rows = rows.repartition(width, "cell", "p", "q").sortWithinPartitions("cell", "p", "q")

    def run(batches):
        held: list[tuple] = []

        def pairs():
            group = [np.concatenate(x) for x in zip(*held)]
            found = list(cell_pairs(group[4], group[5], group[7], group[8], group[6], group[3], percent, leaders, *group[9:]))
            for a in range(0, len(found), 256):
                i, j = (np.concatenate(x) for x in zip(*found[a:a + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "p", "q", "own", "key", "size", "comp")]
            columns += unpacked(batch.column("signature").to_pylist())
            lists = batch.column("firsts")
            length = np.minimum(lists.value_lengths().to_numpy(zero_copy_only=False), FIRSTS)
            firsts = np.zeros((batch.num_rows, FIRSTS), np.int64)
            firsts[np.arange(FIRSTS) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            columns += [firsts, np.minimum(length, batch.column("place").to_numpy(zero_copy_only=False))]
            place = np.stack(columns[:3])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [batch.num_rows]))
            small = np.zeros(len(begin), bool)
            if not leaders and len(begin) > 2:
                # cells that begin and end within this batch
                small[1:-1] = (end - begin)[1:-1] <= FANOUT
                for i, j in small_pairs(begin[small], (end - begin)[small], columns, percent):
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["a", "b"])
            for a, b in zip(begin[~small].tolist(), end[~small].tolist()):
                if held and any(held[-1][k][-1] != columns[k][a] for k in range(3)):
                    yield from pairs()
                    held = []
                if b > a:
                    held.append(tuple(c[a:b] for c in columns))
        if held:
            yield from pairs()

    found = rows.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(key, elements) of all keys in ``pairs``: n-gram sets made anew from the texts of ``nodes`` (key, id)."""
    import pyarrow as pa

    used = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = written(nodes.join(used, "key", "left_semi").select("key", F.col("id").alias("_id")))
    if 64 * wanted.count() <= broadcast_bytes:  # a key, an id and what a hash table adds; beyond, a shuffled join
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id"))).select("key", "text")

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            keys = batch.column("key").to_pylist()
            mine = [k for k, s in enumerate(sets) if set_key(s) == keys[k]]  # another row may have the same id
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in mine], pa.int64()),
                                              pa.array([sets[k].tobytes() for k in mine], pa.binary())], names=["key", "elements"])

    return texts.mapInArrow(run, "key long, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, group: int = 2048) -> DataFrame:
    """The pairs (a, b) whose sets have the Jaccard similarity.

    Each key ``a`` meets its partners in groups, so that a key with very many
    partners is spread over tasks; a task holds one set of ``a`` and reads the
    partners one batch at a time."""
    import pyarrow as pa

    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / group).alias("groups"))
    dealt = (pairs.join(shares, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups"))))
    partners = dealt.join(sets, F.col("b") == F.col("key")).select("a", "part", F.col("b").alias("key"), "elements")
    heads = (shares.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
             .join(sets, F.col("a") == F.col("key")).select("a", "part", "key", "elements"))
    rows = heads.withColumn("first", F.lit(0)).unionByName(partners.withColumn("first", F.lit(1)))
    rows = rows.repartition(shuffle_width(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "first")

    def run(batches):
        head = None
        for batch in batches:
            out = []
            for a, first, key, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "first", "key", "elements"))):
                elements = np.frombuffer(raw, np.uint64)
                if first == 0:
                    head = elements
                else:
                    at = np.minimum(np.searchsorted(head, elements), len(head) - 1)
                    common = int((head[at] == elements).sum())
                    if 100 * common >= percent * (len(head) + len(elements) - common):
                        out.append((a, key))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90,
                    first_elements: int = 3, leader_rounds: int = 4) -> DataFrame:
    """(id, n_shingles, component_id) of every row; documents link when
    100 * intersection >= percent * union of their n-gram sets."""
    spark = df.sparkSession
    batches_of(spark, 500)
    folder = scratch(spark, "sigtree")

    def put(some: DataFrame, name: str) -> DataFrame:
        some.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    late = _late(_bucket_counts(rows, n))
    docs = put(_signatures(rows, late, n, percent), "documents")
    filled = docs.where("size > 0")

    route = filled.select("key", F.col("size").cast("int").alias("size"), F.posexplode("route").alias("place", "cell"))
    # an element of two sets or more; windows and groups of a cell come out of one shuffle
    here = Window.partitionBy("cell")
    shared = route.withColumn("lo", F.min("key").over(here)).withColumn("hi", F.max("key").over(here)).where("lo <> hi")
    cells = shared.groupBy("cell", "key", "size").agg(F.min("place").alias("place"))
    # a document's place among its shared elements; a window holds one document's
    order = Window.partitionBy("key").orderBy("place", "cell")
    cells = put(cells.withColumn("place", F.row_number().over(order) - 1), "cells")
    numbered, members = cells, cells.select("key").distinct()
    # linked sets differ by less than one of these bands in size, so they meet in the larger one's
    band = F.floor(F.log(F.col("size").cast("double")) / (1.0001 * math.log(100 / percent))) if percent < 100 else F.col("size")
    cells = cells.withColumn("band", F.explode(F.array(band, band + 1))) \
                 .withColumn("cell", F.xxhash64("cell", "band"))
    nodes = put(filled.join(members, "key", "left_semi").groupBy("key")
                    .agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("signature").alias("signature")), "nodes")
    # the first shared elements of every document, in the common order
    firsts = (numbered.where(F.col("place") < FIRSTS).groupBy("key")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]).alias("firsts")))
    signatures = put(nodes.select("key", "size", "signature").join(firsts, "key"), "signatures")
    # what follows reads ids and sizes only: the tables that hold routes and signatures a second time go
    docs, nodes = put(docs.select("id", "size", "key"), "sizes"), put(nodes.select("key", "id"), "ids")
    discard(spark, f"{folder}/documents")
    discard(spark, f"{folder}/nodes")

    def verified(some: DataFrame, leaders: int, name: str, parts: int = 1) -> DataFrame:
        """The linked pairs of the cells; pairs and sets of the round go once they are verified."""
        met, found = put(_met(some), f"met-{name}"), None
        for k in range(parts):
            if parts > 1:
                settle(spark)
            part = met.where(F.pmod(F.xxhash64("cell", F.lit(3)), F.lit(parts)) == k)
            new = put(_survivors(part, signatures, percent, leaders), f"part-{name}-{k}")
            found = new if found is None else found.unionByName(new)
        found = put(found.distinct(), f"pairs-{name}") if parts > 1 else found
        discard(spark, f"{folder}/met-{name}")
        sets = put(_sets(rows, nodes, found, n), f"sets-{name}")
        links = put(_verified(found, sets, percent), f"links-{name}")
        for table in ([f"pairs-{name}"] if parts > 1 else []) + [f"part-{name}-{k}" for k in range(parts)]:
            discard(spark, f"{folder}/{table}")
        discard(spark, f"{folder}/sets-{name}")
        return links

    def placed(some: DataFrame, known: DataFrame | None) -> DataFrame:
        if known is None:
            return some.select("cell", "key", "place", F.col("key").alias("comp"))
        return some.select("cell", "key", "place").join(known, "key", "left") \
                   .select("cell", "key", "place", F.coalesce("comp", "key").alias("comp"))

    links, known, r = None, None, 0
    for r in range(leader_rounds):
        early = cells.where(F.col("place").between(r * first_elements, (r + 1) * first_elements - 1))
        if links is not None and early.isEmpty():
            break
        new = verified(placed(early, known), r + 1, str(r))
        links = new if links is None else links.unionByName(new)
        known = put(_components(links), f"components-{r}")
        if r:
            discard(spark, f"{folder}/components-{r - 1}")
    rest = verified(placed(cells, known), 0, "rest", PARTS)
    if not rest.isEmpty():
        known = put(_components(links.unionByName(rest)), "components-rest")
    discard(spark, f"{folder}/cells")
    discard(spark, f"{folder}/signatures")

    names = docs.groupBy("key").agg(F.min("id").alias("id")).join(known, "key", "left") \
                .withColumn("comp", F.coalesce("comp", "key"))
    least = names.groupBy("comp").agg(F.min("id").alias("component_id"))
    names = written(names.join(least, "comp").select("key", "component_id"))
    return (docs.select("id", "size", "key").join(names, "key")
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                    F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def _components(links: DataFrame) -> DataFrame:
    """(key, comp) of all linked keys."""
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("node_id").alias("key"), F.col("component_id").alias("comp"))
