"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt to shards by hash. A task builds one shard's graph:
points are inserted in batches; a greedy beam search from the medoid proposes a
point's neighbours, robust pruning keeps a near one and drops those that it
covers (``alpha`` times nearer to it than to the point), and edges are mirrored
and pruned again where a node has too many. Two passes, the second with the
relaxed ``alpha``. All searches and prunings of a batch run in lockstep on
arrays. The graphs are written; each block of queries beam-searches every shard,
and the found vectors are scored again in double precision.

Equal vectors are one node that carries its k + 1 smallest ids: no query can
need more of them.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, as queries or candidates, nor do rows with a
null id; vectors of different lengths are never compared; rows repeated with id
and vector count once; ties go to the smaller id; a query with fewer candidates
gets them all; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BATCH = 256


# ---------------------------------------------------------------- graph

def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int):
    """Nearest nodes of unit vectors: (ids, squared distances), ``width`` per query, nearest first, -1 beyond."""
    n, b = len(x), len(queries)
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    ids[:, 0], dist[:, 0], open_[:, 0] = start, 2 - 2 * (queries @ x[start]), True
    rows = np.arange(b)
    while len(rows):
        best = np.where(open_[rows], dist[rows], np.inf).argmin(1)
        live = open_[rows, best]
        rows, best = rows[live], best[live]
        if not len(rows):
            break
        open_[rows, best] = False
        near = graph[ids[rows, best]]  # padded with n
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        # the same node twice in a row of neighbours does not occur: graph rows are distinct
        d = 2 - 2 * np.einsum("brd,bd->br", x[np.minimum(near, n - 1)], queries[rows])
        d = np.where(fresh, d, np.inf)
        all_d = np.concatenate((dist[rows], d), axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        at = np.arange(len(rows))[:, None]
        dist[rows] = all_d[at, keep]
        ids[rows] = np.concatenate((ids[rows], near), axis=1)[at, keep]
        open_[rows] = np.concatenate((open_[rows], fresh), axis=1)[at, keep] & np.isfinite(dist[rows])
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point the diverse near ones among its candidates (-1: none); padded with len(x)."""
    n = len(x)
    c = np.where((candidates < 0) | (candidates >= n) | (candidates == points[:, None]), n, candidates)
    c = np.sort(c, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    xs = x[np.minimum(c, n - 1)]
    d = np.where(c < n, 2 - 2 * np.einsum("bcd,bd->bc", xs, x[points]), np.inf)
    out = np.full((len(points), degree), n, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        best = d.argmin(1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        out[live, k] = c[rows, best][live]
        cover = 2 - 2 * np.einsum("bcd,bd->bc", xs, xs[rows, best])
        d[alpha * alpha * cover <= d] = np.inf
        d[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = 24, width: int = 48, alpha: float = 1.2, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbours padded with len(x), start node) of unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    graph = np.full((n, degree), n, np.int64)
    start = int((x @ x.mean(0)).argmax())
    if n > 1:  # a random graph to begin with
        k = min(degree // 2, n - 1)
        graph[:, :k] = (np.arange(n)[:, None] + 1 + np.stack([rng.choice(n - 1, k, replace=False) for _ in range(n)])) % n
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            points = order[s:s + BATCH]
            found, _ = beam_search(x, graph, start, x[points], width)
            graph[points] = robust_prune(x, points, np.concatenate((found, graph[points]), axis=1), a, degree)
            # mirror the new edges
            source, target = np.repeat(points, degree), graph[points].ravel()
            source, target = source[target < n], target[target < n]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(nodes), count.max(initial=1)), n, np.int64)
            extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            both = np.sort(np.concatenate((graph[nodes], extra), axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = n
            both = np.sort(both, axis=1)
            small = (both < n).sum(1) <= degree
            graph[nodes[small]] = both[small, :degree]
            for part in np.array_split(np.flatnonzero(~small), max(1, (~small).sum() // BATCH)):
                if len(part):
                    graph[nodes[part]] = robust_prune(x, nodes[part], both[part], a, degree)
    return graph, start


# ---------------------------------------------------------------- jobs

def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _matrix(column, dtype) -> np.ndarray:
    """Rows of an Arrow list column with lists of one length."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(1, keepdims=True)  # against overflow of squares
    v = v / scale
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; [queries, candidates]."""
    return np.einsum("qcd,qd->qc", vectors, queries) / (np.linalg.norm(vectors, axis=2) * np.linalg.norm(queries, axis=1)[:, None])


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = 4096,
                degree: int = 24, width: int = 48, alpha: float = 1.2) -> DataFrame:
    """The written graphs: one row (dim, shard, node, start, ids, vector, near) per distinct vector."""
    import pyarrow as pa

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    same = Window.partitionBy("vector").orderBy("id")
    # dense_rank: repeated rows share a rank; k + 1 ids of each vector at most
    nodes = (rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
             .groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    nodes = written(nodes.withColumn("dim", F.size("vector")))
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    nodes = (nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
             .select("dim", "shard", "shards", "ids", "vector"))
    schema = T.StructType([*nodes.schema.fields, T.StructField("node", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("near", T.ArrayType(T.LongType()))])

    def build(table: pa.Table) -> pa.Table:
        n = table.num_rows
        graph, start = build_graph(_units(_matrix(table.column("vector"), float)), degree, width, alpha)
        return (table.append_column("node", pa.array(np.arange(n))).append_column("start", pa.array(np.full(n, start)))
                .append_column("near", pa.array(list(graph), pa.list_(pa.int64()))))

    return written(nodes.groupBy("dim", "shard").applyInArrow(build, schema))


def search_index(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
                 width: int = 96, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each query but itself."""
    import pyarrow as pa

    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    q = q.where(F.col("query_id").isNotNull() & _usable(F.col("vector"))).distinct().withColumn("dim", F.size("vector"))
    blocks = F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    per = index.groupBy("dim").agg(F.max("shards").alias("shards")).join(q.groupBy("dim").agg(blocks.alias("blocks")), "dim")
    q = (q.join(per, "dim").withColumn("block", F.pmod(F.xxhash64("vector", "query_id"), F.col("blocks")).cast("int"))
         .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))
    dealt = (index.join(per.select("dim", "blocks"), "dim")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    id_type = q.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def search(asked: pa.Table, graph: pa.Table) -> pa.Table:
        out = ([], [], [])
        if asked.num_rows and graph.num_rows:
            graph = graph.sort_by("node")
            vectors, near = _matrix(graph.column("vector"), float), _matrix(graph.column("near"), np.int64)
            units, ids, start = _units(vectors), graph.column("ids").to_pylist(), graph.column("start")[0].as_py()
            wanted, names = _matrix(asked.column("vector"), float), asked.column("query_id").to_pylist()
            for s in range(0, len(wanted), BATCH):
                found, _ = beam_search(units, near, start, _units(wanted[s:s + BATCH]), width)
                found = found[:, :max(4 * k, k + 2)]  # nearest first; scored again exactly
                scores = cosine(wanted[s:s + BATCH], vectors[np.maximum(found, 0)])
                for name, nodes, values in zip(names[s:s + BATCH], found, scores):
                    best = sorted((-v, i) for node, v in zip(nodes, values) if node >= 0 for i in ids[node] if i != name)
                    for v, i in best[:k]:
                        out[0].append(name)
                        out[1].append(i)
                        out[2].append(-v)
        return pa.table({"query_id": pa.array(out[0], asked.schema.field("query_id").type),
                         "id": pa.array(out[1], asked.schema.field("query_id").type), "score": pa.array(out[2], pa.float64())})

    keys = ("dim", "shard", "block")
    found = (q.select(*keys, "query_id", "vector").groupBy(*keys)
             .cogroup(dealt.select(*keys, "node", "start", "ids", "vector", "near").groupBy(*keys)).applyInArrow(search, schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
