"""Centroid clustering (Lloyd's rounds) with ns-bounds, in exact integer arithmetic.

*Bounds.* A vector keeps, for every centroid, a distance and the round in which
it was evaluated. As long as the centroid moves, the bound is loosened by the
norm of the total displacement since that round, taken from the history of all
centroids (rounds x clusters x columns numbers), not by the sum of the drifts of
the rounds between: a centroid that wanders back costs nothing.

*Rounds.* A vector whose loosened upper bound for its own centroid lies below the
loosened lower bounds of all others keeps its centroid. Otherwise the distance
to its own centroid is evaluated; the centroids whose lower bound still does not
exceed it are scanned exactly, and their bounds renewed. Bounds are floating
point numbers with a relative slack, comparisons of evaluated distances are
integers, so no rounding changes an assignment.

*State.* Each round reads the vectors with their bounds and writes them with new
ones below ``spark.checkpoint.dir``; the table before is deleted once its
successor is there. The driver holds the history and gets clusters x columns
sums a round, whatever the number of vectors.

Components are ``floor(scale * x)``. A vector takes part if it has exactly
``dims`` components, none null or non-finite. Ties go to the smaller centroid
number; a centroid without vectors stays; fewer vectors than ``clusters`` give
as many centroids as vectors. Seeds are the vectors with the smallest SHA-256 of
``salt:id`` (a null id counts as an empty text); among rows with one id the
smaller vector comes first, and equal rows may give equal centroids, of which
the first gets all vectors. Components beyond 2**27 in size after scaling would
overflow a squared distance: they raise ``ValueError``. An empty table gives no
rows; columns other than the two named do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch

#: relative slack of a bound: far beyond the error of a square root of a long
SLACK = 1e-9
LIMIT = 1 << 27


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, in integers."""
    x = F.col(vector_col)
    good = F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    small = F.forall(x, lambda c: F.abs(c.cast("double")) <= float(LIMIT) / scale)
    return df.select(F.col(id_col).alias("id"), x).where(good).select(
        "id", F.when(small, whole).otherwise(F.raise_error(F.lit("a component beyond 2**27 after scaling"))).alias("v"))


def seeds(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The first centroids: ``clusters`` rows in the order of the hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.orderBy(key, "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = v - centroid
    return (d * d).sum(-1)


def assign(v: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, since: np.ndarray,
           history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, bounds, since, number of evaluated distances) after the last round of ``history``.

    ``history`` is rounds x clusters x columns; ``bounds`` are distances evaluated
    in round ``since`` (vectors x clusters); cluster -1 stands for none yet."""
    now, k = len(history) - 1, history.shape[1]
    moved = np.sqrt(((history - history[now]).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)  # rounds x clusters
    loose = moved[since, np.arange(k)]
    low = bounds * (1 - SLACK) - loose
    rows = np.arange(len(v))
    own = np.maximum(cluster, 0)
    high = bounds[rows, own] * (1 + SLACK) + loose[rows, own]
    others = low.copy()
    others[rows, own] = np.inf
    todo = np.flatnonzero((cluster < 0) | (high >= others.min(1, initial=np.inf)))
    cluster, bounds, since = cluster.copy(), bounds.copy(), since.copy()
    if not len(todo):
        return cluster, bounds, since, 0
    part, mine = v[todo], own[todo]
    best = squared(part, history[now][mine])
    exact = np.sqrt(best.astype(np.float64))
    at = np.arange(len(todo))
    bounds[todo, mine], since[todo, mine] = exact, now
    count = len(todo)
    first = cluster[todo] < 0
    for j in range(k):
        # a tie may go to a smaller number, so bounds that equal the best are scanned too
        scan = np.flatnonzero((mine != j) & (first | (low[todo, j] <= exact * (1 + SLACK))))
        d = squared(part[scan], history[now][j])
        bounds[todo[scan], j], since[todo[scan], j] = np.sqrt(d.astype(np.float64)), now
        count += len(scan)
        closer = (d < best[scan]) | ((d == best[scan]) & (j < own[todo[scan]]))
        hit = scan[closer]
        best[hit] = d[closer]
        own[todo[hit]] = j
    cluster[todo] = own[todo]
    return cluster, bounds, since, count


def _round(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """The state after the assignment to the last centroids of ``history``; with ``last`` the squared distances instead of bounds."""
    import pyarrow as pa
    k, dims = history.shape[1:]
    id_field = state.schema["id"]
    fields = f"cluster int, v array<long>, evaluated int, " + ("distance long" if last else "bounds array<double>, since array<int>")
    from pyspark.sql import types as T
    schema = T.StructType([id_field, *T.StructType.fromDDL(fields).fields])

    def flat(column, dtype, width):
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)

    def listed(matrix, kind):
        stops = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
        return pa.ListArray.from_arrays(stops, pa.array(matrix.ravel(), kind))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            v = flat(batch.column("v"), np.int64, dims)
            if "bounds" in batch.schema.names:
                before = (batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64),
                          flat(batch.column("bounds"), np.float64, k).copy(), flat(batch.column("since"), np.int64, k).copy())
            else:
                before = (np.full(n, -1, np.int64), np.zeros((n, k)), np.zeros((n, k), np.int64))
            cluster, bounds, since, count = assign(v, *before, history)
            columns = [batch.column("id"), pa.array(cluster, pa.int32()), batch.column("v"),
                       pa.array([count] + [0] * (n - 1) if n else [], pa.int32())]
            if last:
                columns.append(pa.array(squared(v, history[-1][cluster]), pa.int64()))
            else:
                columns += [listed(bounds, pa.float64()), listed(since, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return state.mapInArrow(run, schema)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Component-wise floor of the mean of every cluster; clusters without vectors stay as they were."""
    k, dims = before.shape
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(dims)])
    out = before.copy()
    for r in sums.collect():  # at most one row a cluster
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 8,
                    rounds: int = 10, scale: int = 1024, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, v, evaluated, distance) of every vector that takes part, the centroids of all rounds).

    ``evaluated`` sums up to the distances that the last assignment evaluated."""
    spark = df.sparkSession
    folder = scratch(spark, "nsbounds")

    def put(state: DataFrame, name: str) -> DataFrame:
        state.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    vectors = put(whole_vectors(df, id_col, vector_col, dims, scale), "vectors")
    first = seeds(vectors, clusters, salt)
    if not len(first):
        return vectors.select("id", F.lit(0).alias("cluster"), "v", F.lit(0).alias("evaluated"), F.lit(0).cast("long").alias("distance")), \
            np.zeros((1, 0, dims), np.int64)
    history, state, held = first[None], vectors, "vectors"
    for r in range(rounds):
        state = put(_round(state, history, False), f"round-{r}")
        discard(spark, f"{folder}/{held}")
        held = f"round-{r}"
        history = np.concatenate((history, _means(state, history[-1])[None]))
    return _round(state, history, True), history


def with_inertia(assigned: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """The assigned vectors with the inertia of their cluster and of all, and the digest of their centroid."""
    spark = assigned.sparkSession
    rows = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(rows, "cluster int, centroid_sha256 string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row a cluster
    per = per.join(digests, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return assigned.join(F.broadcast(per), "cluster").select(
        F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
