"""Iterative graph algorithms on DataFrames: connected components (R11) and
PageRank (R06). Vertices get long ids once (materialised), every round is one
job whose result is written below ``spark.checkpoint.dir`` in place of the former
round's, so the plan and the disk keep their size and a lost executor recomputes
at most one round."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import ensure_checkpoint_dir

def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    A plain file scan carries no memory of the plan that produced it, so round
    after round the analysed plan stays the same size."""
    import uuid
    root = ensure_checkpoint_dir(df.sparkSession)
    path = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


class Rounds:
    """The tables of one iterative job, in a folder of its own below the shared checkpoint folder.

    A slot holds the newest table of its name: writing it again deletes the
    former one once the new one is complete, so the folder holds a constant
    number of tables however many rounds a job takes. Plans that still read a
    former table must not be used after that."""

    def __init__(self, spark, name: str):
        import uuid
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds/{name}-{uuid.uuid4().hex}"
        self._held: dict[str, str] = {}
        self._written = 0

    def put(self, slot: str, df: DataFrame, **counts) -> DataFrame:
        """Write ``df`` into ``slot`` and read it back; ``counts`` are aggregates of its rows, taken
        while it is written and kept in ``self.seen``."""
        self._written += 1
        path = f"{self.folder}/{slot}-{self._written}"
        if counts:
            from pyspark.sql import Observation
            taken = Observation()
            df = df.observe(taken, *[c.alias(n) for n, c in counts.items()])
        df.write.parquet(path)
        self.seen = taken.get if counts else {}
        if slot in self._held:
            self._delete(self._held[slot])
        self._held[slot] = path
        if self._written % 16 == 0:
            # the cleaner deletes shuffle files of finished rounds once the driver has collected their plans
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def tables(self) -> list[str]:
        return sorted(self._held.values())

    def close(self) -> None:
        """Delete all tables: what outlives the job has been written elsewhere."""
        self._delete(self.folder)
        self._held = {}

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def iterative_plan_settings(spark):
    """Checkpointed relations carry the constraints of the plan they came
    from; over many rounds constraint inference grows without bound. Iterative
    jobs switch it off for their own duration and restore the caller's value."""
    key = "spark.sql.constraintPropagation.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def vertex_ids(edges: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """(key..., node_id, vid): unique long ids, made stable by a reliable checkpoint."""
    ensure_checkpoint_dir(edges.sparkSession)
    keys = list(key_cols)
    v = (edges.select(*keys, F.col("src").alias("node_id"))
         .unionByName(edges.select(*keys, F.col("dst").alias("node_id"))).distinct()
         .withColumn("vid", F.monotonically_increasing_id()))
    return v.checkpoint(eager=True)


def star_components(pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """(v, root): for every vertex of the edges ``pairs`` (a, b of longs) the smallest vertex of its component.

    Alternating stars (Kiveris et al. 2014): a large star links the larger
    neighbours of every vertex to its smallest neighbour, a small star its smaller
    ones. Edges are rewired in place of labels being passed along them, so a
    round reads ever fewer distinct edges; on a path the rounds grow with the
    logarithm of its length. The job ends when a round changes no edge."""
    e = pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    stamp = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("hi", "lo"))}
    e = rounds.put("stars", e, **stamp)
    seen = None
    while rounds.seen != seen:
        seen = rounds.seen
        both = e.select(F.col("hi").alias("c"), F.col("lo").alias("o")).unionByName(e.select(F.col("lo").alias("c"), F.col("hi").alias("o")))
        least = both.groupBy("c").agg(F.min("o").alias("o")).select(F.col("c").alias("lo"), F.least("c", "o").alias("m"))
        large = e.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(small, "hi")
        new = (linked.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
               .unionByName(small.select("hi", F.col("m").alias("lo"))).distinct())
        e = rounds.put("stars", new, **stamp)
    return e.select(F.col("hi").alias("v"), F.col("lo").alias("root"))


def connected_components(edges: DataFrame, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """(key..., node_id, component_id) with component_id = smallest node_id
    of the component. ``key_cols`` runs many independent graphs (e.g. removal
    scenarios) in the same job: vertex numbers are unique over all of them.

    Vertices get long numbers, alternating stars find each one's root, and the
    roots take the smallest name below them.
    """
    keys = list(key_cols)
    spark = edges.sparkSession
    with iterative_plan_settings(spark):
        rounds = Rounds(spark, "components")
        vids = rounds.put("vids", vertex_ids(edges, key_cols))
        pairs = (edges.join(vids.withColumnRenamed("node_id", "src").withColumnRenamed("vid", "a"), [*keys, "src"])
                 .join(vids.withColumnRenamed("node_id", "dst").withColumnRenamed("vid", "b"), [*keys, "dst"]).select("a", "b"))
        stars = star_components(pairs, rounds)
        named = vids.join(stars.withColumnRenamed("v", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
        names = named.groupBy("root").agg(F.min("node_id").alias("component_id"))
        out = materialize(named.join(names, "root").select(*keys, "node_id", "component_id"))
        rounds.close()
        return out


def component_summary(components: DataFrame) -> DataFrame:
    """Number of components, giant size and share, size bands 1 / 2 / 3-10 / >10."""
    sizes = components.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"), F.max("size").alias("giant_size"),
        (F.max("size") / F.sum("size")).alias("giant_share"),
        F.count_if(F.col("size") == 1).alias("size_1"), F.count_if(F.col("size") == 2).alias("size_2"),
        F.count_if(F.col("size").between(3, 10)).alias("size_3_10"), F.count_if(F.col("size") > 10).alias("size_gt_10"))


def giant_component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges induced by the largest component (ties: smallest component id)."""
    sizes = components.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    giant = sizes.orderBy(F.col("size").desc(), "component_id").limit(1).select("component_id")
    members = components.join(giant, "component_id", "left_semi").select("node_id")
    return edges.join(members.withColumnRenamed("node_id", "src"), "src", "left_semi")


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1.0e-6) -> DataFrame:
    """Weighted PageRank of the undirected graph (each edge both ways,
    transition ∝ weight / weighted degree), uniform teleport, dangling mass
    spread uniformly; stops when the L1 change < n·tol. Ranks sum to 1.

    Raises ``RuntimeError`` when ``max_iter`` rounds do not converge. Every round
    is written out and refers to the previous round by one scan.
    """
    spark = edges.sparkSession
    with iterative_plan_settings(spark):
        rounds = Rounds(spark, "pagerank")
        vids = materialize(vertex_ids(edges))
        n = vids.count()
        if not n:
            return vids.select("node_id", F.lit(0.0).alias("pagerank"))
        e = (edges.join(vids.withColumnRenamed("node_id", "src").withColumnRenamed("vid", "a"), "src")
             .join(vids.withColumnRenamed("node_id", "dst").withColumnRenamed("vid", "b"), "dst")
             .select("a", "b", "weight"))
        und = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
        wdeg = und.groupBy("a").agg(F.sum("weight").alias("_wd"))
        trans = materialize(und.join(wdeg, "a").select("a", "b", (F.col("weight") / F.col("_wd")).alias("p")))
        # vertices without weight leave their mass to everyone
        state = materialize(vids.select("vid").join(trans.select(F.col("a").alias("vid")).distinct()
                                                    .withColumn("_out", F.lit(True)), "vid", "left")
                            .select("vid", F.col("_out").isNull().alias("dangling"), F.lit(1.0 / n).alias("pr")))
        lost = state.where("dangling").agg(F.sum("pr")).first()[0] or 0.0
        for _ in range(max_iter):
            contrib = (trans.join(state.select(F.col("vid").alias("a"), "pr"), "a")
                       .groupBy("b").agg(F.sum(F.col("pr") * F.col("p")).alias("_c")).withColumnRenamed("b", "vid"))
            rank = alpha * (F.coalesce(F.col("_c"), F.lit(0.0)) + lost / n) + (1 - alpha) / n
            state = rounds.put("state", state.withColumnRenamed("pr", "_old").join(contrib, "vid", "left")
                               .select("vid", "dangling", "_old", rank.alias("pr")),
                               err=F.sum(F.abs(F.col("pr") - F.col("_old"))),
                               lost=F.sum(F.when(F.col("dangling"), F.col("pr")).otherwise(0.0))).drop("_old")
            err, lost = rounds.seen["err"], rounds.seen["lost"] or 0.0
            if err < n * tol:
                state = materialize(state)
                rounds.close()
                return state.join(vids, "vid").select("node_id", F.col("pr").alias("pagerank"))
        rounds.close()
        raise RuntimeError(f"PageRank did not converge in {max_iter} rounds (L1 change {err:.3g})")
