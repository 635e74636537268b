"""A Merkle tree per group of rows and one over the groups, with a proof for every row.

*Positions.* Rows stand in (group, id, leaf) order. The order is dealt over
ranges and numbered by prefix sums, so a group with most of the rows spans many
tasks; a row's position in its group follows from the group's first position.

*Slot pivot.* One conditional aggregate per slot spreads the children below a
node into columns: ``slots`` (a power of the fan-out, so one aggregate covers
several levels) children of a node become columns s0, s1, ... of one row.
Hashing concatenated columns gives the parents, concatenating a run's columns
without the own one gives the siblings. A tree of n leaves takes log(n) /
log(slots) aggregates of n, n / slots, ... rows; leaves carry what they need in
their slot, so that neither leaves nor proofs are joined by position.

*Proofs.* From the top down, each aggregate's rows get the path of their node
and hand the children the path below it: per level the concatenated siblings
before and after the own slot. A path has one entry a level, so it grows with
the logarithm of the rows.

A leaf is the hash of its fields, each as UTF-8 byte count, ``:``, value (or
``-`` for null); hash means lower-case hex SHA-256 of concatenated texts,
digests as hex texts. While a level has several nodes, each run of ``fanout``
consecutive ones (the last may be shorter) becomes the hash of the run.

Defined results: the null group comes first, groups go by the bytes of their
text; null ids come first in a group; rows with one id go by their leaf; equal
rows take consecutive places in any order; a group of one row has its leaf as
root; an empty table gives no rows. Empty texts are values of 0 bytes. Input
columns other than the named ones do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import global_order_prefix
from .common import written

#: one level of a path: the siblings before and after the own slot
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields, each with its length in front."""
    return digest(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-"))
                    for f in fields])


def _slots(fanout: int, least: int = 16) -> tuple[int, int]:
    """(slots, levels): the smallest power of the fan-out of at least ``least`` slots."""
    slots, levels = fanout, 1
    while slots < least:
        slots, levels = slots * fanout, levels + 1
    return slots, levels


def _with_levels(rows: DataFrame, slots: int, levels: int, fanout: int, below: int) -> DataFrame:
    """Pivoted rows with the arrays _0 (their slots' hashes), _1, ... of the nodes of each level.

    ``below`` levels lie under the slots. A level beyond the tree's ``depth`` has
    one node, which stays as it is. Each level is a column of its own, so its
    hashes are evaluated once."""
    rows = rows.withColumn("_0", F.array(*[F.col(f"s{k}.hash") for k in range(slots)]))
    for level in range(levels):
        last = [F.get(f"_{level}", F.lit(k)) for k in range(slots // fanout ** level)]
        rows = rows.withColumn(f"_{level + 1}", F.array(*[
            F.when(F.col("depth") <= below + level, last[a])
            .when(last[a].isNotNull(), digest(*[F.coalesce(x, F.lit("")) for x in last[a:a + fanout]]))
            for a in range(0, len(last), fanout)]))
    return rows


def _pivot(nodes: DataFrame, slots: int) -> DataFrame:
    """(g, up, depth, s0, s1, ...): the children (hash, load) of every node, one column a slot."""
    slot = F.pmod(F.col("idx"), F.lit(slots))
    child = F.struct("hash", "load")
    return (nodes.groupBy("g", F.expr(f"idx div {slots}").alias("up"))
            .agg(F.max("depth").alias("depth"), *[F.max(F.when(slot == k, child)).alias(f"s{k}") for k in range(slots)]))


def tree_paths(leaves: DataFrame, deepest: int, tops, fanout: int = 2) -> DataFrame:
    """(g, idx, hash, load, root, path, ...) of every leaf of many trees.

    ``leaves`` has tree ``g``, place ``idx`` from 0, ``depth`` (levels of the
    tree), ``hash`` and a struct ``load`` to carry along. ``tops`` maps the
    (g, hash) of all roots to (g, path, ...): the paths above them and further
    columns, which all leaves of the tree get. ``deepest`` is the largest depth."""
    slots, levels = _slots(fanout)
    nodes, pivots = leaves, []
    for k in range(max(1, -(-deepest // levels))):
        pivots.append(written(_pivot(nodes, slots)))
        nodes = _with_levels(pivots[-1], slots, levels, fanout, k * levels) \
            .select("g", F.col("up").alias("idx"), "depth", F.get(f"_{levels}", F.lit(0)).alias("hash"),
                    F.struct(F.lit(0).alias("none")).alias("load"))
    paths = tops(nodes.select("g", "hash")).withColumn("idx", F.lit(0).cast("long"))
    more = [c for c in paths.columns if c not in ("g", "idx")]
    for k in reversed(range(len(pivots))):
        rows = _with_levels(pivots[k], slots, levels, fanout, k * levels).join(paths.withColumnRenamed("idx", "up"), ["g", "up"])

        def step(slot: int, level: int) -> Column:
            at = slot // fanout ** level
            first = at - at % fanout
            def side(ks):
                return F.concat_ws("", *[F.get(f"_{level}", F.lit(x)) for x in ks])
            return F.struct(side(range(first, at)).alias("before"), side(range(at + 1, first + fanout)).alias("after"))

        def child(slot: int) -> Column:
            steps = F.filter(F.array(*[F.when(F.col("depth") > k * levels + n, step(slot, n)) for n in range(levels)]), lambda x: x.isNotNull())
            return F.when(F.col(f"s{slot}").isNotNull(),
                          F.struct((F.col("up") * slots + slot).alias("idx"), F.col(f"s{slot}.hash").alias("hash"),
                                   F.col(f"s{slot}.load").alias("load"), F.concat(steps.cast(STEP), "path").alias("path")))

        rest = [c for c in more if c != "path"]
        rows = rows.select("g", *rest, F.explode(F.array_compact(F.array(*[child(s) for s in range(slots)]))).alias("_c"))
        paths = rows.select("g", *rest, "_c.idx", "_c.hash", "_c.load", "_c.path")
        if k:
            paths = paths.drop("hash", "load")
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: digest(x["before"], acc, x["after"]))


def path_hash(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def _depth(count: Column, fanout: int) -> Column:
    """Levels above ``count`` leaves: steps of ceil(n / fanout) until one node is left."""
    steps = [(count > F.lit(fanout ** level)).cast("int") for level in range(62) if fanout ** level < 2 ** 62]
    return sum(steps[1:], steps[0])


def merkle_manifest(df: DataFrame, group: Column, order: Column, leaf: Column, load: dict[str, Column],
                    fanout: int = 2) -> DataFrame:
    """One row per row of ``df``: leaf, subroot, root, path and the ``load`` columns.

    ``load`` is carried in the slot of each leaf, so keep it small (ids, digests).
    The path leads from the leaf through its group's root to the root."""
    rows = written(df.select(group.alias("_group"), order.alias("_order"), leaf.alias("hash"),
                             F.struct(*[c.alias(n) for n, c in load.items()]).alias("load"))
                   .withColumn("_row", F.monotonically_increasing_id()))
    placed = global_order_prefix(rows, [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("hash"), F.col("_row")])
    groups = placed.groupBy("_group").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = written(global_order_prefix(groups, [F.col("_group").asc_nulls_first()])
                     .select(F.col("_group").alias("_g"), "_first", (F.col("_pos") - 1).alias("g"), _depth(F.col("_n"), fanout).alias("depth")))
    count, deepest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    leaves = placed.join(groups, F.col("_group").eqNullSafe(F.col("_g"))) \
                   .select("g", (F.col("_pos") - F.col("_first")).alias("idx"), "depth", "hash", "load")

    def one_root(roots: DataFrame) -> DataFrame:
        return roots.select("g", F.col("hash").alias("root"), F.array().cast(STEP).alias("path"))

    def upper(roots: DataFrame) -> DataFrame:
        if count <= 1:
            return one_root(roots).withColumn("subroot", F.col("root"))
        depth = next(n for n in range(63) if fanout ** n >= count)
        inner = roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"),
                             F.lit(depth).alias("depth"), "hash", F.struct(F.lit(0).alias("none")).alias("load"))
        return tree_paths(inner, depth, one_root, fanout).select(F.col("idx").alias("g"), "root", "path", F.col("hash").alias("subroot"))

    found = tree_paths(leaves, deepest, upper, fanout)
    return found.select(F.col("hash").alias("leaf"), "subroot", "root", "path", *[F.col("load")[n].alias(n) for n in load])
