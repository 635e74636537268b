"""Skew-safe building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DEFAULT_SALT_BUCKETS = 16


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int,
                    rank_col: str = "rank", salt_col: str | None = None,
                    salt_buckets: int = DEFAULT_SALT_BUCKETS) -> DataFrame:
    """Exact top-k rows per group with a two-level (salted) ranking.

    A hot group (one buyer holding a third of all rows) would otherwise be
    sorted by one task. Rows are first ranked inside ``(group, salt)`` sub-groups
    and only the first k of each survive; the true top-k of a group is always
    contained in the union of its sub-groups' top-k, so the second ranking over
    at most ``k * salt_buckets`` rows per group is exact. ``order_cols`` must be a
    total order (add id tiebreaks) for a deterministic result.
    """
    salt_src = F.col(salt_col) if salt_col else F.struct(*[F.col(c) for c in df.columns])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (cand.withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= k).drop("_salt", "_r1"))


def with_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (replaces ``OVER ()`` windows).

    ``scalars`` is a global aggregate, i.e. exactly one row by construction, so
    the cross join is a broadcast of a single row, not a pairwise product.
    """
    return df.crossJoin(F.broadcast(scalars))


def average_rank(df: DataFrame, value_col: str, out_col: str, partition_cols: list[str] | None = None) -> DataFrame:
    """Average rank of ties (1-based), as pandas ``rank(method='average')``.

    Ranks are computed over *distinct values* (pre-aggregated counts) and joined
    back. Without partition columns the values are ranked by a two-level prefix
    sum, so no task sees all of them.
    """
    parts = partition_cols or []
    counts = df.groupBy(*parts, value_col).agg(F.count(F.lit(1)).alias("_n"))
    if not parts:
        counts = counts.select(F.col(value_col).alias("_value"), "_n")
        placed = global_order_prefix(counts, [F.col("_value")], {"rows": F.col("_n").cast("double")})
        ranks = placed.select("_value", (F.col("_cum_rows") - (F.col("_n") - 1) / 2.0).alias(out_col))
        return df.join(ranks, F.col(value_col).eqNullSafe(F.col("_value")), "left").drop("_value")
    w = Window.partitionBy(*parts).orderBy(F.col(value_col)).rowsBetween(Window.unboundedPreceding, 0)
    ranks = (counts.withColumn("_cum", F.sum("_n").over(w))
             .select(*parts, value_col,
                     (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out_col)))
    return df.join(ranks, on=[*parts, value_col], how="left")


def minmax_scale(df: DataFrame, col: str, out_col: str) -> DataFrame:
    """Min–max scaling (T10) with one global min/max aggregate.

    NaN is ignored for the range; an empty, constant or non-finite range gives
    0 for every row; results are clipped to [0, 1]; NULL input stays NULL.
    """
    c = F.col(col)
    not_nan = F.when(~F.isnan(c), c)
    stats = df.agg(F.min(not_nan).alias("_mn"), F.max(not_nan).alias("_mx"))
    inf = float("inf")
    degenerate = (F.col("_mn").isNull() | (F.abs(F.col("_mn")) == inf)
                  | (F.abs(F.col("_mx")) == inf) | (F.col("_mx") == F.col("_mn")))
    scaled = (F.when(c.isNull(), F.lit(None).cast("double"))
              .when(degenerate, F.lit(0.0))
              .otherwise(F.least(F.greatest((c - F.col("_mn")) / (F.col("_mx") - F.col("_mn")), F.lit(0.0)),
                                 F.lit(1.0))))
    return with_scalar(df, stats).withColumn(out_col, scaled).drop("_mn", "_mx")


def global_order_prefix(df: DataFrame, order_cols: list[Column], sums: dict[str, Column] | None = None,
                        buckets: int | None = None) -> DataFrame:
    """Position in a global total order plus inclusive running sums, without a
    one-partition window (two-level prefix sum).

    1. ``repartitionByRange`` splits the total order into ``buckets`` ranges
       (``order_cols`` should end with a unique id so equal values can split);
    2. per-bucket counts/sums -> exclusive offsets over at most ``buckets`` rows
       (bounded, so the offset table is broadcast);
    3. a window partitioned by bucket gives the local position and sums.

    Adds ``_pos`` (1-based long) and ``_cum_<name>`` for every entry of ``sums``.
    """
    sums = sums or {}
    spark = df.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 1)
    r = df.repartitionByRange(n, *order_cols).withColumn("_b", F.spark_partition_id())
    for k, c in sums.items():
        r = r.withColumn(f"_v_{k}", c)
    # range bounds come from a sample taken per execution: materialise the
    # bucket assignment once so the offsets and the local windows agree
    ensure_checkpoint_dir(spark)
    r = r.checkpoint(eager=True)
    tot = r.groupBy("_b").agg(F.count(F.lit(1)).alias("_bn"),
                              *[F.sum(f"_v_{k}").alias(f"_bs_{k}") for k in sums])
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= n rows
    off = tot.select("_b", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off_n"),
                     *[F.coalesce(F.sum(f"_bs_{k}").over(wb), F.lit(0.0)).alias(f"_off_{k}") for k in sums])
    wl = Window.partitionBy("_b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(off), "_b").withColumn("_pos", (F.col("_off_n") + F.row_number().over(wl)).cast("long"))
    for k in sums:
        out = out.withColumn(f"_cum_{k}", F.col(f"_off_{k}") + F.sum(f"_v_{k}").over(wl))
    return out.drop("_b", "_off_n", "_bn", *[f"_off_{k}" for k in sums], *[f"_v_{k}" for k in sums])


def segmented_prefix(df: DataFrame, key_cols: list[str], order_cols: list[Column], sums: dict[str, Column],
                     buckets: int | None = None) -> DataFrame:
    """Inclusive running sums per key (``_cum_<name>``) in which a key may span tasks.

    The table is dealt over ranges of (key, order). Inside a range a window adds
    up; a key that goes on from earlier ranges (at most one a range, so the table
    of carries has at most ``buckets`` rows and is broadcast) gets what they hold
    of it. ``order_cols`` should be a total order within a key.
    """
    spark = df.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 1)
    for k, c in sums.items():
        df = df.withColumn(f"_v_{k}", c)
    r = df.repartitionByRange(n, *[F.col(c) for c in key_cols], *order_cols).withColumn("_b", F.spark_partition_id())
    # range bounds come from a sample taken per execution: hold the assignment
    ensure_checkpoint_dir(spark)
    r = r.checkpoint(eager=True)
    tot = r.groupBy("_b", *key_cols).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(*key_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (tot.select(F.col("_b").alias("_cb"), *[F.col(c).alias(f"_key_{c}") for c in key_cols],
                        F.count(F.lit(1)).over(before).alias("_earlier"),
                        *[F.sum(f"_t_{k}").over(before).alias(f"_carry_{k}") for k in sums])
             .where("_earlier > 0").drop("_earlier"))
    same = F.col("_b") == F.col("_cb")
    for c in key_cols:
        same &= F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    local = Window.partitionBy("_b", *key_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(carry), same, "left")
    for k in sums:
        out = out.withColumn(f"_cum_{k}", F.sum(f"_v_{k}").over(local) + F.coalesce(F.col(f"_carry_{k}"), F.lit(0)))
    return out.drop("_b", "_cb", *[f"_key_{c}" for c in key_cols], *[f"_carry_{k}" for k in sums], *[f"_v_{k}" for k in sums])


def grouped_quantiles(df: DataFrame, group_cols: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(group..., one column a quantile): exact quantiles with linear interpolation, nulls left out.

    Rows become counts per (group, value), their running counts per group come
    from a segmented prefix, and the values at the two places around each
    quantile are picked by one aggregate: no task holds a group. Without
    ``group_cols`` there is one row, of nulls if there are no values."""
    x = df.where(F.col(value).isNotNull()).groupBy(*group_cols, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    keys = list(group_cols) or ["_all"]
    if not group_cols:
        x = x.withColumn("_all", F.lit(0))
    x = segmented_prefix(x, keys, [F.col("_x")], {"n": F.col("_n")})
    if group_cols:
        total = x.groupBy(*keys).agg(F.sum("_n").alias("_m")).select(*[F.col(c).alias(f"_g_{c}") for c in keys], "_m")
        same = F.lit(True)
        for c in keys:
            same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        x = x.join(total, same)
    else:  # a join on the one key would deal all values to one task
        x = with_scalar(x, x.agg(F.sum("_n").alias("_m")))
    aggs, out = [], []
    for k, (name, q) in enumerate(quantiles.items()):
        place = (F.col("_m") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("_cum_n") > at) & (F.col("_cum_n") - F.col("_n") <= at)
            aggs.append(F.max(F.when(inside, F.col("_x"))).alias(f"_{side}{k}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_f{k}"))
        lo, hi = F.col(f"_lo{k}").cast("double"), F.col(f"_hi{k}").cast("double")
        out.append((lo + (hi - lo) * F.col(f"_f{k}")).alias(name))
    return x.groupBy(*group_cols).agg(*aggs).select(*group_cols, *out)


def with_quantiles(per_group: DataFrame, df: DataFrame, group_cols: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``per_group`` (one row a group) with exact quantiles of ``value`` over the rows of ``df``."""
    q = grouped_quantiles(df, group_cols, value, quantiles)
    if not group_cols:
        return with_scalar(per_group, q)
    same = F.lit(True)
    for c in group_cols:
        q = q.withColumnRenamed(c, f"_q_{c}")
        same &= F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return per_group.join(q, same, "left").drop(*[f"_q_{c}" for c in group_cols])


def ntile_from_position(pos: Column, n: Column, tiles: int) -> Column:
    """NTILE(tiles) of the row at 1-based position ``pos`` among ``n`` rows."""
    r0 = pos - 1
    q = F.floor(n / tiles)
    rem = n - q * tiles
    big = rem * (q + 1)
    return F.when(r0 < big, F.floor(r0 / (q + 1)) + 1) \
        .otherwise(F.floor((r0 - big) / F.greatest(q, F.lit(1))) + rem + 1).cast("long")
