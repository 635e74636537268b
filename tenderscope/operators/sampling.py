"""Sampling and splitting (B1-B11) with md5-seeded order, so a sample does not
depend on partitioning or task retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_order_prefix, ntile_from_position, top_k_per_group, with_scalar


def seeded_key(seed: int, *cols) -> Column:
    """md5(seed|c1|c2|...) with NULL parts as empty strings: a seeded order that
    does not depend on partitioning or task retries."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def year_stratified_cap(df: DataFrame, cap: int, year_col: str = "award_year", id_col: str = "contract_id",
                        tiebreak: list[str] | None = None) -> DataFrame:
    """B1: at most ``cap`` rows per year in md5(id) order (ties by ``tiebreak`` columns),
    by salted ranking: no task sorts a whole year."""
    order = [F.md5(F.col(id_col).cast("string")), *[F.col(c) for c in tiebreak or [id_col]]]
    return top_k_per_group(df, [year_col], order, cap, rank_col="_rn").drop("_rn")


def value_stratified_edge_sample(edges: DataFrame, frac: float = 0.35, seed: int = 42) -> DataFrame:
    """B2: positional value deciles (NTILE 10 by weight, ties by ids), then
    round(n_d · frac) edges per decile, chosen by md5(seed|decile|edge)."""
    ranked = global_order_prefix(edges, [F.col("weight"), F.col("src"), F.col("dst")])
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    d = with_scalar(ranked, n).withColumn("decile", ntile_from_position(F.col("_pos"), F.col("_n"), 10)).drop("_pos", "_n")
    placed = position_in_group(d, "decile", [seeded_key(seed, "decile", "src", "dst"), F.col("src"), F.col("dst")])
    return (placed.where(F.col("_rn") <= F.floor(F.col("_nd") * frac + 0.5))
            .select("src", "dst", "weight", "contracts", "decile"))


def position_in_group(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds ``_rn`` (1-based place of a row in its group) and ``_nd`` (rows of the
    group) for a few large groups: one global order over (group, ``order``), from
    which the rows of all smaller groups are subtracted."""
    placed = global_order_prefix(df, [F.col(group).asc_nulls_first(), *order])
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_nd"))
    earlier = Window.orderBy(F.col(group).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    sizes = sizes.select(F.col(group).alias("_g"), "_nd", F.coalesce(F.sum("_nd").over(earlier), F.lit(0)).alias("_before"))
    return (placed.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
            .withColumn("_rn", F.col("_pos") - F.col("_before")).drop("_pos", "_before", "_g"))


def seeded_sample(df: DataFrame, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """N rows in md5(seed|key) order (the limit is the feature)."""
    return df.orderBy(seeded_key(seed, *key_cols), *key_cols).limit(n)


def class_balanced_sample(df: DataFrame, label: str, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """Up to n/2 positives, the rest negatives, md5-seeded within class."""
    r = top_k_per_group(df, [label], [seeded_key(seed, *key_cols), *[F.col(c) for c in key_cols]], n, rank_col="_rn")
    pos = r.where((F.col(label) >= 1) & (F.col("_rn") <= n // 2))
    n_pos = pos.agg(F.count(F.lit(1)).alias("_np"))
    neg = with_scalar(r.where(F.col(label) < 1), n_pos).where(F.col("_rn") <= n - F.col("_np")).drop("_np")
    return pos.unionByName(neg).drop("_rn")


def hash_split(df: DataFrame, key_cols: list[str], test_pct: int = 25, seed: int = 42) -> DataFrame:
    """Deterministic train/test assignment by pmod(xxhash64(seed, key), 100)."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]), F.lit(100))
    return df.withColumn("split", F.when(h < test_pct, F.lit("test")).otherwise(F.lit("train")))


def temporal_split(df: DataFrame, train: tuple[int, int], val: tuple[int, int], test: tuple[int, int],
                   year_col: str = "award_year") -> DataFrame:
    """Train / validation / test by year ranges; other years are dropped."""
    y = F.col(year_col)
    s = (F.when(y.between(*train), "train").when(y.between(*val), "validation").when(y.between(*test), "test"))
    return df.withColumn("split", s).where(F.col("split").isNotNull())


def stratified_split(df: DataFrame, label: str, test_share: float = 0.25, seed: int = 42,
                     key_cols: list[str] | None = None) -> DataFrame:
    """Seeded split that takes the same share of every class into the test set."""
    keys = key_cols or [c for c in df.columns if c != label][:3]
    placed = position_in_group(df, label, [seeded_key(seed, *keys), *[F.col(c) for c in keys]])
    test = F.col("_rn") <= F.floor(F.col("_nd") * test_share + 0.5)
    return placed.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_rn", "_nd")


def temporal_or_stratified(df: DataFrame, label: str, train: tuple[int, int], test: tuple[int, int], year_col: str = "award_year",
                           min_rows: int = 100, test_share: float = 0.25, seed: int = 42,
                           key_cols: list[str] | None = None) -> DataFrame:
    """Train and test by years; when either has fewer than ``min_rows`` rows or
    a single class, all rows are split by ``stratified_split`` instead."""
    y = F.col(year_col)
    split = F.when(y.between(*train), "train").when(y.between(*test), "test")
    dealt = df.withColumn("split", split).where(F.col("split").isNotNull())
    seen = {r["split"]: r for r in dealt.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k")).collect()}
    if all(s in seen and seen[s]["n"] >= min_rows and seen[s]["k"] > 1 for s in ("train", "test")):
        return dealt
    return stratified_split(df, label, test_share, seed, key_cols)


def plain_folds(df: DataFrame, k: int, seed: int, key_cols: list[str]) -> DataFrame:
    """Fold 0..k-1 from a seeded hash of the row key: no order, no move of rows."""
    head = F.conv(F.substring(seeded_key(seed, *key_cols), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(head, F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """Fold 0..k-1 assigned round-robin within each class in md5 order."""
    keys = key_cols or [c for c in df.columns if c != label][:3]
    placed = position_in_group(df, label, [seeded_key(seed, *keys), *[F.col(c) for c in keys]])
    return placed.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn", "_nd")


def forward_chaining_folds(years: list[int]) -> list[tuple[list[int], int]]:
    """(train years <= t, validate year t+1) pairs over consecutive years."""
    ys = sorted(set(years))
    return [(ys[: i + 1], ys[i + 1]) for i in range(len(ys) - 1)]
