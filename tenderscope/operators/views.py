"""Thin chart/viewer data queries (G, V, N families): histograms, shares,
top-k tables and box statistics, all as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_order_prefix, with_quantiles, with_scalar


def log10_histogram(df: DataFrame, col: str, width: float = 0.1) -> DataFrame:
    """Counts per log10 bin of a positive column."""
    b = (F.floor(F.log10(F.col(col)) / width) * width)
    return (df.where(F.col(col) > 0).groupBy(F.round(b, 6).alias("log10_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Min, quartiles, median, max per group (exact percentiles)."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_quantiles(per, df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}) \
        .select(group, "n", "min", "q1", "median", "q3", "max")


def exact_median(df: DataFrame, value, measure: str) -> DataFrame:
    """(measure, centre): the exact median from counts per distinct value and a
    two-level prefix sum, so that no task holds all values."""
    counts = df.select(value.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = global_order_prefix(counts, [F.col("_v")], {"rows": F.col("_c").cast("double")})
    total = placed.agg(F.sum("_c").alias("_t"))
    low, high = F.floor((F.col("_t") - 1) / 2) + 1, F.floor(F.col("_t") / 2) + 1  # 1-based places of the middle rows
    holds = [(F.col("_cum_rows") >= p) & (F.col("_cum_rows") - F.col("_c") < p) for p in (low, high)]
    return with_scalar(placed, total).agg(
        F.lit(measure).alias("measure"),
        ((F.max(F.when(holds[0], F.col("_v"))) + F.max(F.when(holds[1], F.col("_v")))) / 2).alias("centre"))


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """(value, cdf): share of rows at or below each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    placed = global_order_prefix(counts, [F.col(value)], {"rows": F.col("_c").cast("double")})
    # the total of the placed counts: they are written, ``counts`` would run the whole query again
    return with_scalar(placed, placed.agg(F.sum("_c").alias("_t"))).select(value, (F.col("_cum_rows") / F.col("_t")).alias("cdf"))


def degree_summary(metrics: DataFrame) -> DataFrame:
    """90th percentile of degree and top-decile mean over the mean, per node type."""
    counts = metrics.groupBy("node_type", "degree").agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window
    up = Window.partitionBy("node_type").orderBy(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # windows over distinct degrees
    w = counts.withColumn("above", F.sum("c").over(up) - F.col("c")) \
        .withColumn("n", F.sum("c").over(Window.partitionBy("node_type")))
    top = F.floor(F.col("n") / 10)
    taken = F.greatest(F.least(F.col("c"), top - F.col("above")), F.lit(0))
    place = 0.1 * (F.col("n") - 1)  # of the 90th percentile, from the top, 0-based
    def at(k):
        return F.max(F.when((F.col("above") <= k) & (k < F.col("above") + F.col("c")), F.col("degree")))
    return w.groupBy("node_type").agg(
        (at(F.floor(place)) * (1 - F.first(place - F.floor(place))) + at(F.ceil(place)) * F.first(place - F.floor(place))).alias("p90"),
        ((F.sum(taken * F.col("degree")) / F.sum(taken)) / (F.sum(F.col("c") * F.col("degree")) / F.sum("c"))).alias("top_decile_to_mean"))


def share_above(df: DataFrame, col: str, cut: float) -> DataFrame:
    """Rows, rows above a cut-off and their share."""
    return df.agg(F.count(F.col(col)).alias("n"), F.count_if(F.col(col) > cut).alias("above"),
                  (F.count_if(F.col(col) > cut) / F.count(F.col(col))).alias("share_above"))


def degree_ccdf(metrics: DataFrame) -> DataFrame:
    """P(degree >= d) per distinct degree and node type (reverse cumulative over distinct degrees)."""
    g = metrics.groupBy("node_type", "degree").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("node_type").orderBy(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy("node_type")
    # one partition per node type over distinct degrees (bounded by the max degree)
    return g.select("node_type", "degree", "n", (F.sum("n").over(w) / F.sum("n").over(tot)).alias("ccdf"))


def hub_concentration(metrics: DataFrame, value: str = "degree_centrality", node_type: str = "supplier") -> DataFrame:
    """Share of total centrality held by the top decile of nodes (floor(n/10) rows), and top-decile/mean ratio."""
    m = metrics.where(F.col("node_type") == node_type).select("node_id", F.col(value).alias("_v"))
    ranked = global_order_prefix(m, [F.col("_v").desc(), F.col("node_id")])
    tot = m.agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"), F.avg("_v").alias("_mean"))
    r = with_scalar(ranked, tot).where(F.col("_pos") <= F.floor(F.col("_n") / 10))
    return r.groupBy("_n", "_s", "_mean").agg(F.sum("_v").alias("_top"), F.avg("_v").alias("_topmean")).select(
        F.col("_n").alias("nodes"), (F.col("_top") / F.col("_s")).alias("top_decile_share"),
        (F.col("_topmean") / F.col("_mean")).alias("top_decile_to_mean"))


def region_amendment_rates(contracts: DataFrame, min_n: int = 5, exclude: str = "IT") -> DataFrame:
    """Amendment rate per buyer region with >= min_n rows (a national code excluded), and the zero-amendment base rate."""
    g = (contracts.where(F.col("buyer_region") != exclude).groupBy("buyer_region")
         .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("contract_amendments") > 0).cast("double")).alias("amendment_rate"))
         .where(F.col("n") >= min_n))
    base = contracts.agg(F.avg((F.col("contract_amendments") == 0).cast("double")).alias("zero_amendment_base_rate"))
    return with_scalar(g, base)


def risk_table(predictions: DataFrame, search: str = "", top: int = 300) -> DataFrame:
    """Filtered risk table with a literal id search, top rows by probability."""
    p = predictions
    if search:
        p = p.where(F.col("contract_id").contains(search) | F.col("buyer_id").contains(search)
                    | F.col("supplier_id").contains(search))
    return p.orderBy(F.col("ensemble_risk_prob").desc(), "contract_id", "supplier_id", "buyer_id").limit(top)


def anomaly_audit_trail(anomalies: DataFrame, top: int = 300) -> DataFrame:
    """The top anomalies with z = residual / sd and a reason text."""
    sd = anomalies.agg(F.stddev_samp("gb_residual").alias("_sd"))
    a = with_scalar(anomalies, sd).withColumn("z", F.col("gb_residual") / F.col("_sd"))
    reason = F.concat_ws("; ", F.when(F.col("gb_flag"), F.lit("price far from market model")),
                         F.when(F.col("lof_flag"), F.lit("locally isolated")),
                         F.when(F.col("iso_flag"), F.lit("easily isolated")),
                         F.when(F.col("ee_flag"), F.lit("outside robust envelope")))
    return (a.withColumn("reason", reason).drop("_sd")
            .orderBy(F.col("anomaly_score").desc(), F.abs(F.col("z")).desc(), "contract_id").limit(top))


def value_risk_deciles(predictions: DataFrame, value_col: str = "contract_value") -> DataFrame:
    """Mean risk per value decile (NTILE 10 of log value, ties by ids)."""
    from .common import ntile_from_position
    d = predictions.withColumn("_lv", F.log10(F.greatest(F.col(value_col), F.lit(1.0))))
    r = global_order_prefix(d, [F.col("_lv"), F.col("contract_id"), F.col("supplier_id"), F.col("buyer_id")])
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    r = with_scalar(r, n).withColumn("decile", ntile_from_position(F.col("_pos"), F.col("_n"), 10))
    return r.groupBy("decile").agg(F.count(F.lit(1)).alias("contracts"), F.avg("ensemble_risk_prob").alias("mean_risk"),
                                   F.min("_lv").alias("log_value_min"), F.max("_lv").alias("log_value_max"))


def decile_summary(deciles: DataFrame) -> DataFrame:
    """Mean of the deciles' means, the worst decile (ties: the smaller one) and its mean; means to 9 places."""
    m = F.round("mean_risk", 9)
    worst = F.max_by(F.col("decile"), F.struct(m, -F.col("decile")))
    return deciles.agg(F.avg(m).alias("cross_decile_mean"), worst.alias("worst_decile"), F.max(m).alias("worst_mean_risk"))


def with_peak(per_year: DataFrame, year: str, count: str) -> DataFrame:
    """The yearly table with a flag on its peak year (ties: the earlier one)."""
    peak = per_year.agg(F.max_by(F.col(year), F.struct(F.col(count), -F.col(year))).alias("_peak"))
    return with_scalar(per_year, peak).withColumn("is_peak", F.col(year) == F.col("_peak")).drop("_peak")


def inter_community_matrix(edges: DataFrame, partition: DataFrame, top: int = 25) -> DataFrame:
    """Contracts between the top communities, symmetric pair key, log1p and max-normalised."""
    p = partition.select("node_id", "community_id")
    sizes = p.groupBy("community_id").agg(F.count(F.lit(1)).alias("_n"))
    topc = sizes.orderBy(F.col("_n").desc(), "community_id").limit(top).select("community_id")
    pt = p.join(topc, "community_id", "left_semi")
    e = (edges.join(pt.withColumnRenamed("node_id", "src").withColumnRenamed("community_id", "_cs"), "src")
         .join(pt.withColumnRenamed("node_id", "dst").withColumnRenamed("community_id", "_cd"), "dst"))
    m = e.groupBy(F.least("_cs", "_cd").alias("community_a"), F.greatest("_cs", "_cd").alias("community_b")) \
        .agg(F.sum("contracts").alias("contracts"))
    mx = m.agg(F.max(F.log1p("contracts")).alias("_mx"))
    return with_scalar(m, mx).select("community_a", "community_b", "contracts",
                                     (F.log1p("contracts") / F.col("_mx")).alias("intensity"))


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares slope and intercept of y ~ x."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.regr_count(F.col(y), F.col(x)).alias("n"))


def width_histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, group: str | None = None) -> DataFrame:
    """Equal-width histogram on [lo, hi] (values at hi fall in the last bin), optionally per group."""
    b = F.least(F.greatest(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    keys = [group] if group else []
    return df.where(F.col(col).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def explanation_text(predictions: DataFrame) -> DataFrame:
    """Per-row explanation from the rule factors present (NULL parts are skipped)."""
    why = F.concat_ws("; ",
                      F.when(F.col("procedure_type").rlike("(?i)NEGOTIATED|OUTRIGHT"), F.lit("non-open procedure")),
                      F.when(F.col("bid_count") <= 1, F.lit("single bid")),
                      F.when(F.col("contract_amendments") > 2, F.lit("many amendments")),
                      F.when(F.col("ensemble_risk_prob") >= 0.75, F.lit("high predicted risk")))
    return predictions.select("contract_id", "supplier_id", "buyer_id", "ensemble_risk_prob", why.alias("explanation"))
