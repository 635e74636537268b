"""Statistics as distributed aggregates.

Every statistic is a handful of sums computed in one aggregation (or over a
table of distinct scores), never a collected column. p-values, where given,
are a scalar function of those sums evaluated on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import average_rank, global_order_prefix, with_scalar

MIN_CORR_PAIRS = 3  # fixed value: fewest paired observations for a correlation


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def _pearson_cols(a: Column, b: Column) -> Column:
    """Pearson r from population moments; NULL when either side is constant.

    Constancy is decided exactly (min = max), not by a floating-point standard
    deviation that can come out as 1e-17 for a constant column."""
    const = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(const, F.lit(None).cast("double")).otherwise(
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def coverage_aware_corr(df: DataFrame, left: str, right: str) -> DataFrame:
    """Three-state Pearson (computed / measured_null / degenerate_low_coverage)."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    paired = ~(_missing(a) | _missing(b))
    pa, pb = F.when(paired, a), F.when(paired, b)
    one = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(paired).alias("n_paired"),
                 F.min(pa).alias("_mina"), F.max(pa).alias("_maxa"), F.min(pb).alias("_minb"), F.max(pb).alias("_maxb"),
                 _pearson_cols(pa, pb).alias("_r"))
    low = F.col("n_paired") < MIN_CORR_PAIRS
    const = (F.col("_mina") == F.col("_maxa")) | (F.col("_minb") == F.col("_maxb"))
    minority = F.col("n_paired") * 2 < F.col("n_total")
    status = (F.when(low, "degenerate_low_coverage").when(const, "measured_null")
              .when(minority, "degenerate_low_coverage").otherwise("computed"))
    value = F.when(low, F.lit(None).cast("double")).when(const, F.lit(0.0)).when(minority, F.lit(None).cast("double")) \
        .otherwise(F.col("_r"))
    observed = F.when(low, F.lit(None).cast("double")).when(const, F.lit(0.0)).otherwise(F.col("_r"))
    return one.select(value.alias("value"), status.alias("status"), "n_paired", "n_total",
                      F.when(F.col("n_total") > 0, F.col("n_paired") / F.col("n_total")).otherwise(F.lit(0.0))
                      .alias("coverage_fraction"), observed.alias("observed_value"))


def safe_corr(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson with NULL -> 0; 0.0 for fewer than 3 rows or a constant side."""
    a = F.coalesce(F.col(left).cast("double"), F.lit(0.0))
    b = F.coalesce(F.col(right).cast("double"), F.lit(0.0))
    one = df.agg(F.count(F.lit(1)).alias("_n"), F.min(a).alias("_a0"), F.max(a).alias("_a1"),
                 F.min(b).alias("_b0"), F.max(b).alias("_b1"), _pearson_cols(a, b).alias("_r"))
    bad = (F.col("_n") < 3) | (F.col("_a0") == F.col("_a1")) | (F.col("_b0") == F.col("_b1"))
    return one.select(F.when(bad, F.lit(0.0)).otherwise(F.col("_r")).alias("corr"))


def pearson_spearman(df: DataFrame, left: str, right: str, critical: float = 0.95, suspicious: float = 0.70) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) over complete pairs, with flags."""
    d = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()) \
        .select(F.col(left).cast("double").alias("_a"), F.col(right).cast("double").alias("_b"),
                F.monotonically_increasing_id().alias("_id"))
    r = average_rank(average_rank(d, "_a", "_ra"), "_b", "_rb")
    one = r.agg(_pearson_cols(F.col("_a"), F.col("_b")).alias("pearson"),
                _pearson_cols(F.col("_ra"), F.col("_rb")).alias("spearman"))
    m = F.greatest(F.abs(F.coalesce("pearson", F.lit(0.0))), F.abs(F.coalesce("spearman", F.lit(0.0))))
    return one.select("pearson", "spearman",
                      F.when(m > critical, "critical").when(m > suspicious, "suspicious").otherwise("ok").alias("flag"))


def anova_oneway(df: DataFrame, group: str, value: str, min_group: int = 10) -> DataFrame:
    """One-way ANOVA F over groups with >= min_group rows, with
    η² = SSB/SST and correlation ratio η; p from the F survival function."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss"))
    g = g.where(F.col("_n") >= min_group)
    tot = g.agg(F.sum("_n").alias("N"), F.sum("_s").alias("S"), F.sum("_ss").alias("SS"), F.count(F.lit(1)).alias("k"))
    j = with_scalar(g, tot)
    ssb_term = F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.col("S") / F.col("N"), 2)
    one = j.groupBy("N", "k", "SS", "S").agg(F.sum(ssb_term).alias("ssb"))
    sst = F.col("SS") - F.col("S") * F.col("S") / F.col("N")
    ssw = F.greatest(sst - F.col("ssb"), F.lit(0.0))
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), ssw / (F.col("N") - F.col("k")))
    return one.select(F.col("k").alias("groups"), F.col("N").alias("n"), "ssb", ssw.alias("ssw"),
                      f.alias("f_stat"), F.try_divide(F.col("ssb"), sst).alias("eta_squared"),
                      F.sqrt(F.try_divide(F.col("ssb"), sst)).alias("correlation_ratio"))


def chi2_independence(df: DataFrame, row: str, col: str, min_row: int = 5) -> DataFrame:
    """χ² of independence over rows with >= min_row observations, and Cramér's V.

    Uses χ² = Σ_observed o²/e − N (empty cells contribute e, and Σ e = N), so
    only observed cells are ever materialised.
    """
    cnt = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("_o"))
    rows = cnt.groupBy(row).agg(F.sum("_o").alias("_r")).where(F.col("_r") >= min_row)
    cnt = cnt.join(rows, row)
    cols = cnt.groupBy(col).agg(F.sum("_o").alias("_c"))
    n = rows.agg(F.sum("_r").alias("_N"), F.count(F.lit(1)).alias("_nr"))
    nc = cols.agg(F.count(F.lit(1)).alias("_nc"))
    cells = with_scalar(cnt.join(cols, col), n)
    # in double precision: a product of three counts passes the range of a long from some million rows on
    o, r, c = (F.col(x).cast("double") for x in ("_o", "_r", "_c"))
    chi = cells.agg(F.sum(o * o * F.col("_N") / (r * c)).alias("_q"))
    one = with_scalar(with_scalar(chi, n), nc)
    dof = (F.col("_nr") - 1) * (F.col("_nc") - 1)
    chi2 = F.col("_q") - F.col("_N")
    return one.select(chi2.alias("chi2"), dof.alias("dof"), F.col("_N").alias("n"),
                      F.sqrt(F.try_divide(chi2, F.col("_N") * (F.least("_nr", "_nc") - 1))).alias("cramers_v"))


def ci95(df: DataFrame, value: str) -> DataFrame:
    """Mean ± 1.96·sd (population sd) of a score column."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).select(
        "mean", "std", (F.col("mean") - 1.96 * F.col("std")).alias("ci_low"), (F.col("mean") + 1.96 * F.col("std")).alias("ci_high"))


def empirical_p(null_values: DataFrame, value: str, observed: Column) -> DataFrame:
    """Empirical p = share of null draws >= observed; z = (observed − mean)/sd, population sd as published."""
    return null_values.agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"),
                           F.avg((F.col(value) >= observed).cast("double")).alias("p_value"),
                           F.first(observed).alias("observed")).select(
        "observed", "null_mean", "null_std", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_std")).alias("z"),
        "p_value")


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores with positive/negative counts (the input of every curve)."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative tp/fp at each distinct threshold (score >= t), highest first."""
    st = score_table(df, label, score)
    c = global_order_prefix(st, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # of the placed counts: they are written
    return with_scalar(c, tot).withColumnRenamed("_cum_tp", "tp").withColumnRenamed("_cum_fp", "fp")


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr, precision) at each distinct score."""
    return _curve(df, label, score).select(
        F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def p_value_table(spark, anova: DataFrame, chi2: DataFrame) -> DataFrame:
    """(test, statistic, p_value) of one-row test results."""
    a, c = anova.first(), chi2.first()
    rows = [("anova", a["f_stat"], f_survival(a["f_stat"], a["groups"] - 1, a["n"] - a["groups"]) if a["f_stat"] is not None else None),
            ("chi2", c["chi2"], chi2_survival(c["chi2"], int(c["dof"])) if c["chi2"] is not None else None)]
    return spark.createDataFrame([(t, float(x) if x is not None else None, p) for t, x, p in rows],
                                 "test string, statistic double, p_value double")


def roc_pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC (trapezoids over distinct thresholds = Mann–Whitney with
    ties counted half) and average precision Σ (R_k − R_{k−1})·P_k."""
    c = _curve(df, label, score)
    tp_prev = F.col("tp") - F.col("pos")
    fp_prev = F.col("fp") - F.col("neg")
    auc_term = (F.col("fp") - fp_prev) * (F.col("tp") + tp_prev) / 2.0
    ap_term = (F.col("tp") - tp_prev) / F.col("P") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy("P", "N").agg(F.sum(auc_term).alias("_a"), F.sum(ap_term).alias("average_precision")).select(
        F.col("P").alias("positives"), F.col("N").alias("negatives"),
        F.try_divide(F.col("_a"), F.col("P") * F.col("N")).alias("roc_auc"), "average_precision")


def grouped_auc(df: DataFrame, group_cols: list[str], label: str, score: str) -> DataFrame:
    """(group..., positives, negatives, roc_auc) of many folds and models from one curve.

    Rows become counts per (group, score); running counts per group give the
    pairs that a positive wins (ties count half). Groups of a single class are
    left out."""
    from .common import segmented_prefix
    x = df.groupBy(*group_cols, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) > 0).alias("_p"), F.count_if(F.col(label) <= 0).alias("_n"))
    x = segmented_prefix(x, group_cols, [F.col("_s")], {"n": F.col("_n")})
    won = F.col("_p") * (F.col("_cum_n") - F.col("_n") / 2.0)
    per = x.groupBy(*group_cols).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum(won).alias("_won"))
    return per.where("positives > 0 AND negatives > 0").select(
        *group_cols, "positives", "negatives", (F.col("_won") / (F.col("positives") * F.col("negatives"))).alias("roc_auc"))


def ci95_by(df: DataFrame, group_cols: list[str], value: str) -> DataFrame:
    """T09 per group: number of folds, mean, population sd and mean ± 1.96·sd."""
    per = df.groupBy(*group_cols).agg(F.count(value).alias("folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return per.withColumn("ci_low", F.col("mean") - 1.96 * F.col("std")).withColumn("ci_high", F.col("mean") + 1.96 * F.col("std"))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Confusion matrix, precision, recall and F1 at ``score >= threshold``."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    one = df.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                 F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    prec = F.try_divide(F.col("tp"), (F.col("tp") + F.col("fp")).cast("double"))
    rec = F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double"))
    return one.select("tp", "fp", "fn", "tn", F.coalesce(prec, F.lit(0.0)).alias("precision"),
                      F.coalesce(rec, F.lit(0.0)).alias("recall"),
                      F.coalesce(F.try_divide(2 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")),
                                 F.lit(0.0)).alias("f1"))


def best_f1_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The distinct score maximising F1 of ``score >= t`` (ties: lowest threshold)."""
    c = _curve(df, label, score)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))
    return c.select("score", f1.alias("f1")).agg(
        F.max_by(F.struct(F.col("f1"), (-F.col("score")).alias("_ns")), F.struct(F.col("f1"), (-F.col("score")).alias("_ns")))
        .alias("_b")).select((-F.col("_b._ns")).alias("threshold"), F.col("_b.f1").alias("f1"))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width calibration bins over [0, 1]: mean score and positive rate per bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                                          F.avg((F.col(label) == 1).cast("double")).alias("positive_rate"))


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F >= f) for an F(d1, d2) variable via the regularised incomplete beta (driver scalar)."""
    if f is None or f <= 0 or d1 <= 0 or d2 <= 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    return _betainc(d2 / 2.0, d1 / 2.0, x)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


def _betacf(a: float, b: float, x: float, itmax: int = 300, eps: float = 3e-14) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + aa / c if abs(1 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + aa / c if abs(1 + aa / c) > 1e-300 else 1e-300
        dl = d * c
        h *= dl
        if abs(dl - 1) < eps:
            break
    return h


def chi2_survival(x: float, dof: int) -> float:
    """P(χ² >= x) via the regularised upper incomplete gamma (driver scalar)."""
    if x is None or x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z < a + 1:
        term, s, n = 1.0 / a, 1.0 / a, a
        for _ in range(1000):
            n += 1
            term *= z / n
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def _placements(df: DataFrame, label: str, score: str, out: str) -> DataFrame:
    """DeLong structural components of one score: V10 for positives, V01 for negatives."""
    st_ = score_table(df, label, score)
    c = global_order_prefix(st_, [F.col("score")], {"cn": F.col("neg"), "cp": F.col("pos")})
    c = with_scalar(c, c.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N")))
    v10 = (F.col("_cum_cn") - 0.5 * F.col("neg")) / F.col("_N")   # negatives below + half the ties
    v01 = (F.col("_P") - F.col("_cum_cp") + 0.5 * F.col("pos")) / F.col("_P")
    comp = c.select(F.col("score").alias(f"_s_{out}"), v10.alias(f"v10_{out}"), v01.alias(f"v01_{out}"))
    return df.join(comp, F.col(score).cast("double") == F.col(f"_s_{out}")).drop(f"_s_{out}")


def delong_paired(df: DataFrame, label: str, score_a: str, score_b: str) -> DataFrame:
    """Paired DeLong test of two scores on the same rows (midrank placements,
    sample covariances of the components); z and two-sided normal p."""
    from .graph.iterative import materialize
    # read five times: both score tables, both joins and the sums
    d = materialize(df.where(F.col(score_a).isNotNull() & F.col(score_b).isNotNull()).select(label, score_a, score_b))
    p = _placements(_placements(d, label, score_a, "a"), label, score_b, "b")
    pos = F.col(label) == 1
    one = p.agg(
        F.count_if(pos).alias("m"), F.count_if(~pos).alias("n"),
        F.avg(F.when(pos, F.col("v10_a"))).alias("auc_a"), F.avg(F.when(pos, F.col("v10_b"))).alias("auc_b"),
        F.var_samp(F.when(pos, F.col("v10_a"))).alias("s10_aa"), F.var_samp(F.when(pos, F.col("v10_b"))).alias("s10_bb"),
        F.covar_samp(F.when(pos, F.col("v10_a")), F.when(pos, F.col("v10_b"))).alias("s10_ab"),
        F.var_samp(F.when(~pos, F.col("v01_a"))).alias("s01_aa"), F.var_samp(F.when(~pos, F.col("v01_b"))).alias("s01_bb"),
        F.covar_samp(F.when(~pos, F.col("v01_a")), F.when(~pos, F.col("v01_b"))).alias("s01_ab"))
    var = ((F.col("s10_aa") + F.col("s10_bb") - 2 * F.col("s10_ab")) / F.col("m")
           + (F.col("s01_aa") + F.col("s01_bb") - 2 * F.col("s01_ab")) / F.col("n"))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    diff = F.col("auc_a") - F.col("auc_b")
    return one.select("auc_a", "auc_b", diff.alias("auc_diff"), se.alias("se"),
                      F.try_divide(diff, se).alias("z"), (diff - 1.959963984540054 * se).alias("ci_low"),
                      (diff + 1.959963984540054 * se).alias("ci_high"))


def normal_two_sided_p(z: float) -> float:
    """Two-sided normal tail of a z statistic (driver scalar)."""
    return math.erfc(abs(z) / math.sqrt(2.0)) if z is not None else 1.0
