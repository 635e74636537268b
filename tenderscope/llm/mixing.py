"""Mixing sources to target weights along a time-varying curriculum.

Targets. Sources take turns with the weights; they share ``share`` times all
words by weight, no source more than ``epochs`` times its own words, and what
is over is shared again by weight (water filling: one level L with target =
min(epochs * words, L * weight)).

Order. Inside a source the documents stand in a fixed pseudo-random order (a
hash of the id). A document's words occupy an interval of the source's word
axis, once per epoch; what lies below the target is taken.

Curriculum. Each source has a rate u(t) over training time t in [0, 1], linear
from ``start`` to ``end`` with mean 1. Its cumulative demand is target * U(t)
with U the integral of u; a copy that begins at word q is due when the demand
reaches q, so its position is the inverse of U at q / target. Sorting all
copies by position gives the mixture.

Prefix sums run over (source, hash bucket) cells, so a source with a third of
all rows is spread over all buckets.

Defined results: a null text has size 0 and nothing to take; the null source is
a source, last in order; null ids are hashed as one value; equal rows are
interchangeable; an empty table gives no rows; all input columns are kept (the
result columns replace columns of their name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_width

#: rates at the start and the end of training, taken in turn like the weights
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sizes: DataFrame, source_col: str, size_col: str, weights=(5, 2, 1), share: float = 1.5,
                   epochs: int = 2, schedule=SCHEDULE) -> DataFrame:
    """One row per source: its words, weight, target and rates."""
    per = sizes.groupBy(source_col).agg(F.coalesce(F.sum(size_col), F.lit(0)).cast("long").alias("source_size"))
    # windows over one row per source
    turn = (F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1) % len(weights)
    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_turn") + 1)
    per = (per.withColumn("_turn", turn).withColumn("_w", pick([int(w) for w in weights]))
           .withColumn("_u0", pick([float(a) for a, _ in schedule])).withColumn("_u1", pick([float(b) for _, b in schedule])))
    limit = F.col("source_size") * epochs
    by_ratio = Window.orderBy((limit / F.col("_w")).asc(), F.col(source_col).asc_nulls_last())
    used = F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    # with the first i sources at their limit the level is (total - used) / weight left; it peaks at the true level
    per = per.withColumn("_level", (F.lit(share) * F.sum("source_size").over(everything) - used) / weight_left)
    per = per.withColumn("_level", F.max("_level").over(everything))
    return per.withColumn("target", F.least(limit.cast("double"), F.col("_level") * F.col("_w"))) \
              .drop("_turn", "_level")


def _hash(id_col: str) -> Column:
    """60 bits of the MD5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def due(q: Column, target: Column, u0: Column, u1: Column) -> Column:
    """Training time at which a source's demand reaches word ``q``."""
    y = q / target
    slope = u1 - u0
    return F.when(slope == 0, y).otherwise((F.sqrt(u0 * u0 + 2 * slope * y) - u0) / slope)


def mixture_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, schedule=SCHEDULE,
                 whole_documents: bool = False) -> DataFrame:
    """``df`` with size, source_size, target, taken, copies (array of taken words
    per copy) and positions (training time of each copy).

    The document that crosses a source's target is taken in part; with
    ``whole_documents`` it is taken whole or not at all, whichever is nearer."""
    spark = df.sparkSession
    bits = max(4, (shuffle_width(spark) - 1).bit_length())
    rows = df.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")) \
             .withColumn("_h", _hash(id_col)).withColumn("_cell", F.shiftright(F.col("_h"), 60 - bits))
    slim = rows.select(F.col(source_col).alias("_s"), "_cell", "size")
    cells = slim.groupBy("_s", "_cell").agg(F.sum("size").alias("size"))
    targets = source_targets(cells, "_s", "size", weights, share, epochs, schedule)
    before = Window.partitionBy("_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_s", "_cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"))
    frame = (cells.alias("c").join(targets.alias("t"), F.col("c._s").eqNullSafe(F.col("t._s")))
             .select(F.col("c._s").alias("_s"), F.col("_cell").alias("_c"), "_before", "source_size", "target", "_u0", "_u1"))
    inside = Window.partitionBy(source_col, "_cell").orderBy("_h", F.col(id_col).asc_nulls_first(), "size") \
                   .rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.drop("source_size", "target").withColumn("_run", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(frame, F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    start = F.col("_before") + F.col("_run")
    limit = F.floor("target")
    def words(e: int) -> Column:
        left = limit - (start + e * F.col("source_size"))
        if whole_documents:
            return F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
        return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    copies = F.filter(F.array(*[F.struct(words(e).alias("words"), (start + e * F.col("source_size")).alias("q"))
                                for e in range(epochs)]), lambda x: x["words"] > 0)
    return (rows.withColumn("_copies", copies)
            .withColumn("copies", F.transform("_copies", lambda x: x["words"]))
            .withColumn("positions", F.transform("_copies", lambda x: due(x["q"], F.col("target"), F.col("_u0"), F.col("_u1"))))
            .withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x))
            .drop("_h", "_cell", "_s", "_c", "_before", "_run", "_u0", "_u1", "_copies"))


def curriculum(plan: DataFrame, id_col: str = "doc_id", rest: bool = False) -> DataFrame:
    """One row per taken copy, range-sorted by ``position``: the copy's number from 0 in ``copy``, its words in
    ``taken``. With ``rest`` documents that are not taken follow at the end, with null copy and position."""
    take = F.posexplode_outer if rest else F.posexplode
    copies = (plan.select("*", take(F.arrays_zip("copies", "positions")).alias("copy", "_x")).drop("taken")
              .withColumn("taken", F.coalesce(F.col("_x.copies"), F.lit(0)).cast("long"))
              .withColumn("position", F.col("_x.positions")).drop("_x"))
    if rest:
        return copies.repartitionByRange(shuffle_width(plan.sparkSession), F.col("position").asc_nulls_last(), id_col) \
                     .sortWithinPartitions(F.col("position").asc_nulls_last(), id_col)
    copies = copies.drop("copies", "positions")
    return copies.repartitionByRange(shuffle_width(plan.sparkSession), "position", id_col) \
                 .sortWithinPartitions("position", id_col)
