"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put into one global order (id, then text checksum and size). Every
range partition reports its row count and byte total; the exclusive sums of
those totals plus a running sum inside the partition give each row the number
of bytes before it. Cutting that axis at equal targets gives contiguous shards
whose sizes differ by at most the largest row. Only ids, sizes and checksums
are shuffled, never texts.

Defined results: a null text has no bytes (size 1, checksum of the empty
string); null ids come first in the order; repeated rows are all kept, in any
order among themselves since they are equal; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exclusive_offsets, shuffle_width, written


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot): one row per input row.

    ``shard`` is 0 to ``shards - 1``, ``slot`` counts the rows of a shard from 0
    in the global order."""
    spark = df.sparkSession
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).alias(id_col), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
                     F.crc32(body).alias("text_crc32"))
    # equal rows are interchangeable; the row number only lets a huge run of them spread over partitions
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_tie")]
    # range bounds are sampled per execution: the partition of a row is written down once
    ranged = written(rows.repartitionByRange(shuffle_width(spark), *order)
                     .withColumn("_part", F.spark_partition_id()))

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    offsets = exclusive_offsets(totals, "_part", _bytes_before="_bytes", _rows_before="_rows")
    everything = totals.agg(F.sum("_bytes").alias("_total"))
    here = Window.partitionBy("_part").orderBy(*order)
    # offsets: one row per partition; everything: one row
    placed = (ranged.join(F.broadcast(offsets), "_part").crossJoin(F.broadcast(everything))
              .withColumn("_start", F.col("_bytes_before") - F.col("size")
                          + F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_row", F.col("_rows_before") + F.row_number().over(here) - 1)
              .withColumn("shard", F.expr(f"least({shards - 1}L, (_start * {shards}L) div _total)").cast("int"))
              .select(id_col, "size", "text_crc32", "shard", "_row"))
    placed = written(placed)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most ``shards`` rows
    return (placed.join(F.broadcast(first), "shard")
            .select(id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")))


def shard_bounds(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """First and last id, rows and bytes of each shard: what a reader of one shard needs."""
    return assigned.groupBy("shard").agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"),
                                         F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
