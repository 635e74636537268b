"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph.iterative import materialize
from ..session import ensure_checkpoint_dir

#: the word of the corpus contracts: a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
#: the ASCII white space that separates words
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["WORD", "SPACE", "table", "scratch", "written", "discard", "settle", "let", "batches_of", "shuffle_width", "exclusive_offsets"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for files of one run."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back."""
    return materialize(df)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote below ``spark.checkpoint.dir`` and reads no more."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/"
    if not path.startswith(root):
        raise ValueError(f"{path} is not below {root}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    settle(spark)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs: it waits for the driver to
    collect their plans, which a driver with little to do would put off for half an hour."""
    import gc
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    A lambda over a one-element array binds the value, so the optimizer can't
    inline it into places that are evaluated once per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def batches_of(spark: SparkSession, rows: int, size: int = 32 << 20) -> None:
    """Hand Python at most ``rows`` rows and some ``size`` bytes at a time: texts can be long.

    Spark reads both limits when a lazy result is computed, long after this call,
    so they are lowered for the session and never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower())
        held = int(now[1]) << 10 * " kmgt".index(now[2] or " ") if now else 0
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def exclusive_offsets(totals: DataFrame, order: str, **sums: str) -> DataFrame:
    """``order`` and, for each ``name=column``, the sum of the column over all
    earlier rows. ``totals`` has one row per partition (a few numbers for each
    task, however many rows the task holds), so one task can scan it."""
    from pyspark.sql import Window
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(order, *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(n)
                                  for n, c in sums.items()])
