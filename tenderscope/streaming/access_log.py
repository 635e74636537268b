"""The append-only access log read as a stream: new files under a folder are
parsed with the batch parser and counted per (role, action, outcome).

The reference reads the whole log at every request; as a stream the counts
are maintained incrementally with exactly-once state in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.access_log import parse_access_log


def access_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parse_access_log(spark.readStream.format("text").load(folder))


def event_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("role", "action", "outcome").agg(F.count(F.lit(1)).alias("events"))


def start_counts(spark: SparkSession, folder: str, checkpoint: str, sink: str = "memory", name: str = "access_counts"):
    """Start the counting query (complete mode); the caller stops it."""
    q = (event_counts(access_log_stream(spark, folder)).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint))
    if sink == "memory":
        q = q.format("memory").queryName(name)
    else:
        q = q.format(sink)
    return q.start()
