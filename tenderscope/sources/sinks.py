"""Sinks and small-result sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_if_present


def run_sql_file(spark: SparkSession, sql_path: str, output_path: str | None = None) -> DataFrame:
    """A4: run a SQL file against the registered views; optionally write it as zstd parquet."""
    df = spark.sql(spark.read.text(sql_path, wholetext=True).first()[0])
    if output_path:
        write_parquet(df, output_path)
    return df


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A5: parquet with zstd compression (optionally partitioned for pruning)."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (written in parallel, one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def metrics_frame(spark: SparkSession, payload: dict) -> DataFrame:
    """A10: a metrics document as a one-row frame with a JSON payload column."""
    return spark.createDataFrame([(json.dumps(payload, sort_keys=True, default=str),)], "payload string")


def write_metrics_json(df: DataFrame, path: str) -> None:
    """A10: a small metrics frame as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def merge_metrics(old: DataFrame, new: DataFrame, key: str = "metric", version: str = "version") -> DataFrame:
    """Shallow merge of long (metric, value, version) tables, latest version wins."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return (old.unionByName(new).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn"))


def cached_table(spark: SparkSession, path: str, compute) -> DataFrame:
    """Read-through artefact cache: read ``path`` if present, else compute,
    publish and read back (the written table also cuts lineage). Of several
    writers the first one's table stays, and readers see whole tables only."""
    found = read_if_present(spark, path)
    if found is None:
        publish_once(spark, compute(), path)
        found = spark.read.parquet(path)
    return found


def publish_once(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and switch it into place by one rename, unless ``path`` is there by then."""
    import uuid
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    write_parquet(df, aside)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # a rename onto a folder that came in between would move the table into it: look where it went
    if fs.exists(jvm_path(path)) or not fs.rename(jvm_path(aside), jvm_path(path)):
        fs.delete(jvm_path(aside), True)
    inside = jvm_path(f"{path.rstrip('/')}/{aside.rsplit('/', 1)[1]}")
    if fs.exists(inside):
        fs.delete(inside, True)


def result_manifest(spark: SparkSession, results: dict[str, DataFrame], key_stats: dict[str, str] | None = None) -> DataFrame:
    """(name, rows, key statistic) for a set of intermediate results."""
    rows = []
    for name, df in results.items():
        stat = None
        if key_stats and name in key_stats:
            stat = df.agg(F.avg(key_stats[name])).first()[0]
        rows.append((name, df.count(), float(stat) if stat is not None else None))
    return spark.createDataFrame(rows, "name string, rows long, key_statistic double")
