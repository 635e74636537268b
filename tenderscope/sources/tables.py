"""Parquet scans (A1, A7, A8) of the base tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path`` of any store that Spark reads, or none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one parquet table; selecting columns here prunes the ReadSchema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of the files of one table, on any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def read_projected(spark: SparkSession, path: str, columns: list[str], condition=None) -> DataFrame:
    """Lazy projected + filtered scan (A7): both reach the parquet reader."""
    df = spark.read.parquet(path).select(*columns)
    return df.where(condition) if condition is not None else df


def register_views(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    for n in names:
        found = read_if_present(spark, table_path(sf_dir, n))
        if found is not None:
            found.createOrReplaceTempView(n)
