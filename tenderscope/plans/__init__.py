"""Query registry: every registered query has a Spark build and (where SQL can
express it) a DuckDB oracle over the same base tables."""

from .registry import REGISTRY, load_all, oracle_sql_for, spark_query_for  # noqa: F401
