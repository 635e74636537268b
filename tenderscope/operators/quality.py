"""Data-quality and data-governance queries.

Q00 schema audit, Q01 data quality (one pass + unpivot instead of six scans),
E09 cardinality, E10 quality score, E11 null analysis, E12 schema profile,
N01/G01 null profile, G03 year × field presence, I06 exact-row dedup, I07 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: SQL type names used in schema listings
SQL_TYPE_NAMES = {
    "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "int": "INTEGER", "bigint": "BIGINT",
    "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def schema_audit(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Q00: (column_name, column_type) of a DataFrame's schema (metadata only)."""
    rows = [(f.name, SQL_TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()))
            for f in df.schema.fields]
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("column_type", T.StringType())])
    return spark.createDataFrame(rows, schema)


def schema_profile(audit: DataFrame) -> DataFrame:
    """Number of columns per type."""
    return audit.groupBy("column_type").agg(F.count(F.lit(1)).alias("column_count"))


def unpivot_one_row(row: DataFrame, name_col: str, value_col: str, value_type: str) -> DataFrame:
    cols = row.columns
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name_col), F.col(c).cast(value_type).alias(value_col)) for c in cols])).alias("_s")
    ).select(f"_s.{name_col}", f"_s.{value_col}")


def data_quality(contracts: DataFrame, year_min: int = 2006, year_max: int = 2026) -> DataFrame:
    """Q01: six quality counts in long form (metric, value) from ONE scan."""
    one = contracts.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("buyer_id").isNull()).alias("missing_buyer_id"),
        F.count_if(F.col("supplier_id").isNull()).alias("missing_supplier_id"),
        (F.count(F.lit(1)) - F.countDistinct("contract_id")).alias("duplicate_contract_ids"),
        F.count_if(F.col("final_price") <= 0).alias("non_positive_prices"),
        F.count_if((F.col("award_year") < year_min) | (F.col("award_year") > year_max)).alias("invalid_award_year"),
    )
    return unpivot_one_row(one, "metric", "value", "double")


def quality_score(dq: DataFrame) -> DataFrame:
    """1 - count/total for missing_* and invalid_* metrics, plus their mean as 'overall'."""
    total = dq.where(F.col("metric") == "total_rows").select(F.col("value").alias("_t"))
    rates = (dq.crossJoin(F.broadcast(total))   # one-row total
             .select(F.col("metric").alias("quality_dimension"),
                     F.when(F.col("metric").like("missing_%") | F.col("metric").like("invalid_%"),
                            1 - F.col("value") / F.nullif(F.col("_t"), F.lit(0.0))).alias("quality_rate"))
             .where(F.col("quality_rate").isNotNull()))
    overall = rates.agg(F.lit("overall").alias("quality_dimension"), F.avg("quality_rate").alias("quality_rate"))
    return rates.unionByName(overall)


def null_analysis(dq: DataFrame) -> DataFrame:
    """Completeness per field from the missing_* metrics."""
    total = dq.where(F.col("metric") == "total_rows").select(F.col("value").alias("_t"))
    return (dq.where(F.col("metric").like("missing_%")).crossJoin(F.broadcast(total))
            .select(F.replace(F.col("metric"), F.lit("missing_"), F.lit("")).alias("field"),
                    F.col("value").alias("missing_rows"),
                    (1 - F.col("value") / F.nullif(F.col("_t"), F.lit(0.0))).alias("completeness_rate")))


def cardinality(clean: DataFrame) -> DataFrame:
    """Distinct counts of five dimensions, one pass, long form."""
    one = clean.agg(F.countDistinct("buyer_id").alias("buyers"), F.countDistinct("supplier_id").alias("suppliers"),
                    F.countDistinct("cpv_division").alias("cpv_divisions"),
                    F.countDistinct("procedure_type").alias("procedures"),
                    F.countDistinct("award_year").alias("award_years"))
    return unpivot_one_row(one, "entity", "distinct_count", "long")


def null_profile(df: DataFrame, top: int = 15, only_with_nulls: bool = True) -> DataFrame:
    """Null count and % per column, largest first, top n."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in cols])).alias("_s"))
    out = long.select("_s.column_name", "_s.nulls", (100.0 * F.col("_s.nulls") / F.col("__n")).alias("pct"))
    if only_with_nulls:
        out = out.where(F.col("nulls") > 0)
    return out.orderBy(F.col("nulls").desc(), "column_name").limit(top)


def presence_by_year(df: DataFrame, fields: list[str], year_col: str = "award_year") -> DataFrame:
    """Share of rows with a non-null value per (year, field)."""
    g = df.groupBy(year_col).agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in fields])
    return g.select(year_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), (F.col(c) / F.col("__n")).alias("presence")) for c in fields])).alias("_s")) \
        .select(year_col, "_s.field", "_s.presence")


def dedupe_exact(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact full-row dedup and a one-row disclosure (rows_before, rows_after, rows_removed)."""
    deduped = df.distinct()
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    after = deduped.agg(F.count(F.lit(1)).alias("rows_after"))
    report = before.crossJoin(after).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    return deduped, report


def safe_id(col, placeholder: str = "unknown"):
    """Display-safe id: NULL, blank or 'none' (any case) -> placeholder, else trimmed."""
    t = F.trim(F.col(col).cast("string")) if isinstance(col, str) else F.trim(col.cast("string"))
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "none"), F.lit(placeholder)).otherwise(t)
