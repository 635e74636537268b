"""Viewer filters as DataFrame predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_common_filters(df: DataFrame, buyer: str = "ALL", supplier: str = "ALL", cpv: str = "ALL",
                         year_range: tuple[int, int] | None = None) -> DataFrame:
    """Entity filters; 'ALL' is a no-op and a filter on a missing column is skipped."""
    out = df
    for col, val in (("buyer_id", buyer), ("supplier_id", supplier), ("cpv_division", cpv)):
        if val and val != "ALL" and col in df.columns:
            out = out.where(F.col(col) == val)
    if year_range and "award_year" in df.columns:
        out = out.where(F.col("award_year").between(*year_range))
    return out


def apply_risk_filter(df: DataFrame, risk_classes: list[str] | None) -> DataFrame:
    """Keep chosen risk classes; no-op when nothing is chosen or the column is absent."""
    if not risk_classes or "risk_class" not in df.columns:
        return df
    return df.where(F.col("risk_class").isin(*risk_classes))


def cascading_options(df: DataFrame, id_col: str, class_col: str = "risk_class", cls: str = "HIGH") -> DataFrame:
    """Distinct sorted ids having at least one row in a class."""
    return df.where(F.col(class_col) == cls).select(id_col).distinct().orderBy(id_col)
