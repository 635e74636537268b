"""Curated-table view registry (A13): the names the EDA SQL files query,
each bound to the library operator that produces the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import competition as comp
from ..operators import ecosystem as eco
from ..operators import governance as gov
from ..operators import integrate as ig
from ..operators import pricing as pr
from ..operators import quality as qual
from ..operators.graph import build as gb


def curated_tables(spark: SparkSession, contracts: DataFrame, year_min: int = 2006, year_max: int = 2026) -> dict[str, DataFrame]:
    """Lazy DataFrames for every curated name (nothing is computed until queried)."""
    nf = gov.network_features(contracts)
    edges = gb.bipartite_edges(contracts)
    return {
        "contracts_base": contracts,
        "contracts_clean": gov.contracts_clean(contracts, year_min, year_max),
        "data_quality": qual.data_quality(contracts, year_min, year_max),
        "schema_audit": qual.schema_audit(spark, contracts),
        "buyer_master": eco.buyer_ecosystem(contracts),
        "supplier_master": eco.supplier_ecosystem(contracts),
        "cpv_coverage": comp.cpv_coverage(contracts),
        "rq1_features": nf,
        "rq2_features": gov.governance_features(contracts),
        "rq3_features": pr.price_proxy(contracts),
        "rq1_buyer_metrics": ig.buyer_metrics(nf),
        "rq1_node_metrics": gb.node_metrics(edges),
        "rq1_network_metrics": gb.sql_centrality(edges),
        "rq1_communities": gb.region_partition(contracts).join(gb.node_metrics(edges).select("node_id", "entity_id", "node_type"),
                                                                "node_id"),
    }


def register_curated_views(spark: SparkSession, contracts: DataFrame, year_min: int = 2006, year_max: int = 2026) -> list[str]:
    """Register every curated table as a temp view; returns the names."""
    tables = curated_tables(spark, contracts, year_min, year_max)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)
