"""What-if removal of nodes (R17, R18) as joins on an edge table and a
*scenario* table ``(scenario_id, node_id)``: many removal sets in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import incidence
from .iterative import connected_components, materialize


def check_removal_set(edges: DataFrame, scenarios: DataFrame) -> None:
    """Every node of every scenario must exist in the graph; empty sets are errors."""
    nodes = incidence(edges).select("node_id").distinct()
    unknown = scenarios.join(nodes, "node_id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown nodes in removal set: {[r['node_id'] for r in unknown]}")
    if scenarios.limit(1).count() == 0:
        raise ValueError("empty removal set")


def removal_impact(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Per scenario exposed value, orphaned counterparties, stranded buyers,
    sole-source buyers before/after."""
    sc = scenarios.select("scenario_id", "node_id").distinct()
    ids = sc.select("scenario_id").distinct()
    e = edges.select("src", "dst", "weight")
    # edges touching the removal set, once per scenario
    touched = (e.join(sc.withColumnRenamed("node_id", "src"), "src").select("scenario_id", "src", "dst", "weight")
               .unionByName(e.join(sc.withColumnRenamed("node_id", "dst"), "dst").select("scenario_id", "src", "dst", "weight"))
               .distinct())
    exposed = touched.groupBy("scenario_id").agg(F.sum("weight").alias("exposed_contract_value"))
    inc = incidence(edges)
    # neighbours of removed nodes that are not removed themselves
    nb = (inc.join(sc, "node_id").select("scenario_id", F.col("other").alias("node_id")).distinct()
          .join(sc, ["scenario_id", "node_id"], "left_anti"))
    # a neighbour is orphaned when none of its counterparts survive the removal
    surviving = (nb.join(inc, "node_id").join(sc.withColumnRenamed("node_id", "other"), ["scenario_id", "other"], "left_anti")
                 .select("scenario_id", "node_id").distinct())
    orphaned = nb.join(surviving, ["scenario_id", "node_id"], "left_anti")
    orph = orphaned.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("orphaned_counterparties"),
        F.count_if(F.col("node_id").startswith("B_")).alias("stranded_buyers"))
    deg = inc.groupBy("node_id").agg(F.count(F.lit(1)).alias("_deg"))
    sole_before = deg.where(F.col("node_id").startswith("B_") & (F.col("_deg") == 1)).agg(
        F.count(F.lit(1)).alias("sole_source_before"))
    # after removal: remaining degree of buyers that are not removed
    lost = (inc.where(F.col("node_id").startswith("B_"))
            .join(sc.withColumnRenamed("node_id", "other"), "other")
            .groupBy("scenario_id", "node_id").agg(F.count(F.lit(1)).alias("_lost")))
    buyers = deg.where(F.col("node_id").startswith("B_"))
    changed = (lost.join(buyers, "node_id").join(sc, ["scenario_id", "node_id"], "left_anti")
               .withColumn("_after", F.col("_deg") - F.col("_lost")))
    # sole-source after = before − (sole buyers removed or changed) + (changed buyers now at degree 1)
    removed_sole = (sc.join(buyers.where(F.col("_deg") == 1), "node_id").groupBy("scenario_id")
                    .agg(F.count(F.lit(1)).alias("_rs")))
    delta = changed.groupBy("scenario_id").agg(
        (F.count_if(F.col("_after") == 1) - F.count_if(F.col("_deg") == 1)).alias("_delta"))
    return (ids.join(exposed, "scenario_id", "left").join(orph, "scenario_id", "left")
            .join(removed_sole, "scenario_id", "left").join(delta, "scenario_id", "left")
            .crossJoin(F.broadcast(sole_before))
            .select("scenario_id",
                    F.coalesce("exposed_contract_value", F.lit(0.0)).alias("exposed_contract_value"),
                    F.coalesce("orphaned_counterparties", F.lit(0)).alias("orphaned_counterparties"),
                    F.coalesce("stranded_buyers", F.lit(0)).alias("stranded_buyers"),
                    "sole_source_before",
                    (F.col("sole_source_before") - F.coalesce("_rs", F.lit(0)) + F.coalesce("_delta", F.lit(0)))
                    .alias("sole_source_after")))


def affected_buyers(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, node_id): buyers that lose a supplier and are not removed themselves."""
    sc = scenarios.select("scenario_id", "node_id").distinct()
    lost = edges.join(sc.withColumnRenamed("node_id", "dst"), "dst").select("scenario_id", F.col("src").alias("node_id")).distinct()
    return lost.join(sc, ["scenario_id", "node_id"], "left_anti")


def dependency_shift(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, buyer, dependency_before, dependency_after) of affected buyers: the share of the largest
    supplier in the buyer's value with all suppliers and with the remaining ones (0 when none remains)."""
    sc = scenarios.select("scenario_id", F.col("node_id").alias("dst"), F.lit(True).alias("_gone")).distinct()
    rows = (affected_buyers(edges, scenarios).withColumnRenamed("node_id", "src").join(edges.select("src", "dst", "weight"), "src")
            .join(sc, ["scenario_id", "dst"], "left").withColumn("_left", F.when(F.col("_gone").isNull(), F.col("weight"))))
    per = rows.groupBy("scenario_id", "src").agg(*[f(c).alias(f"_{n}_{c}") for c in ("weight", "_left") for n, f in (("max", F.max), ("sum", F.sum))])
    share = lambda c: F.when(F.col(f"_sum_{c}") > 0, F.col(f"_max_{c}") / F.col(f"_sum_{c}")).otherwise(0.0)
    return per.select("scenario_id", F.col("src").alias("buyer"), share("weight").alias("dependency_before"),
                      share("_left").alias("dependency_after"))


def substitutability(edges: DataFrame, scenarios: DataFrame, buyer_category: DataFrame) -> DataFrame:
    """(scenario_id, buyer, substitutes): suppliers that serve buyers of an affected buyer's category and are
    not removed; 0 for buyers without category. ``buyer_category`` is (node_id, category).

    Counted as all suppliers of the category less the removed ones in it: neither set is made."""
    sc = scenarios.select("scenario_id", F.col("node_id").alias("dst")).distinct()
    kinds = buyer_category.where(F.col("category").isNotNull()).select(F.col("node_id").alias("src"), "category")
    active = edges.select("src", "dst").join(kinds, "src").select("category", "dst").distinct()
    everyone = active.groupBy("category").agg(F.count(F.lit(1)).alias("_all"))
    gone = active.join(sc, "dst").groupBy("scenario_id", "category").agg(F.count(F.lit(1)).alias("_gone"))
    return (affected_buyers(edges, scenarios).withColumnRenamed("node_id", "src").join(kinds, "src", "left")
            .join(everyone, "category", "left").join(gone, ["scenario_id", "category"], "left")
            .select("scenario_id", F.col("src").alias("buyer"),
                    (F.coalesce("_all", F.lit(0)) - F.coalesce("_gone", F.lit(0))).cast("long").alias("substitutes")))


def community_value_removed(edges: DataFrame, scenarios: DataFrame, partition: DataFrame) -> DataFrame:
    """(scenario_id, community_id, internal_value_removed_share) of the communities of removed nodes: the part of a
    community's internal value (both ends inside) that lies on edges of removed nodes; 0 without internal value."""
    sc = scenarios.select("scenario_id", "node_id").distinct()
    p = partition.select("node_id", "community_id")
    inner = (edges.select("src", "dst", "weight").join(p.withColumnRenamed("node_id", "src"), "src")
             .join(p.select(F.col("node_id").alias("dst"), F.col("community_id").alias("_cd")), "dst").where(F.col("community_id") == F.col("_cd")))
    total = inner.groupBy("community_id").agg(F.sum("weight").alias("_all"))
    hit = (inner.join(sc.withColumnRenamed("node_id", "src"), "src").select("scenario_id", "community_id", "src", "dst", "weight")
           .unionByName(inner.join(sc.withColumnRenamed("node_id", "dst"), "dst").select("scenario_id", "community_id", "src", "dst", "weight")).distinct())
    removed = hit.groupBy("scenario_id", "community_id").agg(F.sum("weight").alias("_gone"))
    touched = sc.join(p, "node_id").select("scenario_id", "community_id").distinct()
    share = F.when(F.col("_all") != 0, F.coalesce("_gone", F.lit(0.0)) / F.col("_all")).otherwise(0.0)
    return touched.join(total, "community_id", "left").join(removed, ["scenario_id", "community_id"], "left") \
        .select("scenario_id", "community_id", share.alias("internal_value_removed_share"))


def removed_cut_vertices(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, node_id, is_articulation_point) of every removed node in the unchanged graph."""
    from .blocks import biconnected
    flags = biconnected(edges)["nodes"].select("node_id", "is_articulation_point")
    return scenarios.select("scenario_id", "node_id").distinct().join(flags, "node_id").select("scenario_id", "node_id", "is_articulation_point")


def removal_component_shares(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Largest-component share of all nodes before and after each removal.

    The graph without any of the named nodes is labelled once. A scenario gives the
    named nodes that it keeps back: its graph has one vertex for each component that
    they touch and one for each of them, and only the edges at named nodes are
    copied per scenario (a what-if list is short). No removal at all is one more
    scenario. Nodes left without edges are components of one node.
    """
    sc = scenarios.select("scenario_id", "node_id").distinct()
    ids = sc.select("scenario_id").distinct()
    e = materialize(edges.select("src", "dst"))
    named = sc.select("node_id").distinct()
    nodes = materialize(e.select(F.col("src").alias("node_id")).unionByName(e.select(F.col("dst").alias("node_id"))).distinct())
    rest = e.join(named.withColumnRenamed("node_id", "src"), "src", "left_anti").join(named.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    parts = connected_components(rest)
    # vertices of the small graphs: components and nodes without edges among the rest, and named nodes
    vertex = nodes.join(parts, "node_id", "left").join(named.withColumn("_named", F.lit(True)), "node_id", "left") \
                  .select("node_id", F.coalesce("component_id", "node_id").alias("v"), F.coalesce("_named", F.lit(False)).alias("named"))
    vertex = materialize(vertex)
    sizes = vertex.groupBy("v").agg(F.count(F.lit(1)).alias("_s"))
    ends = [vertex.select(F.col("node_id").alias(c), F.col("v").alias(f"v_{c}"), F.col("named").alias(f"n_{c}")) for c in ("src", "dst")]
    at = e.join(ends[0], "src").join(ends[1], "dst").where("n_src OR n_dst").select("v_src", "v_dst").distinct()
    # k: a scenario, or null for no removal; a join key without nulls
    none = F.lit(None).cast(sc.schema["scenario_id"].dataType).alias("scenario_id")
    key = lambda after: F.to_json(F.struct(F.lit(after).alias("after"), "scenario_id")).alias("k")
    gone = sc.where(F.col("scenario_id").isNotNull()).select(key(1), "node_id")  # a list without a name removes nothing
    keys = ids.select(key(1)).unionByName(edges.sparkSession.range(1).select(none).select(key(0)))
    copies = at.crossJoin(F.broadcast(keys))
    for c in ("v_src", "v_dst"):
        copies = copies.join(gone.withColumnRenamed("node_id", c), ["k", c], "left_anti")
    joined = connected_components(copies.select("k", F.col("v_src").alias("src"), F.col("v_dst").alias("dst")), ("k",)).withColumnRenamed("node_id", "v")
    joined = joined.join(sizes, "v").select("k", "v", "component_id", "_s")
    merged = joined.groupBy("k", "component_id").agg(F.sum("_s").alias("_s")).groupBy("k").agg(F.max("_s").alias("_merged"))
    # components that no kept named node touches, by scenario: those in no row of ``joined``; ones of named nodes count only there
    touched = joined.select("v").distinct()
    alone = sizes.join(touched, "v", "left_anti").join(named.withColumnRenamed("node_id", "v"), "v", "left_anti").agg(F.max("_s").alias("_far"))
    near = touched.join(sizes, "v").join(named.withColumnRenamed("node_id", "v"), "v", "left_anti").select("v", "_s").crossJoin(F.broadcast(keys)) \
                  .join(joined.select("k", "v"), ["k", "v"], "left_anti").groupBy("k").agg(F.max("_s").alias("_near"))
    giant = keys.join(merged, "k", "left").join(near, "k", "left").crossJoin(F.broadcast(alone)) \
                .select("k", F.greatest("_merged", "_near", "_far").alias("_giant"))
    giant = materialize(giant)
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    before = giant.where(F.col("k") == F.to_json(F.struct(F.lit(0).alias("after")))).select(F.col("_giant").alias("_before"))
    # removed nodes of the graph, as many as the what-if list names
    lost = sc.join(nodes, "node_id").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_gone"))
    out = ids.withColumn("k", key(1)).join(giant, "k", "left").join(lost, "scenario_id", "left")
    out = out.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(before))
    rest_n = F.col("_n") - F.coalesce("_gone", F.lit(0))
    return out.select("scenario_id", (F.col("_before") / F.col("_n")).alias("largest_component_share_before"),
                      F.when(rest_n > 0, F.greatest(F.coalesce("_giant", F.lit(1)), F.lit(1)) / rest_n).otherwise(0.0).alias("largest_component_share_after"))
