"""Registered graph queries over the buyer–supplier graph of the canonical
contract view (all contracts, all years)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import build as gb
from ..operators.graph import iterative as gi
from ..operators.graph import metrics as gm
from ..operators.graph import removal as grm
from ..operators import sampling as smp
from .catalogue import C
from .registry import register

EDGES_SQL = """edges AS (
    SELECT 'B_' || buyer_id AS src, 'S_' || supplier_id AS dst, SUM(contract_value) AS weight, COUNT(*) AS contracts
    FROM contracts_base WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL GROUP BY buyer_id, supplier_id),
inc AS (SELECT src AS node_id, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""

REGION_SQL = """region_part AS (
    SELECT 'B_' || buyer_id AS node_id, MIN(buyer_region) AS community_id FROM contracts_base
    WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL GROUP BY buyer_id
    UNION ALL
    SELECT 'S_' || supplier_id, MIN(buyer_region) FROM contracts_base
    WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL GROUP BY supplier_id)"""

CC_SQL = """cc(node, comp) USING KEY (node) AS (
    SELECT node_id, LEAST(node_id, MIN(other)) FROM inc GROUP BY node_id
    UNION
    SELECT i.node_id, MIN(c.comp) FROM cc c JOIN inc i ON i.other = c.node
    GROUP BY i.node_id
    HAVING MIN(c.comp) < (SELECT r.comp FROM recurring.cc r WHERE r.node = i.node_id))"""


def edges(spark, sf_dir):
    return gb.bipartite_edges(C(spark, sf_dir))


@register("r01_bipartite_edges", r4=("weight",), sql="WITH " + EDGES_SQL + "\nSELECT * FROM edges")
def r01_bipartite_edges(spark, sf_dir):
    """buyer–supplier edges with Σ value and contract count."""
    return edges(spark, sf_dir)


@register("r02_node_metrics", r4=("weighted_degree",), r6=("degree_centrality",), sql="WITH " + EDGES_SQL + """,
deg AS (SELECT node_id, COUNT(*) AS degree, SUM(weight) AS weighted_degree FROM inc GROUP BY node_id)
SELECT node_id, substring(node_id, 3) AS entity_id,
       CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 'buyer' ELSE 'supplier' END AS node_type, degree, weighted_degree,
       degree / NULLIF((SELECT COUNT(*) FROM deg) - 1, 0) AS degree_centrality
FROM deg""")
def r02_node_metrics(spark, sf_dir):
    """Degree, weighted degree and degree centrality per node."""
    return gb.node_metrics(edges(spark, sf_dir))


SQLCENT_SQL = EDGES_SQL + """,
deg AS (SELECT node_id, COUNT(*) AS degree, SUM(weight) AS weighted_degree FROM inc GROUP BY node_id),
mx AS (SELECT GREATEST(MAX(degree)::DOUBLE, 1.0) AS md, GREATEST(MAX(weighted_degree), 1.0) AS mw FROM deg),
cent AS (
SELECT node_id, substring(node_id, 3) AS entity_id,
       CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 'buyer' ELSE 'supplier' END AS node_type, degree, weighted_degree,
       degree / md AS degree_centrality, 0.6 * degree / md + 0.4 * weighted_degree / mw AS centrality
FROM deg, mx)"""


@register("r03_sql_centrality", r4=("weighted_degree",), r6=("degree_centrality", "centrality"),
          sql="WITH " + SQLCENT_SQL + "\nSELECT * FROM cent")
def r03_sql_centrality(spark, sf_dir):
    """degree/weight fallback centrality."""
    return gb.sql_centrality(edges(spark, sf_dir))


@register("e21_centrality_summary", sql="WITH " + SQLCENT_SQL + """
SELECT node_type, ROUND(centrality, 3) AS centrality_band, COUNT(*) AS nodes FROM cent GROUP BY 1, 2""")
def e21_centrality_summary(spark, sf_dir):
    """Nodes per (type, centrality band)."""
    return gb.centrality_summary(gb.sql_centrality(edges(spark, sf_dir)))


@register("e23_degree_distribution", sql="WITH " + EDGES_SQL + """
SELECT CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 'buyer' ELSE 'supplier' END AS node_type, degree,
       COUNT(*) AS node_count
FROM (SELECT node_id, COUNT(*) AS degree FROM inc GROUP BY node_id) GROUP BY 1, 2""")
def e23_degree_distribution(spark, sf_dir):
    """Nodes per (type, degree)."""
    return gb.degree_distribution(gb.node_metrics(edges(spark, sf_dir)))


@register("e24_graph_density", r6=("graph_density",), sql="""
WITH f AS (SELECT buyer_id, supplier_id FROM contracts_base
           WHERE buyer_id IS NOT NULL AND supplier_id IS NOT NULL AND contract_value > 0)
SELECT COUNT(DISTINCT buyer_id) AS buyers, COUNT(DISTINCT supplier_id) AS suppliers,
       (SELECT COUNT(*) FROM (SELECT DISTINCT buyer_id, supplier_id FROM f)) AS edges,
       (SELECT COUNT(*) FROM (SELECT DISTINCT buyer_id, supplier_id FROM f))
         / NULLIF(CAST(COUNT(DISTINCT buyer_id) * COUNT(DISTINCT supplier_id) AS DOUBLE), 0) AS graph_density
FROM f""")
def e24_graph_density(spark, sf_dir):
    """Bipartite density of the network feature table."""
    from ..operators.governance import network_features
    return gb.graph_density(network_features(C(spark, sf_dir)))


@register("r08_region_partition", sql="WITH " + REGION_SQL + "\nSELECT * FROM region_part")
def r08_region_partition(spark, sf_dir):
    """Region-as-community partition."""
    return gb.region_partition(C(spark, sf_dir))


@register("e22_community_statistics", sql="WITH " + REGION_SQL + """
SELECT community_id, COUNT(*) AS nodes,
       CAST(SUM(CASE WHEN node_id LIKE 'B\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS BIGINT) AS buyers,
       CAST(SUM(CASE WHEN node_id LIKE 'S\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS BIGINT) AS suppliers
FROM region_part GROUP BY community_id ORDER BY nodes DESC, community_id LIMIT 30""")
def e22_community_statistics(spark, sf_dir):
    """Nodes, buyers and suppliers per community (region partition)."""
    return gb.community_statistics(gb.region_partition(C(spark, sf_dir)))


MOD_SQL = """
SELECT SUM(COALESCE(l, 0) / m - POWER(d / (2 * m), 2)) AS modularity, COUNT(*) AS communities
FROM (SELECT p.community_id, SUM(i.weight) AS d FROM inc i JOIN part p ON i.node_id = p.node_id GROUP BY 1) dd
LEFT JOIN (SELECT ps.community_id, SUM(e.weight) AS l FROM edges e
           JOIN part ps ON e.src = ps.node_id JOIN part pd ON e.dst = pd.node_id
           WHERE ps.community_id = pd.community_id GROUP BY 1) ll USING (community_id),
     (SELECT SUM(weight) AS m FROM edges) mm"""


@register("r09_modularity_region", r6=("modularity",), sql="WITH " + EDGES_SQL + ",\n" + REGION_SQL + """,
part AS (SELECT * FROM region_part)""" + MOD_SQL)
def r09_modularity_region(spark, sf_dir):
    """Weighted modularity of the region partition."""
    c = C(spark, sf_dir)
    return gm.modularity(gb.bipartite_edges(c), gb.region_partition(c))


@register("r10_buyer_resilience", r6=("supplier_exit_coverage_loss", "top_supplier_value_share", "resilience_score"),
          sql="WITH " + EDGES_SQL + """,
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn,
             COUNT(*) OVER (PARTITION BY src) AS n, SUM(weight) OVER (PARTITION BY src) AS t FROM edges)
SELECT substring(src, 3) AS buyer_id, substring(dst, 3) AS top_supplier_id, n AS supplier_count,
       1.0 / n AS supplier_exit_coverage_loss, weight / t AS top_supplier_value_share, weight / t AS resilience_score
FROM r WHERE rn = 1""")
def r10_buyer_resilience(spark, sf_dir):
    """Buyer top-supplier share and coverage loss."""
    return gb.buyer_resilience(edges(spark, sf_dir))


@register("r11_connected_components", sql="WITH RECURSIVE " + EDGES_SQL + ",\n" + CC_SQL + """
SELECT node AS node_id, comp AS component_id FROM cc""")
def r11_connected_components(spark, sf_dir):
    """Connected components by min-label propagation with pointer jumping."""
    return gi.connected_components(edges(spark, sf_dir))


@register("r11_component_summary", r6=("giant_share",), sql="WITH RECURSIVE " + EDGES_SQL + ",\n" + CC_SQL + """,
sizes AS (SELECT comp, COUNT(*) AS size FROM cc GROUP BY comp)
SELECT COUNT(*) AS components, SUM(size)::BIGINT AS nodes, MAX(size) AS giant_size, MAX(size) / SUM(size) AS giant_share,
       COUNT(*) FILTER (WHERE size = 1) AS size_1, COUNT(*) FILTER (WHERE size = 2) AS size_2,
       COUNT(*) FILTER (WHERE size BETWEEN 3 AND 10) AS size_3_10, COUNT(*) FILTER (WHERE size > 10) AS size_gt_10
FROM sizes""")
def r11_component_summary(spark, sf_dir):
    """Component count, giant share and size bands."""
    return gi.component_summary(gi.connected_components(edges(spark, sf_dir)))


@register("r09_modularity_components", r6=("modularity",), sql="WITH RECURSIVE " + EDGES_SQL + ",\n" + CC_SQL + """,
part AS (SELECT node AS node_id, comp AS community_id FROM cc)""" + MOD_SQL)
def r09_modularity_components(spark, sf_dir):
    """Modularity with connected components as communities."""
    e = edges(spark, sf_dir)
    comps = gi.connected_components(e).withColumnRenamed("component_id", "community_id")
    return gm.modularity(e, comps)


@register("r13_conductance_region", r6=("conductance",), sql="WITH " + EDGES_SQL + ",\n" + REGION_SQL + """,
per AS (SELECT p.community_id, COUNT(*) AS vol, COUNT(*) FILTER (WHERE p.community_id != q.community_id) AS cut
        FROM inc i JOIN region_part p ON i.node_id = p.node_id JOIN region_part q ON i.other = q.node_id GROUP BY 1),
tot AS (SELECT 2 * COUNT(*) AS v FROM edges)
SELECT community_id, cut, vol, cut / LEAST(vol, v - vol)::DOUBLE AS conductance FROM per, tot
WHERE LEAST(vol, v - vol) > 0""")
def r13_conductance_region(spark, sf_dir):
    """Conductance per region community."""
    c = C(spark, sf_dir)
    return gm.conductance(gb.bipartite_edges(c), gb.region_partition(c))


@register("r13_conductance_summary", r6=("mean_conductance", "median_conductance", "share_below_cutoff"),
          sql="WITH " + EDGES_SQL + ",\n" + REGION_SQL + """,
per AS (SELECT p.community_id, COUNT(*) AS vol, COUNT(*) FILTER (WHERE p.community_id != q.community_id) AS cut
        FROM inc i JOIN region_part p ON i.node_id = p.node_id JOIN region_part q ON i.other = q.node_id GROUP BY 1),
tot AS (SELECT 2 * COUNT(*) AS v FROM edges),
c AS (SELECT cut / LEAST(vol, v - vol)::DOUBLE AS conductance FROM per, tot WHERE LEAST(vol, v - vol) > 0)
SELECT AVG(conductance) AS mean_conductance, MEDIAN(conductance) AS median_conductance,
       AVG(CAST(conductance < 0.3 AS DOUBLE)) AS share_below_cutoff, COUNT(*) AS communities_scored FROM c""")
def r13_conductance_summary(spark, sf_dir):
    """mean/median conductance and share below 0.3."""
    c = C(spark, sf_dir)
    return gm.conductance_summary(gm.conductance(gb.bipartite_edges(c), gb.region_partition(c)))


@register("r14_ari_components_vs_region", r6=("ari",), sql="WITH RECURSIVE " + EDGES_SQL + ",\n" + REGION_SQL + ",\n"
          + CC_SQL + """,
j AS (SELECT c.comp AS a, r.community_id AS b FROM cc c JOIN region_part r ON c.node = r.node_id),
cont AS (SELECT a, b, COUNT(*) AS nij FROM j GROUP BY a, b),
s AS (SELECT SUM(nij * (nij - 1) / 2.0) AS s_ij, SUM(nij) AS n FROM cont),
sa AS (SELECT SUM(ai * (ai - 1) / 2.0) AS s_a FROM (SELECT SUM(nij) AS ai FROM cont GROUP BY a)),
sb AS (SELECT SUM(bj * (bj - 1) / 2.0) AS s_b FROM (SELECT SUM(nij) AS bj FROM cont GROUP BY b))
SELECT n::BIGINT AS n, CASE WHEN (s_a + s_b) / 2.0 = s_a * s_b / (n * (n - 1) / 2.0) THEN 1.0
            ELSE (s_ij - s_a * s_b / (n * (n - 1) / 2.0)) / ((s_a + s_b) / 2.0 - s_a * s_b / (n * (n - 1) / 2.0)) END AS ari
FROM s, sa, sb""")
def r14_ari_components_vs_region(spark, sf_dir):
    """Adjusted Rand index between components and the region partition."""
    c = C(spark, sf_dir)
    comps = gi.connected_components(gb.bipartite_edges(c)).select("node_id", F.col("component_id").alias("label"))
    reg = gb.region_partition(c).select("node_id", F.col("community_id").alias("label"))
    return gm.adjusted_rand_index(comps, reg)


@register("r06_pagerank")
def r06_pagerank(spark, sf_dir):
    """Weighted PageRank (iterative; checked by invariants, no SQL oracle)."""
    return gi.pagerank(edges(spark, sf_dir))


SCEN_SQL = """top AS (SELECT node_id FROM (SELECT node_id, SUM(weight) AS w FROM inc GROUP BY node_id)
                ORDER BY w DESC, node_id LIMIT 3),
sc AS (SELECT node_id AS scenario_id, node_id FROM top UNION ALL SELECT 'top3', node_id FROM top)"""


def scenarios(e):
    """What-if list derived from the data: each of the 3 heaviest nodes alone, and all 3 together."""
    inc = gb.incidence(e)
    top = (inc.groupBy("node_id").agg(F.sum("weight").alias("w")).orderBy(F.col("w").desc(), "node_id").limit(3)
           .select("node_id"))
    return top.select(F.col("node_id").alias("scenario_id"), "node_id").unionByName(
        top.select(F.lit("top3").alias("scenario_id"), "node_id"))


@register("r17_removal_impact", r4=("exposed_contract_value",), sql="WITH " + EDGES_SQL + ",\n" + SCEN_SQL + """,
touched AS (SELECT DISTINCT sc.scenario_id, e.src, e.dst, e.weight FROM edges e JOIN sc ON e.src = sc.node_id OR e.dst = sc.node_id),
nb AS (SELECT DISTINCT sc.scenario_id, i.other AS node_id FROM inc i JOIN sc ON i.node_id = sc.node_id
       WHERE NOT EXISTS (SELECT 1 FROM sc s2 WHERE s2.scenario_id = sc.scenario_id AND s2.node_id = i.other)),
orph AS (SELECT * FROM nb WHERE NOT EXISTS (
           SELECT 1 FROM inc i WHERE i.node_id = nb.node_id AND NOT EXISTS (
             SELECT 1 FROM sc WHERE sc.scenario_id = nb.scenario_id AND sc.node_id = i.other))),
deg AS (SELECT node_id, COUNT(*) AS d FROM inc GROUP BY node_id),
after AS (SELECT s.scenario_id, COUNT(*) FILTER (WHERE d.node_id LIKE 'B\\_%' ESCAPE '\\' AND
            d.d - (SELECT COUNT(*) FROM inc i JOIN sc x ON x.node_id = i.other AND x.scenario_id = s.scenario_id
                   WHERE i.node_id = d.node_id) = 1
            AND NOT EXISTS (SELECT 1 FROM sc y WHERE y.scenario_id = s.scenario_id AND y.node_id = d.node_id)) AS sa
          FROM (SELECT DISTINCT scenario_id FROM sc) s, deg d GROUP BY s.scenario_id)
SELECT s.scenario_id,
       COALESCE((SELECT SUM(weight) FROM touched t WHERE t.scenario_id = s.scenario_id), 0.0) AS exposed_contract_value,
       (SELECT COUNT(*) FROM orph o WHERE o.scenario_id = s.scenario_id) AS orphaned_counterparties,
       (SELECT COUNT(*) FROM orph o WHERE o.scenario_id = s.scenario_id AND o.node_id LIKE 'B\\_%' ESCAPE '\\') AS stranded_buyers,
       (SELECT COUNT(*) FROM deg WHERE node_id LIKE 'B\\_%' ESCAPE '\\' AND d = 1) AS sole_source_before,
       a.sa AS sole_source_after
FROM (SELECT DISTINCT scenario_id FROM sc) s JOIN after a USING (scenario_id)""")
def r17_removal_impact(spark, sf_dir):
    """Exposed value, orphaned and stranded counterparties, sole-source buyers before/after."""
    e = edges(spark, sf_dir)
    sc = scenarios(e)
    grm.check_removal_set(e, sc)
    return grm.removal_impact(e, sc)


@register("r17_removal_component_shares")
def r17_removal_component_shares(spark, sf_dir):
    """Largest-component share before/after each removal scenario (iterative)."""
    e = edges(spark, sf_dir)
    return grm.removal_component_shares(e, scenarios(e))


BUYER_CPV_SQL = """per_cpv AS (SELECT buyer_id, cpv_division, COUNT(*) AS n FROM contracts_base WHERE buyer_id IS NOT NULL GROUP BY 1, 2),
buyer_cpv AS (SELECT 'B_' || buyer_id AS node_id, ARG_MIN(cpv_division, (-n, cpv_division)) AS category FROM per_cpv GROUP BY 1)"""

AFFECTED_SQL = """hit AS (SELECT DISTINCT sc.scenario_id, e.src AS buyer FROM edges e JOIN sc ON e.dst = sc.node_id),
affected AS (FROM hit WHERE (scenario_id, buyer) NOT IN (SELECT (scenario_id, node_id) FROM sc))"""


def buyer_category(spark, sf_dir):
    from ..operators.common import top_k_per_group
    c = C(spark, sf_dir).where(F.col("buyer_id").isNotNull()).groupBy("buyer_id", "cpv_division").agg(F.count(F.lit(1)).alias("n"))
    t = top_k_per_group(c, ["buyer_id"], [F.col("n").desc(), F.col("cpv_division")], 1, salt_col="cpv_division")
    return t.select(F.concat(F.lit("B_"), "buyer_id").alias("node_id"), F.col("cpv_division").alias("category"))


@register("r17_dependency_shift", r6=("dependency_before", "dependency_after"), sql="WITH " + EDGES_SQL + ",\n" + SCEN_SQL + ",\n" + AFFECTED_SQL + """,
kept AS (SELECT a.scenario_id, a.buyer, e.weight,
                CASE WHEN (a.scenario_id, e.dst) IN (SELECT (scenario_id, node_id) FROM sc) THEN NULL ELSE e.weight END AS left_weight
         FROM affected a JOIN edges e ON e.src = a.buyer)
SELECT scenario_id, buyer, COALESCE(MAX(weight) / SUM(weight), 0) AS dependency_before,
       COALESCE(MAX(left_weight) / SUM(left_weight), 0) AS dependency_after FROM kept GROUP BY scenario_id, buyer""")
def r17_dependency_shift(spark, sf_dir):
    """Largest-supplier share of every affected buyer before and after each removal."""
    e = edges(spark, sf_dir)
    return grm.dependency_shift(e, scenarios(e))


@register("r17_substitutability", sql="WITH " + EDGES_SQL + ",\n" + SCEN_SQL + ",\n" + AFFECTED_SQL + ",\n" + BUYER_CPV_SQL + """
SELECT a.scenario_id, a.buyer,
       (SELECT COUNT(DISTINCT e.dst) FROM edges e JOIN buyer_cpv o ON o.node_id = e.src
        WHERE o.category = b.category AND (a.scenario_id, e.dst) NOT IN (SELECT (scenario_id, node_id) FROM sc)) AS substitutes
FROM affected a LEFT JOIN buyer_cpv b ON b.node_id = a.buyer""")
def r17_substitutability(spark, sf_dir):
    """Remaining suppliers in the category of every affected buyer."""
    e = edges(spark, sf_dir)
    return grm.substitutability(e, scenarios(e), buyer_category(spark, sf_dir))


@register("r17_community_value_removed", r6=("internal_value_removed_share",), sql="WITH " + EDGES_SQL + ",\n" + SCEN_SQL + ",\n" + REGION_SQL + """,
inner_edges AS (SELECT e.*, p.community_id AS c FROM edges e JOIN region_part p ON p.node_id = e.src JOIN region_part q ON q.node_id = e.dst
                WHERE p.community_id = q.community_id),
touched AS (SELECT DISTINCT scenario_id, community_id AS c FROM sc JOIN region_part USING (node_id))
SELECT t.scenario_id, t.c AS community_id,
       COALESCE((SELECT SUM(weight) FROM inner_edges i WHERE i.c = t.c AND EXISTS (
                   SELECT 1 FROM sc WHERE sc.scenario_id = t.scenario_id AND sc.node_id IN (i.src, i.dst)))
                / (SELECT SUM(weight) FROM inner_edges i WHERE i.c = t.c), 0) AS internal_value_removed_share
FROM touched t""")
def r17_community_value_removed(spark, sf_dir):
    """Share of each touched region community's internal value that a removal takes."""
    e = edges(spark, sf_dir)
    return grm.community_value_removed(e, scenarios(e), gb.region_partition(C(spark, sf_dir)))


@register("r17_removed_cut_vertices")
def r17_removed_cut_vertices(spark, sf_dir):
    """Which removed nodes are cut vertices."""
    e = edges(spark, sf_dir)
    return grm.removed_cut_vertices(e, scenarios(e))


@register("r16_value_stratified_sample", r4=("weight",), sql="WITH " + EDGES_SQL + """,
d AS (SELECT *, NTILE(10) OVER (ORDER BY weight, src, dst) AS decile FROM edges),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY decile ORDER BY md5('42|' || decile || '|' || src || '|' || dst), src, dst) AS rn,
             COUNT(*) OVER (PARTITION BY decile) AS nd FROM d)
SELECT src, dst, weight, contracts, decile FROM r WHERE rn <= FLOOR(nd * 0.35 + 0.5)""")
def r16_value_stratified_sample(spark, sf_dir):
    """Value-decile stratified 35 % edge sample, seed 42."""
    return smp.value_stratified_edge_sample(edges(spark, sf_dir), 0.35, 42)


from ..operators.graph import blocks as gbl  # noqa: E402


@register("r21_exposure_table")
def r21_exposure_table(spark, sf_dir):
    """Cut vertices (Tarjan–Vishkin on a BFS forest), removal shares via blocks, systemic-importance rank."""
    c = C(spark, sf_dir)
    return gbl.exposure_table(gb.bipartite_edges(c), gb.region_partition(c))


@register("r24_resilience_summary")
def r24_resilience_summary(spark, sf_dir):
    """Articulation points, degree-1 buyers, communities of the exposure table."""
    c = C(spark, sf_dir)
    return gbl.resilience_summary(gbl.exposure_table(gb.bipartite_edges(c), gb.region_partition(c)))


from ..operators.graph import betweenness as gbw  # noqa: E402
from ..operators.graph.intask import TASK_ROWS  # noqa: E402


@register("r04_betweenness")
def r04_betweenness(spark, sf_dir):
    """Betweenness centrality from 500 md5-chosen pivots (Brandes, all pivots per BFS level together)."""
    return gbw.betweenness(edges(spark, sf_dir), k=500, seed=42, batch=250, task_rows=TASK_ROWS)


@register("r05_composite_centrality")
def r05_composite_centrality(spark, sf_dir):
    """0.4·degree + 0.3·betweenness + 0.3·PageRank centrality, min–max scaled (locked-artefact weights)."""
    e = edges(spark, sf_dir)
    m = (gb.node_metrics(e).join(gbw.betweenness(e, k=500, seed=42, batch=250, task_rows=TASK_ROWS), "node_id", "left")
         .join(gi.pagerank(e), "node_id", "left"))
    return gb.composite_centrality(m, 0.4, 0.3, 0.3)


from ..operators.graph import communities as gco  # noqa: E402


#: fixed values: the published seeds, communities kept in the top-k comparison and the reported target
ARI_SEEDS, ARI_TOP_K, ARI_TARGET = (42, 892, 7739, 6545, 4388), 20, 0.70

#: graph results written by this process: (application, name, inputs' listing) -> table
_STORED: dict[tuple, object] = {}


def _stored(spark, sf_dir, name, build):
    """``build()`` written once per session and input listing, for all queries that read it."""
    from ..sources.contracts import source_signature
    key = (spark.sparkContext.applicationId, name, *source_signature(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = gi.materialize(build())
    return _STORED[key]


def communities(spark, sf_dir):
    return _stored(spark, sf_dir, "louvain", lambda: gco.louvain(edges(spark, sf_dir), seed=42)[0])


def ari_pairs(spark, sf_dir):
    return _stored(spark, sf_dir, "ari", lambda: gm.pairwise_ari(gco.louvain_seeds(edges(spark, sf_dir), ARI_SEEDS), ARI_TOP_K))


def null_test(spark, sf_dir):
    return _stored(spark, sf_dir, "null", lambda: gco.null_model_test(edges(spark, sf_dir), rewires=100, seed=42, rounds=5, alpha=0.01, group=100))


def giant_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    return _stored(spark, sf_dir, "giant", lambda: gi.giant_component_edges(e, gi.connected_components(e)))


def giant_scores(spark, sf_dir):
    return _stored(spark, sf_dir, "giant-scores", lambda: gco.partition_scores(giant_edges(spark, sf_dir), ARI_SEEDS, ARI_TOP_K))


@register("r07_communities")
def r07_communities(spark, sf_dir):
    """Parallel Louvain partition (local moving + contraction levels), seed 42."""
    return communities(spark, sf_dir)


@register("r07_modularity")
def r07_modularity(spark, sf_dir):
    """Exact modularity of the parallel Louvain partition."""
    return gm.modularity(edges(spark, sf_dir), communities(spark, sf_dir))


@register("r14_ari_pairs")
def r14_ari_pairs(spark, sf_dir):
    """Adjusted Rand index of all ten pairs of the five seeds' partitions, over all nodes and the top 20 communities."""
    return ari_pairs(spark, sf_dir)


@register("r14_ari_stability")
def r14_ari_stability(spark, sf_dir):
    """Mean, min, median, max over the seed pairs and the mean over the top communities."""
    return gm.ari_summary(ari_pairs(spark, sf_dir))


@register("r12_giant_component")
def r12_giant_component(spark, sf_dir):
    """The giant component scored anew: modularity, conductance and seed stability of its own partition."""
    return giant_scores(spark, sf_dir)


@register("r15_null_model")
def r15_null_model(spark, sf_dir):
    """Modularity of Louvain on 100 degree-preserving randomised graphs; null mean and sd, z, empirical p, p < 0.01."""
    return null_test(spark, sf_dir)


@register("i05_validation_metrics")
def i05_validation_metrics(spark, sf_dir):
    """The one-row validation table of the network: modularity with its null test, conductance, seed stability, giant component."""
    e = edges(spark, sf_dir)
    return gco.validation_row(e, communities(spark, sf_dir), null_test(spark, sf_dir), ari_pairs(spark, sf_dir), giant_scores(spark, sf_dir),
                              gi.component_summary(gi.connected_components(e)), ARI_TARGET, 42)
