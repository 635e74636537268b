"""Bipartite buyer–supplier graph analytics as DataFrame jobs.

A graph is two DataFrames: ``nodes(node_id, entity_id, node_type)`` and
``edges(src, dst, weight, contracts)`` with ``src`` a buyer node ``B_<id>`` and
``dst`` a supplier node ``S_<id>``. Iterative algorithms work on dense long
vertex ids and cut lineage with ``checkpoint()`` into ``spark.checkpoint.dir``.
"""
