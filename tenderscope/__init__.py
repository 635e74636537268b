"""tenderscope: buyer–supplier contract analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    scans, the canonical contract view, sinks, the access-log reader
functions  column expressions (rule ladders, classes, pseudonyms, scaling)
operators  DataFrame -> DataFrame operators (queries, features, graph, ML, stats)
plans      the query registry used by ``__spark_entry__`` and ``bench.py``
streaming  Structured Streaming form of the append-only access-log reader
"""

__version__ = "0.1.0"
