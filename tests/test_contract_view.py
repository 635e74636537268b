"""The canonical view's joins: fact rows move as often on small tables as on large ones, and nothing is sorted for a join."""

import datetime as dt
import io
from contextlib import redirect_stdout

from tenderscope.sources import contracts


def _tables(spark, folder):
    def put(name, rows, schema, files=1):
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/{name}.parquet")
    put("nation", [(0, "N0"), (1, "N1")], "n_nationkey long, n_name string")
    put("customer", [(1, "C1", 0), (2, "C2", 1), (2, "C2 again", 1), (None, "C?", 0)], "c_custkey long, c_name string, c_nationkey long")
    put("supplier", [(7, "S7", 1), (8, "S8", None)], "s_suppkey long, s_name string, s_nationkey long")
    put("part", [(5, "b5", 10.0), (6, None, 2.0)], "p_partkey long, p_brand string, p_retailprice double")
    put("orders", [(10, 1, "1-URGENT"), (11, 2, None), (None, 1, "5-LOW"), (12, None, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string")
    day = dt.datetime(1996, 3, 2)
    put("lineitem", [(10, 5, 7, 1, 3.0, 100.0, 0.1, "R", "O", day), (10, 6, 7, 6, 3.0, 50.0, 0.0, "N", "O", day),
                     (11, 5, 7, 7, 1.0, 20.0, 0.5, None, None, None), (11, 5, 8, 1, 1.0, 1.0, 0.0, "A", "F", day),
                     (None, 5, 7, 1, 1.0, 1.0, 0.0, "A", "F", day), (12, 5, 7, 1, 1.0, 1.0, 0.0, "A", "F", day)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def test_view_moves_fact_rows_alike_at_any_size(spark, tmp_path):
    _tables(spark, tmp_path)
    view = contracts.contracts_from_testdata(spark, str(tmp_path))
    with redirect_stdout(io.StringIO()) as text:
        view.explain()
    plan = text.getvalue()
    assert plan.count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan
    cols = ("contract_id", "buyer_name", "supplier_region", "cpv_division", "procedure_type", "bid_count", "contract_amendments",
            "award_year", "estimated_price", "contract_value")
    got = sorted((tuple(r[c] for c in cols) for r in view.collect()), key=str)
    assert got == sorted([("10", "C1", "N1", "b5", "OUTRIGHT_AWARD", 1.0, 3.0, 1996, 30.0, 90.0),
                          ("10", "C1", "N1", None, "OUTRIGHT_AWARD", 6.0, 0.0, 1996, 0.0, 50.0),
                          ("11", "C2", "N1", "b5", "UNKNOWN", None, None, None, 10.0, 10.0),
                          ("11", "C2 again", "N1", "b5", "UNKNOWN", None, None, None, 10.0, 10.0)], key=str)


def test_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    before = contracts.contracts_from_testdata(spark, str(tmp_path)).count()
    monkeypatch.setattr(contracts, "JOIN_BYTES", 256)
    view = contracts.contracts_from_testdata(spark, str(tmp_path))
    assert view.rdd.getNumPartitions() >= contracts.table_bytes(spark, str(tmp_path), "lineitem") // 256 > 4
    assert view.count() == before
