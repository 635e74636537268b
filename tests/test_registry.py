"""Driver contract: registry shape and the flagship query."""

import __spark_entry__ as entry


def test_every_query_documented_and_sql_keys_subset():
    qs = entry.queries()
    sqls = entry.oracle_sql()
    assert len(qs) >= 100
    assert set(sqls) <= set(qs)
    for name, fn in qs.items():
        assert fn.__doc__, name


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(["buyer_id", "dependency_ratio", "dependency_class"]) <= set(df.columns)
    assert df.count() > 0
