"""Sources follow their inputs and any store that Spark reads."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from tenderscope.sources import contracts, sinks, tables

TABLES = "/root/testdata/sf0.001"


def test_rewritten_part_file_is_seen(spark, tmp_path):
    for t in contracts.CONTRACT_SOURCES:
        if t == "lineitem":
            spark.read.parquet(f"{TABLES}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            shutil.copy(f"{TABLES}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    before = contracts.canonical_contracts(spark, str(tmp_path)).count()
    part = sorted(glob.glob(f"{tmp_path}/lineitem.parquet/part-*"))[0]
    fewer = spark.read.parquet(part).limit(10).toPandas()
    folder = os.stat(os.path.dirname(part)).st_mtime
    fewer.to_parquet(part, coerce_timestamps="us")
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    os.utime(os.path.dirname(part), (folder, folder))
    assert contracts.canonical_contracts(spark, str(tmp_path)).count() == before  # listed once a session
    contracts.refresh_sources(spark)
    after = contracts.canonical_contracts(spark, str(tmp_path)).count()
    assert after < before


def test_cached_table_and_views(spark, tmp_path):
    calls = []
    def compute():
        calls.append(1)
        return spark.range(5)
    for _ in range(2):
        assert sinks.cached_table(spark, f"{tmp_path}/cache", compute).count() == 5
    assert len(calls) == 1
    # a writer that comes second reads what the first one published, and leaves nothing beside it
    sinks.publish_once(spark, spark.range(9), f"{tmp_path}/cache")
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 5
    assert sorted(p for p in os.listdir(tmp_path) if p.startswith("cache")) == ["cache"]
    tables.register_views(spark, str(tmp_path), ("missing",))
    assert tables.read_if_present(spark, f"{tmp_path}/none") is None
    (tmp_path / "q.sql").write_text("SELECT 1 AS one,\n 2 AS two")
    assert sinks.run_sql_file(spark, f"{tmp_path}/q.sql", f"{tmp_path}/out").select(F.col("one") + F.col("two")).first()[0] == 3
