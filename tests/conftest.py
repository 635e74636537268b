import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tenderscope-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tenderscope.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


H1_ROWS = [
    # contract, buyer, supplier, cpv, procedure, bids, amend, date, value
    ("c1", "b1", "s1", "45", "OPEN", 1.0, 0.0, dt.date(2018, 1, 10), 60.0),
    ("c1", "b1", "s1", "45", "OPEN", 1.0, 0.0, dt.date(2018, 1, 10), 60.0),
    ("c2", "b1", "s2", "45", "NEGOTIATED", None, 3.0, dt.date(2018, 6, 1), 30.0),
    ("c3", "b2", "s1", "30", "OUTRIGHT_AWARD", 1.0, 3.0, dt.date(2019, 1, 9), 100.0),
    ("c4", "b2", "s1", "30", "OPEN", 4.0, 0.0, dt.date(2019, 1, 10), 50.0),
    ("c5", None, "s3", "UNKNOWN", "OPEN", 2.0, 0.0, dt.date(2019, 2, 1), 10.0),
]


@pytest.fixture(scope="session")
def h1(spark):
    """Hand-computed contract fixture (FIXTURES.md H1) in the canonical schema."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(H1_ROWS, "contract_id string, buyer_id string, supplier_id string, cpv_division string, "
                                        "procedure_type string, bid_count double, contract_amendments double, "
                                        "award_date date, contract_value double")
    return (df.withColumn("persistent_id", F.col("contract_id")).withColumn("tender_id", F.col("contract_id"))
            .withColumn("buyer_name", F.coalesce("buyer_id", F.lit("UNKNOWN")))
            .withColumn("supplier_name", F.col("supplier_id")).withColumn("buyer_region", F.lit("R1"))
            .withColumn("supplier_region", F.lit("R1")).withColumn("award_year", F.year("award_date"))
            .withColumn("estimated_price", F.col("contract_value")).withColumn("final_price", F.col("contract_value")))


@pytest.fixture(scope="session")
def h2(spark):
    """Hand-computed graph fixture (FIXTURES.md H2)."""
    return spark.createDataFrame([("B_b1", "S_s1", 10.0, 1), ("B_b1", "S_s2", 5.0, 1), ("B_b2", "S_s2", 5.0, 1),
                                  ("B_b3", "S_s3", 7.0, 1)], "src string, dst string, weight double, contracts long")
