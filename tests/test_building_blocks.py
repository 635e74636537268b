"""Skew-safe building blocks against their naive single-window forms."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderscope.operators.common import average_rank, global_order_prefix, ntile_from_position, top_k_per_group


def test_top_k_matches_plain_window(spark):
    rnd = random.Random(5)
    rows = [(f"g{rnd.randint(0, 3)}", f"k{i}", float(rnd.randint(0, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k string, v double")
    got = {(r["g"], r["k"]) for r in top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 5, salt_col="k",
                                                     salt_buckets=7).collect()}
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "k")
    exp = {(r["g"], r["k"]) for r in df.withColumn("r", F.row_number().over(w)).where("r <= 5").collect()}
    assert got == exp


def test_global_prefix_and_ntile(spark):
    rnd = random.Random(9)
    rows = [(i, float(rnd.randint(0, 50))) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: (r["_pos"], r["_cum_s"]) for r in
           global_order_prefix(df, [F.col("v"), F.col("id")], {"s": F.col("v")}, buckets=6).collect()}
    ordered = sorted(rows, key=lambda t: (t[1], t[0]))
    cum = 0.0
    for pos, (i, v) in enumerate(ordered, start=1):
        cum += v
        assert got[i][0] == pos and abs(got[i][1] - cum) < 1e-9
    nt = spark.createDataFrame([(p, 1000) for p in range(1, 1001)], "p long, n long") \
        .select(ntile_from_position(F.col("p"), F.col("n"), 7).alias("t")).collect()
    exp = spark.createDataFrame([(p,) for p in range(1, 1001)], "p long") \
        .select(F.ntile(7).over(Window.orderBy("p")).alias("t")).collect()
    assert [r["t"] for r in nt] == [r["t"] for r in exp]


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r["r"] for r in average_rank(df, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0]
