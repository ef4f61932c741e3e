import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stormlift.operators.ordered import dense_index, probe_counts, quantiles, running


def test_running_sums_with_one_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.randrange(50), i, rng.randrange(5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several range partitions
    try:
        got = running(df, ["k"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, {"t0": "t"}).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = pd.DataFrame(rows, columns=["k", "t", "id", "v"]).sort_values(["k", "t", "id"])
    g = want.groupby("k")
    want["s"], want["n"] = g["v"].cumsum(), g.cumcount() + 1
    want["s_total"], want["t0"] = g["v"].transform("sum"), g["t"].transform("min")
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(rows)
    for c in ("s", "n", "s_total", "t0"):
        assert (both[c] == both[f"{c}_w"]).all(), c


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(8)
    got = dense_index(df, ["x"], "g").collect()
    assert all(r.x == r.g for r in got)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 999), "v": rng.integers(0, 40, 999) / 4})
    got = quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["a", "b", "c"]].to_numpy(dtype=float), np.quantile(part["v"], [0.25, 0.5, 0.9]))


def test_probe_counts_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(200), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, us long, id long")
    got = probe_counts(df, df, ["k"], {"n": F.lit(1), "odd": F.col("id") % 2}, {"5": 5, "40": 40}).collect()
    at = {i: (k, us) for k, us, i in rows}
    assert len(got) == len(rows)
    for r in got:
        k, us = at[r.id]
        for w in (5, 40):
            inside = [i for kk, u, i in rows if kk == k and us - w <= u <= us]
            assert r[f"n_{w}"] == len(inside)
            assert r[f"odd_{w}"] == sum(i % 2 for i in inside)
