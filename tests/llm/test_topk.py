"""Top-k search against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stormlift.llm import topk


def plain(rows, k, scale=64):
    least = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * x) for x in v]
        least[i] = min(least.get(i, w), w)
    out = []
    for q in sorted(i for i in least if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(least[q], w, strict=True)), i) for i, w in least.items() if i != q and len(w) == len(least[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("tile,block,fan_in", [(8192, 2048, 16), (16, 4, 2)])
def test_equals_all_pairs(spark, monkeypatch, tile, block, fan_in):
    for name, value in (("TILE", tile), ("BLOCK", block), ("FAN_IN", fan_in)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(4)]) for i in range(0, 300)]
    rows += [(400, [0.1, 0.2]), (401, [0.3, 0.2]), (420, []), (440, None), (460, [float("nan"), 1.0, 1.0, 1.0]), (480, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (461, [float("inf")] * 4), (-20, [3e7] * 4), (0, [-9.0] * 4), (7, [0.25] * 4)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=6).collect())
    assert got == plain(rows, 6)


def test_large_values_and_few_rows(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, -3.0]), (2, [2.0**10, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == plain(rows, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
