"""Whitening against a dense solver; the iteration on its own."""

import math

import numpy as np
import pytest

from stormlift.llm import whitening as W

KINDS = "vec_id long, embedding array<float>, n int, component string, x double"


def dense(rows, components=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    kept = [(i, [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v]) for i, v in kept if len(v) == dim]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, float) - np.array(sums, float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = int(min(components, (e > 1e-12 * e[0]).sum()))
    rows_y = np.array([v for _, v in kept], float) - np.array(sums, float) / n
    exact = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for _, v in kept]
    return [i for i, _ in kept], n, exact, rows_y @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(spark, rows, components=16):
    df = spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in rows], KINDS)
    ids, n, exact, white, share = dense(rows, components)
    got = W.whiten(df, components=components).collect()
    assert len(got) == white.size
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, white.shape[1] + 1))
    for c in by:
        column = white[:, c - 1]
        want = {}
        for i, w, d in zip(ids, column, exact, strict=True):
            want.setdefault(i, []).append((w, d))
        some = max(range(len(ids)), key=lambda j: abs(column[j]))
        sign = np.sign(column[some]) * np.sign(max((r["whitened"] for r in by[c][ids[some]]), key=abs))
        for i, rs in by[c].items():
            mine = sorted((sign * r["whitened"], int(r["deviation"])) for r in rs)
            assert len(mine) == len(want[i])
            for (a, d), (b, f) in zip(mine, sorted(want[i]), strict=True):
                assert d == f and abs(a - b) < 1e-7 * max(1, abs(b))
            assert all(r["n"] == n and abs(r["explained"] / share[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-10 for r in rs)


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 24)) * np.linspace(1, 4, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(i, rows[3][1]) for i in range(900, 1100)]  # a third of all rows is one vector
    rows += [(5, rows[9][1]), (None, rows[10][1]), (2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23), (2003, [float("inf")] * 24), (2004, []), (2005, [1.0, 2.0])]
    check(spark, rows)
    check(spark, rows, components=3)


def test_few_dimensions_and_few_vectors(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((50, 3)))])
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((4, 20)))])


def test_without_variance_there_is_no_row(spark):
    def count(rows):
        return W.whiten(spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in rows], KINDS)).count()

    assert count([]) == count([(1, None)]) == count([(1, [])]) == count([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == 0


def test_deviations_beyond_a_long_stay_exact(spark):
    rows = [(i, [float(2**40 * i), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in rows], KINDS)
    got = {r["vec_id"]: int(r["deviation"]) for r in W.whiten(df, components=1).collect()}
    ids, _, exact, _, _ = dense(rows)
    assert got == dict(zip(ids, exact, strict=True)) and max(exact) > 1 << 63


def test_sums_are_added_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)
    monkeypatch.setattr(W, "PACK", 16)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(rng.integers(0, 99, (300, 5)))], "id long, x array<long>")
    cloud = W.Cloud(rows.repartition(8), 5)
    x = np.array(sorted({tuple(r["x"]) for r in rows.collect()}), float)
    assert cloud.n == len(x) and cloud.sums == [int(s) for s in x.sum(axis=0)]
    y, v = x - x.mean(axis=0), rng.standard_normal((5, 3))
    assert np.allclose(cloud.times(v), y.T @ y @ v / len(x), rtol=1e-13, atol=1e-10)


@pytest.mark.parametrize("kind", ["noise", "low rank", "decay", "equal", "flat"])
def test_iteration_reaches_double_precision(kind):
    rng = np.random.default_rng(0)
    x = {
        "noise": lambda: rng.standard_normal((2000, 64)),
        "low rank": lambda: rng.standard_normal((3000, 5)) @ rng.standard_normal((5, 40)),
        "decay": lambda: rng.standard_normal((5000, 300)) * np.linspace(1, 30, 300),
        "equal": lambda: np.concatenate([np.eye(64), -np.eye(64)]),
        "flat": lambda: rng.standard_normal((5000, 200)),
    }[kind]()
    a = np.cov(x.T, bias=True)
    values, vectors = W.jacobi_davidson(lambda v: a @ v, len(a), 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * want[0] * math.sqrt(len(a))
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = q * np.linspace(1, 10, 30) @ q.T
    b, shifts = rng.standard_normal((30, 4)), np.array([0.2, 11.0, 5.07, 12.0])
    t = W.minres(lambda v: a @ v, shifts, b, 60, cut=1e-12)
    for j in range(4):
        assert np.linalg.norm((a - shifts[j] * np.eye(30)) @ t[:, j] - b[:, j]) < 1e-7 * np.linalg.norm(b[:, j])
    assert not W.minres(lambda v: a @ v, shifts, np.zeros((30, 4)), 5).any()
