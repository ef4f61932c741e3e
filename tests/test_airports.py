"""Per-airport models fitted together, against a fit of each alone; packs and their routing."""

import numpy as np
import pytest

from stormlift.operators import airports as AP
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]
KINDS = "lightning_id long, airport string, fold int, y int, a double, b double, c double"


def made():
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for airport, size in (("BIG", 900), ("MID", 200), ("FEW", 25), ("ONE", 40), ("SOLE", 30)):
        for i in range(size):
            x = rng.standard_normal(3) * (1, 20, 0.1) + (0, 5, 0)
            y = int(x[0] + x[1] / 20 + rng.standard_normal() > 0.5)
            if airport == "ONE":
                y = 0
            if airport == "SOLE":
                y = int(i % 5 == 2)  # every positive stands in fold 2: without it there is one class
            rows.append((n, airport, i % 5, y, *map(float, x)))
            n += 1
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), KINDS)


def alone(x, y, mean, sd, penalty=1.0):
    x = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge, beta = np.array([penalty] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * b**2).sum()

    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        way = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-10), x.T @ (w * (y - p)) - ridge * beta)
        share = 1.0
        while share > 1e-9 and loss(beta + share * way) > loss(beta):
            share /= 2
        beta = beta + share * way
        if np.abs(way).max() < 1e-11:
            break
    return beta[:-1] / sd, beta[-1] - (beta[:-1] / sd) @ mean


def test_every_airport_equals_its_own_fit(spark, rows, monkeypatch):
    monkeypatch.setattr(AP, "HELD", 2)
    got = {(r["airport"], r["fold"]): r for r in AP.fit_airports(rows, FEATURES).collect()}
    data = np.array([r[2:] for r in made()], float)
    airport = np.array([r[1] for r in made()])
    mean, sd = data[:, 2:].mean(axis=0), data[:, 2:].std(axis=0)
    want = set()
    for a in set(airport):
        for f in range(-1, 5):
            part = data[(airport == a) & (data[:, 0] != f)]
            if 0 < part[:, 1].sum() < len(part):
                want.add((a, f))
                coefficients, at = alone(part[:, 2:], part[:, 1], mean, sd)
                assert np.allclose(got[a, f]["coefficients"], coefficients, rtol=1e-6, atol=1e-8) and abs(got[a, f]["intercept"] - at) < 1e-6
                assert (got[a, f]["n"], got[a, f]["n_pos"]) == (len(part), part[:, 1].sum())
    assert set(got) == want and ("ONE", -1) not in want and ("SOLE", 2) not in want and ("SOLE", 1) in want


@pytest.mark.parametrize("together", [0, 100, 10**9])
def test_airports_solved_whole_and_iterated_are_alike(rows, together, monkeypatch):
    """Sums of equations are made for the airports beyond the limit alone, and for those only."""
    iterated, equations = set(), AP._equations
    monkeypatch.setattr(AP, "_equations", lambda f, mean, sd, k, states: iterated.update(states) or equations(f, mean, sd, k, states))
    want = {(r["airport"], r["fold"]): r for r in AP.fit_airports(rows, FEATURES).collect()}
    assert not iterated
    monkeypatch.setattr(AP, "TOGETHER", together)
    got = {(r["airport"], r["fold"]): r for r in AP.fit_airports(rows, FEATURES).collect()}
    whole = {r["fold"]: r for r in AP.fit_airports(rows, FEATURES, own=False).collect()}
    assert iterated == {0: {"BIG", "MID", "FEW", "ONE", "SOLE", AP.WHOLE} - {"ONE"}, 100: {"BIG", "MID", AP.WHOLE}, 10**9: set()}[together]
    assert set(got) == set(want) and set(whole) == {-1, 0, 1, 2, 3, 4}
    for at, r in want.items():
        assert np.allclose(got[at]["coefficients"], r["coefficients"], rtol=1e-7, atol=1e-9) and abs(got[at]["intercept"] - r["intercept"]) < 1e-7
        assert (got[at]["n"], got[at]["n_pos"]) == (r["n"], r["n_pos"])


def test_out_of_fold_scores_and_metrics(spark, rows):
    scored = AP.airport_oof(rows.withColumn("extra", F.lit("x")), FEATURES)
    got = scored.collect()
    assert len(got) == len(made()) and "extra" in scored.columns
    models = {(r["airport"], r["fold"]): r for r in AP.fit_airports(rows, FEATURES).collect()}
    whole = {r["fold"]: r for r in AP.fit_airports(rows, FEATURES, own=False).collect()}
    for r in got:
        m = models.get((r["airport"], r["fold"]))
        assert r["model"] == ("own" if m else "global")
        m = m or whole[r["fold"]]
        z = float(np.dot(m["coefficients"], [r[c] for c in FEATURES]) + m["intercept"])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-12
    by = {r["airport"]: r for r in AP.airport_metrics(scored).collect()}
    assert set(by) == {"BIG", "MID", "FEW", "ONE", "SOLE"} and by["BIG"]["auc"] > 0.7 and by["BIG"]["n"] == 900
    assert by["BIG"].asDict().keys() == {"airport", "n", "n_pos", "auc", "f1", "precision", "recall", "threshold"}


def test_pack_versions_and_routing(spark, rows, tmp_path):
    own, whole = AP.fit_airports(rows, FEATURES), AP.fit_airports(rows, FEATURES, own=False)
    thresholds = spark.createDataFrame([("BIG", 0.7), ("MID", 0.2)], "airport string, threshold double")
    path = str(tmp_path / "pack")
    AP.save_airport_pack(path, 1, FEATURES, own, whole, thresholds.withColumn("threshold", F.lit(0.9)))
    AP.save_airport_pack(path, 2, FEATURES, own, whole, thresholds)
    pack = AP.load_airport_pack(spark, path)
    assert pack["version"] == 2 and pack["features"] == FEATURES
    strange = spark.createDataFrame([(9999, "NEW", 0, 0, 0.0, 0.0, 0.0)], KINDS)
    out = AP.apply_airport_pack(rows.unionByName(strange), pack)
    routed = {r["airport"]: (r["model"], r["threshold"]) for r in out.select("airport", "model", "threshold").distinct().collect()}
    assert routed == {"BIG": ("own", 0.7), "MID": ("own", 0.2), "FEW": ("own", 0.5), "SOLE": ("own", 0.5), "ONE": ("global", 0.5), "NEW": ("global", 0.5)}
    assert all(r["lifts"] == (r["score"] >= r["threshold"]) for r in out.collect())
    old = AP.load_airport_pack(spark, path, 1)
    assert {r["threshold"] for r in old["models"].collect()} == {0.9, 0.5}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") <= 1 and plan.count("Join") == 3  # whatever the number of airports
    missing = AP.apply_airport_pack(rows.drop("c"), pack)
    assert missing.count() == rows.count()


def test_without_rows_there_is_no_model(spark, rows):
    empty = rows.limit(0)
    assert AP.fit_airports(empty, FEATURES).count() == AP.fit_airports(empty, FEATURES, own=False).count() == 0
    assert AP.airport_oof(empty, FEATURES).count() == 0
