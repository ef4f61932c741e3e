import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlift.operators import learn as L
from stormlift.operators.neighbours import nearest, tile_visits, tiles_of


@pytest.fixture(scope="module")
def rows(spark):
    """Labelled rows where x0 tells the class most of the time; 40 alerts at 3 airports."""
    rng = random.Random(11)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.2)
        data.append((i, "ABC"[i % 3], i // 15, y, y + rng.gauss(0, 0.4), rng.random(), float(rng.randrange(4))))
    df = spark.createDataFrame(
        data, "lightning_id long, airport string, airport_alert_id long, y int, x0 double, x1 double, x2 double"
    )
    return L.with_folds(df).cache()


X = ["x0", "x1", "x2"]


def test_folds_are_pure_and_even(rows):
    per = rows.groupBy("airport", "airport_alert_id").agg(F.countDistinct("fold").alias("k"))
    assert per.filter("k > 1").count() == 0
    sizes = [r["count"] for r in rows.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 15


def test_weights_balance_the_classes(rows):
    w = {r.y: r.s for r in L.with_weights(rows, "balanced").groupBy("y").agg(F.sum("w").alias("s")).collect()}
    assert w[0] == pytest.approx(w[1]) == pytest.approx(300)
    assert L.with_weights(rows, "none").agg(F.sum("w")).first()[0] == 600


@pytest.mark.parametrize("config", ["gbt_balanced", "forest_balanced", "logistic_balanced"])
def test_out_of_fold_beats_chance(rows, config):
    from stormlift.operators import metrics as M

    got = L.oof(rows, X, config, size=5, max_depth=3)
    assert got.count() == rows.count() == got.select("lightning_id").distinct().count()
    m = M.rank_metrics(M.score_table(got)).first()
    assert m.auc_roc > 0.8 and m.auc_pr > 2 * 0.2


def test_early_stop_uses_the_named_fold(rows):
    model = L.fit(rows.filter("fold != 0"), X, "gbt_v4", 5, 2, stop_fold=1)
    assert 1 <= model.stages[-1].getNumTrees <= 5


def test_size_leaves_the_step_alone():
    for name, (make, _, _) in L.CONFIGS.items():
        whole, small = make(), make(7)
        if name.startswith(("gbt", "boost")):
            assert small.getStepSize() == whole.getStepSize() and small.getMaxIter() == 7
            assert make(7, step_size=0.3).getStepSize() == 0.3


def test_early_stop_with_resampling_keeps_the_fold_real(rows):
    model = L.fit(rows.filter("fold != 0"), X, "gbt_smote", 3, 2, stop_fold=1)
    assert 1 <= model.stages[-1].getNumTrees <= 3


def test_logistic_penalty_follows_the_rows(rows):
    one = L.fit(rows, X, "logistic_balanced", 5).stages[-1]
    assert one.getRegParam() == pytest.approx(1 / 600)


def test_importance_ranks_the_signal(rows):
    table = L.feature_importance(L.fit(rows, X, "forest_balanced", 5, 3)).orderBy(F.desc("importance")).collect()
    assert table[0].feature == "x0" and sum(r.importance for r in table) == pytest.approx(1)


def test_fallback_order(spark, rows):
    own = L.train_per_airport(rows, X, "logistic_balanced", max_models=1, size=5)
    assert list(own) == ["A"]
    assert sorted(L.train_per_airport(rows, X, "logistic_balanced", size=3)) == ["A", "B", "C"]
    whole = L.fit(rows, X, "logistic_balanced", 5)
    got = L.score_with_fallback(rows, X, own, whole)
    assert got.count() == rows.count()
    alone = L.score(rows.filter("airport = 'B'"), whole).select("lightning_id", F.col("score").alias("s"))
    assert got.join(alone, "lightning_id").filter("abs(score - s) > 1e-12").count() == 0
    none = L.score_with_fallback(rows, X, own, None).filter("airport != 'A'")
    assert none.filter("score != 0").count() == 0
    assert L.score_with_fallback(rows.drop("x2"), X, {}, whole).count() == rows.count()  # absent column scored as 0


def test_pack_roundtrip(spark, rows, tmp_path):
    model = L.fit(rows, X, "logistic_balanced", 5)
    L.save_pack(str(tmp_path / "p"), model, X, 0.7)
    pack = L.load_pack(spark, str(tmp_path / "p"))
    assert (pack["features"], pack["threshold"], pack["airports"]) == (X, 0.7, None)
    a = L.score(rows, model).select("lightning_id", "score")
    b = L.score_pack(rows, pack).select("lightning_id", "confidence")
    assert a.join(b, "lightning_id").filter("abs(score - confidence) > 1e-12").count() == 0


@pytest.mark.parametrize("tile,k", [(16, 3), (64, 1), (1000, 5), (4, 5)])
def test_nearest_is_exact(spark, tile, k):
    rng = np.random.default_rng(tile)
    # a cloud, a tight lump, and groups of 2 and 30 copies
    v = np.vstack([rng.normal(0, 1, (150, 4)), rng.normal(8, 0.01, (100, 4)), np.ones((30, 4)), np.full((2, 4), 5)]).round(3)
    rng.shuffle(v)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in nearest(df, k, tile).collect():
        got.setdefault(r.id, []).append((r.place, r.nid, r.dist))
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(-1))
    for i in range(len(v)):
        order = sorted((d[i, j], j) for j in range(len(v)) if j != i)[:k]
        mine = sorted(got[i])
        assert [x[2] for x in mine] == pytest.approx([x[0] for x in order], abs=1e-9)
        assert [x[1] for x in mine] == [x[1] for x in order]


def test_smote_points_lie_between_minority_neighbours(rows):
    pts = L.smote_points(rows, X, k=3).toPandas()
    base = rows.filter("y = 1").select("lightning_id", *X).toPandas().set_index("lightning_id")
    n_pos = len(base)
    assert len(pts) == 600 - 2 * n_pos and pts["u"].between(0, 1, inclusive="left").all()
    m = base.to_numpy()
    for r in pts.head(60).itertuples():
        a, b = base.loc[r.base].to_numpy(), base.loc[r.neighbour].to_numpy()
        assert np.allclose(r.v, a + r.u * (b - a))
        dist = np.sqrt(((m - a) ** 2).sum(1))
        assert (dist < np.linalg.norm(a - b) - 1e-12).sum() <= 3  # itself and at most two nearer ones
    again = L.smote_points(rows, X, k=3).toPandas()
    assert set(zip(pts["point"], pts["base"], pts["u"])) == set(zip(again["point"], again["base"], again["u"]))


def test_smote_evens_classes_and_tomek_removes_links(rows):
    even = L.smote(rows, X, k=3)
    assert {r["count"] for r in even.groupBy("y").count().collect()} == {rows.filter("y = 0").count()}
    links = L.tomek_links(even, X)
    assert L.smote_tomek(rows, X, k=3).count() == even.count() - 2 * links.count()


def test_resampled_training(rows):
    from stormlift.operators import metrics as M

    model = L.fit(rows.filter("fold != 0"), X, "gbt_smote", 3, 2)
    assert M.rank_metrics(M.score_table(L.score(rows.filter("fold = 0"), model))).first().auc_roc > 0.7


def test_stack_and_calibration(rows):
    scored = rows.withColumns({"a": F.least(F.greatest(F.col("x0"), F.lit(0.0)), F.lit(1.0)), "b": F.col("x1")})
    out = L.stack(scored, ["a", "b"], iterations=10)
    assert out.count() == rows.count() and out.filter("stacked between 0 and 1").count() == rows.count()
    fitted = L.isotonic(scored.withColumn("score", F.col("a")))
    steps = fitted.transform(scored.select("lightning_id", F.col("a").alias("features"))).orderBy("features").collect()
    assert all(x.prediction <= y.prediction + 1e-12 for x, y in zip(steps, steps[1:]))
    assert L.platt(scored, "a").coefficients[0] > 0


def test_every_configuration_builds():
    for make, weighting, resample in L.CONFIGS.values():
        assert make() is not None and weighting in ("none", "balanced", "scaled") and resample in (None, "smote", "smote_tomek")


def test_share_of_tiles_visited_falls_with_the_table(spark):
    """Boxes on two axes: ten times the points, and a point visits a smaller share of the tiles."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (2000, 20_000):
        rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
        tiled, bounds, names = tiles_of(spark.createDataFrame(rows, "id long, v array<double>"), 64)
        visits = tile_visits(tiled.withColumn("reach", F.lit(2 / n**0.5)), bounds, names).count()
        shares.append(visits / n / bounds.count())
        assert tiled.groupBy("tile").count().agg(F.max("count")).first()[0] <= 64
    assert shares[1] < shares[0] / 4 and shares[0] < 0.3


def test_distances_of_a_tile_are_not_sorted(monkeypatch):
    """The k least of a row are taken one by one, ties to the lower id; an id is never its own neighbour, however often it comes."""
    import numpy as np
    from stormlift.operators import neighbours as N

    rng = np.random.default_rng(3)
    ids, vecs = np.append(rng.permutation(300), [7, 7]), rng.integers(0, 4, (302, 3)).astype(float)
    sort = np.argsort
    monkeypatch.setattr(N.np, "argsort", lambda a, *args, **kw: sort(a, *args, **kw) if np.ndim(a) == 1 else pytest.fail("sorts all distances"))
    got = N._best(ids, vecs, ids, vecs, 4)
    want = []
    for i, v in zip(ids, vecs):
        far = sorted((float(((v - w) ** 2).sum()), j) for j, w in zip(ids, vecs) if j != i)[:4]
        want += [(i, j, d**0.5) for d, j in far]
    assert list(got.itertuples(index=False, name=None)) == want


def test_a_written_vector_is_read_and_changes_nothing(rows, monkeypatch):
    ready = L.materialise(L.assembled(rows, X), "ready", 100)
    assert L.is_assembled(ready, X) and L.is_assembled(ready.filter("fold != 1").withColumn("w", F.lit(1.0)), X)
    assert not L.is_assembled(ready, X[::-1]) and not L.is_assembled(ready, X[:2]) and not L.is_assembled(rows, X)
    plain = L.fit(ready.drop("features"), X, "logistic_balanced", 20)
    want = {r.lightning_id: r.score for r in L.score(rows, plain).collect()}
    monkeypatch.setattr(L.VectorAssembler, "transform", lambda *a: pytest.fail("puts the vector together again"))
    model = L.fit(ready, X, "logistic_balanced", 20)
    assert [m.getNumTrees for m in [L.fit(ready, X, "gbt_v4", 2, 2, stop_fold=1).stages[-1]]] and model.stages[0].getInputCols() == X
    got = {r.lightning_id: r.score for r in L.score(ready, model).collect()}
    assert got == pytest.approx(want, abs=1e-9) and "features" not in L.score(ready, model).columns
    monkeypatch.undo()
    # a vector of other columns, or one left over from columns that a pack replaces, is not taken
    other = L.assembled(rows, X[::-1])
    assert {r.lightning_id: r.score for r in L.score(other, plain).collect()} == pytest.approx(want)
    stale = ready.withColumn("x0", F.lit(0.0))
    pack = {"model": plain, "features": X, "threshold": 0.5, "airports": None}
    a = {r.lightning_id: r.confidence for r in L.score_pack(stale, pack).collect()}
    assert a == pytest.approx({r.lightning_id: r.score for r in L.score(rows.withColumn("x0", F.lit(0.0)), plain).collect()})


def test_early_stop_scans_the_rows_once(rows, monkeypatch):
    seen = []
    fit = L.GBTClassifier.fit

    def watched(self, df, *a):
        seen.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return fit(self, df, *a)

    monkeypatch.setattr(L.GBTClassifier, "fit", watched)
    L.fit(L.materialise(L.assembled(rows, X), "once"), X, "gbt_v4", 2, 2, stop_fold=1)
    assert seen == [1]


def test_fits_side_by_side_hold_a_bounded_number_of_rows(spark):
    assert [L.at_once(spark.range(n), 4) for n in (0, 1000, 8_000_000, 40_000_000)] == [4, 4, 2, 1]


def test_a_training_table_is_written_in_even_files(rows):
    df = L.materialise(rows, "even", 100)
    assert df.count() == rows.count() and max(r["n"] for r in df.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) <= 100


def test_neighbours_leave_points_where_they_lie(spark, monkeypatch):
    """Points are not put in order for their tiles, few copies do not make all points written again, results stay exact."""
    from stormlift.operators import neighbours as N

    rng = np.random.default_rng(9)
    v = np.vstack([rng.normal(size=(500, 3)), np.ones((5, 3))]).round(4)
    df = L.materialise(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>"), "cloud")
    written, write = [], N.materialise
    monkeypatch.setattr(N, "dense_index", lambda *a: pytest.fail("orders all points"))
    monkeypatch.setattr(N, "materialise", lambda out, name, *a: written.append((name, (made := write(out, name, *a)).count())) or made)
    got = {(r.id, r.place): r.nid for r in nearest(df, 2, 32).collect()}
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(-1))
    for i in range(len(v)):
        order = sorted((d[i, j], j) for j in range(len(v)) if j != i)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in order]
    assert sorted(n for n, rows in written if rows > 250) == ["near", "tiles"]


def test_tiles_too_full_for_a_sketch_are_cut_in_order(spark):
    """All points at one place on the first two axes: the order by id still bounds a tile."""
    rows = [(i, [1.0, float(i % 2)]) for i in range(400)]
    tiled, bounds, _ = tiles_of(spark.createDataFrame(rows, "id long, v array<double>"), 16)
    assert tiled.groupBy("tile").count().agg(F.max("count")).first()[0] <= 16 and "_n" not in bounds.columns


def test_a_tile_is_sent_once_for_few_visitors_and_again_for_many(spark, monkeypatch):
    from stormlift.operators import neighbours as N

    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 2))
    df = L.materialise(spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(v)], "id long, v array<double>"), "plane")
    results, sent, write = [], [], N.materialise

    def kept(out, name, *a):
        made = write(out, name, *a)
        if name == "parties":
            sent.append((made.select("tile").distinct().count(), made.select("tile", "party").distinct().count()))
        return made

    monkeypatch.setattr(N, "materialise", kept)
    for party in (1 << 17, 4):
        monkeypatch.setattr(N, "PARTY", party)
        results.append(sorted((r.id, r.place, r.nid) for r in nearest(df, 3, 16).collect()))
    assert results[0] == results[1] and sent[0][0] == sent[0][1] and sent[1][0] < sent[1][1]
