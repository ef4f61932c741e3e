import math
import random

import pytest

from stormlift.operators import metrics as M


def scored(spark, rows):
    return spark.createDataFrame([(int(y), float(s)) for y, s in rows], "y int, score double")


def brute(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last, best = 0.0, 0.0, None
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        p, r = tp / (tp + fp), tp / len(pos)
        ap, last = ap + (r - last) * p, r
        f1 = 2 * p * r / (p + r + 1e-8)
        if best is None or f1 >= best[0]:
            best = (f1, t)
    return auc, ap, best[1]


@pytest.mark.parametrize("seed", range(3))
def test_rank_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.3, rng.randrange(12) / 12) for _ in range(200)]
    m = M.rank_metrics(M.score_table(scored(spark, rows))).first()
    auc, ap, thr = brute(rows)
    assert (m.auc_roc, m.auc_pr) == (pytest.approx(auc), pytest.approx(ap))
    assert m.best_threshold == thr


def test_tied_scores(spark):
    m = M.rank_metrics(M.score_table(scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)]))).first()
    assert (m.auc_roc, m.auc_pr, m.best_threshold) == (0.5, 0.25, 0.5)


def test_one_class(spark):
    m = M.binary_metrics(scored(spark, [(0, 0.1), (0, 0.9)])).first()
    assert (m.auc_roc, m.auc_pr, m.precision, m.recall, m.f1, m.mcc) == (None, None, 0.0, 0.0, 0.0, 0.0)


def test_confusion(spark):
    m = M.metrics_at(scored(spark, [(1, 0.9), (1, 0.2), (0, 0.9), (0, 0.1), (0, 0.1)]), 0.9).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 2)
    assert m.mcc == pytest.approx((1 * 2 - 1 * 1) / math.sqrt(2 * 2 * 3 * 3))


def test_grid_counts_every_threshold(spark):
    rng = random.Random(9)
    ts = M.grid(100)
    rows = [(rng.random() < 0.4, s) for s in [*ts[::7], 0.0, 1.0, 0.0499, 0.95, 0.9500001, *(rng.random() for _ in range(200))]]
    got = {round(r.threshold, 9): r for r in M.f1_on_grid(scored(spark, rows), 100).collect()}
    assert len(got) == 100
    pos = sum(y for y, _ in rows)
    for t in ts:
        tp, fp = sum(y for y, s in rows if s >= t), sum(not y for y, s in rows if s >= t)
        r = got[round(t, 9)]
        assert r.recall == pytest.approx(tp / pos), t
        assert r.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0), t


def test_grouped_equals_separate(spark):
    rng = random.Random(2)
    rows = [(g, int(rng.random() < 0.3), rng.randrange(20) / 20) for g in "ab" for _ in range(100)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    both = {r.g: r for r in M.binary_metrics(df, ["g"]).collect()}
    for g in "ab":
        alone = M.binary_metrics(df.filter(df.g == g)).first()
        assert both[g].auc_roc == pytest.approx(alone.auc_roc) and both[g].f1 == pytest.approx(alone.f1)


def test_compare_counts_missing_old_scores_as_zero(spark):
    new = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1), (3, 1, 0.8)], "id long, y int, score double")
    old = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id long, score double")
    r = M.oof_compare(old, new, ["id"]).first()
    assert (r.old_auc_roc, r.new_auc_roc) == (0.5, 1.0)
    assert r.delta_f1 > 0
