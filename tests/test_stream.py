import random

import pytest
from conftest import by_id, strike

from stormlift.functions.scalars import HOUR
from stormlift.operators.decide import first_crossing, prediction_rows
from stormlift.operators.features import CONTEXT, V3, features_v3
from stormlift.operators.sessions import sessions
from stormlift.workspace import new_path
from stormlift.plans import replay as R
from stormlift.streaming import flows as S
from stormlift.streaming import live as V
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def storm(spark):
    """Three alerts at two sites over five hours, with ties, shuffled rows and strikes outside alerts."""
    from conftest import STRIKE_TYPES

    rng = random.Random(4)
    rows, no = [], 0
    for airport, alert, start, n in (("A", 1, 0, 60), ("A", 2, 9000, 40), ("B", 1, 600, 50)):
        t = start
        for _ in range(n):
            t += rng.choice([0, 0.25, 30, 90, 600, 1700])
            inside = rng.random() < 0.9
            rows.append(strike(no, t, airport, alert if inside else None, rng.random() < 0.4, round(rng.random() * 30, 2), rng.gauss(0, 9)))
            no += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, STRIKE_TYPES).coalesce(1).cache()  # one file a slice: batches come in time order


replay = R.replay


def test_live_features_equal_batch(storm):
    live = replay(storm, S.live_features, slices=4).toPandas().set_index("lightning_id").sort_index()
    batch = features_v3(storm).toPandas().set_index("lightning_id").sort_index()
    assert len(batch) > 50 and live.index.equals(batch.index)
    for c in S.LIVE_FEATURES:
        a, b = live[c].astype(float), batch[c].astype(float)
        assert (a.isna() == b.isna()).all() and (a - b).abs().max() < 1e-7, c


def test_live_context_equals_batch(storm):
    live = by_id(replay(storm, S.live_context, slices=3), *CONTEXT)
    assert live == by_id(features_v3(storm), *CONTEXT)


def test_each_alert_is_lifted_once(storm):
    out = replay(storm, lambda s: S.live_decisions(s, lambda f: min(1.0, f["dt_prev_s"] / 600)))
    scored = features_v3(storm).withColumn("confidence", F.least(F.lit(1.0), F.col("dt_prev_s") / 600))
    want = first_crossing(prediction_rows(scored)).select("airport", "airport_alert_id", F.unix_micros("predicted_end"))
    assert sorted(map(tuple, out.select("airport", "airport_alert_id", "us").collect())) == sorted(map(tuple, want.collect()))


def test_replayed_strikes_count_once(storm):
    out = replay(storm, S.dedupe, copies=2).filter("lightning_id >= 0")
    assert out.count() == out.select("lightning_id").distinct().count() == storm.count()


def test_live_sessions_equal_batch(storm):
    live = replay(storm, lambda s: S.live_sessions(s, ["airport"])).filter("airport <> ''")
    want = sessions(storm, ["airport"]).select("airport", "start_us", "end_us", "n")
    got = live.select("airport", F.unix_micros("start"), F.unix_micros("end"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tumbling_activity_adds_up(storm):
    out = replay(storm, lambda s: S.live_activity(s, 5, 5)).filter("airport <> ''")
    got = out.agg(F.sum("n_all"), F.sum("n_ic"), F.sum("n_cg")).first()
    ic = storm.filter("icloud").count()
    assert tuple(got) == (storm.count(), ic, storm.count() - ic)


def test_strikes_later_than_the_watermark_are_dropped(spark, strikes):
    first = strikes(strike(1, 0), strike(2, 7200))
    path, _ = R.feed(first, slices=2)
    late = strikes(strike(3, 60))  # written last: the watermark is long past it
    late.write.mode("append").parquet(path)
    out = R.play(path, first, S.live_features)
    assert set(by_id(out, "rank_cg")) == {1, 2}


def test_late_within_the_watermark_is_put_in_order(spark, strikes):
    a, b, far = strikes(strike(1, 300), strike(2, 400)), strikes(strike(3, 100)), strikes(strike(9, 48 * HOUR / 1e6, "Z"))
    path = new_path(spark, "feed")
    for part in (a, b, far):
        part.coalesce(1).write.mode("append").parquet(path)
    out = R.play(path, a, S.live_features)
    assert by_id(out.filter("airport = 'A'"), "rank_cg", "dt_prev_s") == {3: (0, 0.0), 1: (1, 200.0), 2: (2, 100.0)}


def test_full_live_rows_equal_batch(storm):
    live = replay(storm, V.live_rows, slices=4).toPandas().set_index("lightning_id").sort_index()
    batch = features_v3(storm).toPandas().set_index("lightning_id").sort_index()
    assert list(live.columns) == list(batch.columns) and live.index.equals(batch.index)
    for c in V3:
        a, b = live[c].astype(float), batch[c].astype(float)
        assert (a.isna() == b.isna()).all() and (a - b).abs().max() < 1e-7, c
    assert live["is_last_lightning_cloud_ground"].isna().all() and (live["airport_alert_id"] == batch["airport_alert_id"]).all()


def test_a_batch_that_comes_again_decides_nothing_twice(spark, storm):
    scored = features_v3(storm).withColumn("confidence", F.least(F.lit(1.0), F.col("dt_prev_s") / 600))
    want = sorted(map(tuple, first_crossing(prediction_rows(scored), 0.5).select("airport", "airport_alert_id", F.unix_micros("predicted_end")).collect()))
    cut = sorted(r["date"] for r in scored.select("date").collect())[len(want) * 10]
    batches = [scored.filter(F.col("date") <= cut), scored.filter(F.col("date") > cut)]
    ledger = V.Ledger(spark, new_path(spark, "ledger"))
    sink = V.decide_once(ledger, 0.5)
    for n, rows in enumerate(batches):
        ledger.write("decisions", n, rows.selectExpr("lightning_id", "unix_micros(date) us", "airport", "airport_alert_id", "confidence").limit(2))  # a crash after a half-done write
        sink(rows, n)
        sink(rows, n)
    got = sorted(map(tuple, ledger.read("decisions", V.DECISION).select("airport", "airport_alert_id", "us").collect()))
    assert got == want and len(got) > 1


def test_live_decisions_survive_a_restart(spark, storm):
    path, files = R.feed(storm, slices=4)
    ledger, progress = V.Ledger(spark, new_path(spark, "ledger")), new_path(spark, "progress")
    sink, seen = V.decide_once(ledger, 0.5), []

    def scored():
        return V.live_rows(R.source(path, storm, files)).withColumn("confidence", F.least(F.lit(1.0), F.col("dt_prev_s") / 600))

    def breaks(rows, batch):
        seen.append(batch)
        sink(rows, batch)
        if batch == 2:
            raise RuntimeError("lost after the write, before the commit")

    with pytest.raises(Exception, match="lost after the write"):
        V.run_to_end(scored(), breaks, progress)
    V.run_to_end(scored(), lambda rows, batch: (seen.append(batch), sink(rows, batch)), progress)
    assert seen.count(2) == 2
    batch = features_v3(storm).withColumn("confidence", F.least(F.lit(1.0), F.col("dt_prev_s") / 600))
    want = first_crossing(prediction_rows(batch), 0.5).select("airport", "airport_alert_id", F.unix_micros("predicted_end"))
    got = ledger.read("decisions", V.DECISION).select("airport", "airport_alert_id", "us")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_strikes_are_kept_aside(spark, strikes):
    batches = [strikes(strike(1, 0), strike(2, 3000)), strikes(strike(3, 2400), strike(4, 2399), strike(5, 5000)), strikes(strike(6, 4401), strike(7, 4400), strike(8, 10)), strikes()]
    ledger = V.Ledger(spark, new_path(spark, "late"))
    sink = V.late_strikes(ledger)
    for n, rows in enumerate(batches):
        sink(rows, n)
        sink(rows, n)
    late = ledger.read("late", "lightning_id bigint").collect()
    assert sorted(r["lightning_id"] for r in late) == [3, 4, 7, 8]


def test_live_state_has_few_keys(storm, monkeypatch):
    """Sites, not alerts and hours, make the keys of state; results do not hang on how many share one."""
    def played(flow):
        return sorted(map(str, replay(storm, flow, slices=3).collect()))

    few = played(S.live_features), played(S.live_context)
    for parts, slot in ((1, 24 * HOUR), (16, HOUR)):
        monkeypatch.setattr(S, "SITE_PARTS", parts)
        monkeypatch.setattr(S, "CONTEXT_SLOT", slot)
        assert (played(S.live_features), played(S.live_context)) == few
