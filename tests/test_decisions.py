import numpy as np
import pytest
from conftest import at, by_id, strike
from pyspark.sql import functions as F

from stormlift.operators import decide as D
from stormlift.operators import evaluate as E
from stormlift.operators import explore as X
from stormlift.operators.sessions import sessions

PRED = "airport string, airport_alert_id long, prediction_date timestamp, predicted_date_end_alert timestamp, confidence double"


@pytest.fixture()
def preds(spark):
    def make(*rows):
        return spark.createDataFrame([(a, i, at(t), at(t), float(c)) for a, i, t, c in rows], PRED)

    return make


def report(strikes, preds, theta=0.85, **kw):
    return E.gain_risk_curve(strikes, preds, [theta], **kw).first()


def test_gain_missed_risk(strikes, preds):
    s = strikes(strike(1, 0, dist=2), strike(2, 60, dist=2.9, ic=True), strike(3, 120, dist=3.0), strike(4, 500, alert=None, dist=1))
    r = report(s, preds(("A", 1, 0, 0.85), ("A", 1, 60, 0.99)))
    assert r.gain_h == pytest.approx((120 + 1800) / 3600)
    assert (r.missed, r.danger, r.alerts_covered, r.alerts_total) == (1, 3, 1, 1)  # 3 km is not dangerous
    assert r.risk == pytest.approx(1 / 3)


def test_strike_at_the_predicted_end_is_not_missed(strikes, preds):
    assert report(strikes(strike(1, 0, dist=1), strike(2, 9, dist=1)), preds(("A", 1, 9, 0.9))).missed == 0


def test_no_crossing_and_no_danger(strikes, preds):
    r = report(strikes(strike(1, 0)), preds(("A", 1, 0, 0.8499)))
    assert (r.gain_h, r.missed, r.risk, r.alerts_covered, r.gain_min_per_covered) == (0, 0, 0, 0, 0)


def test_negative_gain_is_kept(strikes, preds):
    assert report(strikes(strike(1, 0)), preds(("A", 1, 5400, 0.9))).gain_h == pytest.approx(-1.0)


def test_unknown_alerts_are_skipped_and_listed(strikes, preds):
    s, p = strikes(strike(1, 0)), preds(("A", 2, 0, 0.9), ("B", 1, 0, 0.9))
    assert report(s, p).alerts_covered == 0
    assert {(r.airport, r.airport_alert_id) for r in E.unknown_alerts(s, p).collect()} == {("A", 2), ("B", 1)}


def test_ic_only_alert_and_scope(strikes, preds):
    s = strikes(strike(1, 0), strike(2, 60, ic=True), strike(3, 0, alert=2, ic=True))
    assert {r.airport_alert_id: r.baseline_us for r in D.baseline_end(s).collect()}.keys() == {1, 2}
    assert report(s, preds(("A", 1, 0, 0.9))).gain_h == pytest.approx(1860 / 3600)
    assert report(s, preds(("A", 1, 0, 0.9)), strike_scope="cg").gain_h == pytest.approx(0.5)
    with pytest.raises(ValueError, match="scope"):
        D.baseline_end(s, scope="ic")


def test_every_airport_is_reported(strikes, preds):
    s = strikes(strike(1, 0, dist=1), strike(2, 0, "B", dist=1), strike(3, 0, "C", None, dist=9))
    got = {r.airport: (r.alerts_covered, r.alerts_total, r.danger) for r in E.gain_risk_by_airport(s, preds(("A", 1, 0, 0.9))).collect()}
    assert got == {"A": (1, 1, 1), "B": (0, 1, 1), "C": (0, 0, 0)}


def test_best_theta_rules(spark):
    cols = "theta double, gain_h double, risk double"
    pick = lambda *rows: E.best_theta(spark.createDataFrame(list(rows), cols)).first()
    assert pick((0.5, 9.0, 0.02), (0.6, 5.0, 0.019), (0.7, 5.0, 0.0)).theta == 0.6  # 0.02 is not valid; ties go low
    none = pick((0.5, 9.0, 0.5))
    assert (none.theta, none.found, none.gain_h) == (0.85, False, None)


def test_gain_and_missed_fall_as_theta_rises(strikes, preds):
    s = strikes(*[strike(i, i * 60, dist=i % 5) for i in range(30)])
    curve = E.gain_risk_curve(s, preds(*[("A", 1, i * 60, (i * 7 % 30) / 30) for i in range(30)])).orderBy("theta").collect()
    for a, b in zip(curve, curve[1:], strict=False):
        assert b.gain_h <= a.gain_h and b.missed <= a.missed


def test_oracle_predictions(strikes):
    got = D.oracle_predictions(strikes(strike(1, 0), strike(2, 600, ic=True))).orderBy("confidence").collect()
    assert [round(r.confidence, 2) for r in got] == [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    assert got[5].predicted_date_end_alert == at(600).replace(tzinfo=None)
    assert got[5].prediction_date == at(600 - 1200).replace(tzinfo=None)


def test_k_consecutive_also_in_blocks(spark):
    rows = [(i, "A", 1, at(i), c) for i, c in enumerate([0.9, 0.1, 0.9, 0.9, 0.9, 0.1])]
    df = spark.createDataFrame(rows, "lightning_id long, airport string, airport_alert_id long, date timestamp, confidence double")
    want = int(at(4).timestamp() * 1e6)
    assert [r.lift_us for r in D.k_consecutive(df, k=3).collect()] == [want]
    assert [r.lift_us for r in D.k_consecutive(df, k=3, split="always", split_rows=3).collect()] == [want]


def test_alert_kpis(spark):
    rows = [(1, "A", 1, at(0), 0.2), (2, "A", 1, at(120), 0.9), (3, "A", 2, at(0), 0.1)]
    df = spark.createDataFrame(rows, "lightning_id long, airport string, airport_alert_id long, date timestamp, confidence double")
    got = {r.airport_alert_id: (r.n_cg, r.duration_min, r.n_over, r.gain_min) for r in D.alert_kpis(df).collect()}
    assert got == {1: (2, 2.0, 1, 30.0), 2: (1, 0.0, 0, 0.0)}


def test_sessions_split_above_thirty_minutes(strikes):
    s = strikes(strike(1, 0), strike(2, 1800), strike(3, 3600.000001), strike(4, 3600.000001, "B"), strike(5, 7300))
    got = [(r.airport, r.session, r.n) for r in sessions(s, ["airport"]).orderBy("airport", "session").collect()]
    assert got == [("A", 1, 2), ("A", 2, 1), ("A", 3, 1), ("B", 1, 1)]


def test_null_ids_stay_out_of_alert_tables(strikes):
    s = strikes(strike(1, 0), strike(2, 1, alert=None), strike(3, 2, "B", None))
    assert [(r.airport, r.n_strikes) for r in X.alert_overview(s).collect()] == [("A", 1)]
    over = {r.airport: (r.n_strikes, r.n_alerts) for r in X.airport_overview(s).collect()}
    assert over == {"A": (2, 1), "B": (1, None)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "v double")
    got = {r.bin: (r.n, r.density) for r in X.histogram(df, F.col("v"), 4).collect()}
    assert got == {0: (1, 1 / 6), 1: (1, 1 / 6), 2: (1, 1 / 6), 3: (3, 0.5)}
    flat = X.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), F.col("v"), 2).collect()
    assert [(r.bin, r.n) for r in flat] == [(1, 3)]


def test_temporal_split_and_numbering(strikes):
    s = strikes(strike(1, 0), strike(2, 10), strike(3, 5, "B"))
    cut = X.temporal_split(s, F.col("date") <= F.lit(at(5)))
    assert by_id(cut, "part") == {1: "train", 2: "eval", 3: "train"}
    assert by_id(X.numbered_per_airport(s), "lightning_airport_id") == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 11, 40, 400, 30_000])
def test_describe_equals_numpy(spark, n):
    """Ties, nulls, a constant and an empty column; small tables and one whose brackets are narrow."""
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), np.floor(rng.exponential(3, size=n))
    rows = [(float(x), float(y), None, 7, float(x) if i % 3 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    got = {r["column"]: r for r in X.describe(spark.createDataFrame(rows, "a double, b double, c double, d int, e double"), list("abcde")).collect()}
    for c, v in {"a": a, "b": b, "c": a[:0], "d": np.full(n, 7.0), "e": a[np.arange(n) % 3 > 0]}.items():
        assert got[c]["count"] == len(v)
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert got[c][q] is None if not len(v) else got[c][q] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
