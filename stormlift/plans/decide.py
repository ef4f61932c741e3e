"""Decision and gain/risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormlift.functions.scalars import decision_label, theta_band
from stormlift.operators import decide as D
from stormlift.operators import evaluate as E
from stormlift.plans.base import query, s6, s6s, shown, sql

THETA_VALUES = "thetas AS (SELECT CAST(i AS DOUBLE) * 5 / 100 AS theta FROM range(20) r(i))"

ORACLE_PREDS = """opreds AS (
  SELECT airport, airport_alert_id, t + (i - 20) * 60000000 AS prediction_us, t + i * 60000000 AS end_us,
         (i + 20) / 40e0 AS confidence
  FROM (SELECT airport, airport_alert_id, max(us) AS t FROM strikes WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2),
       (SELECT unnest(range(-20, 20, 4)) AS i))"""

BASE = """base AS (SELECT airport, airport_alert_id, max(us) + 1800000000 AS baseline_us FROM strikes
  WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2)"""


def curve_ctes(preds: str, tag: str = "", by: str = "", thetas: str = "thetas") -> list[str]:
    """Gain/risk per theta, written as one row per (theta, alert)."""
    cols, cond = (f"{by}, ", f"AND t.{by} = a.{by}") if by else ("", "")
    keys = f"(SELECT DISTINCT {by} FROM strikes) a, {thetas}" if by else thetas
    key_cols = f"a.{by}, theta" if by else "theta"
    join_by = f"USING ({cols}theta)"
    return [
        f"""ends{tag} AS (SELECT theta, airport, airport_alert_id, min(end_us) AS end_us
            FROM {preds}, {thetas} WHERE confidence >= theta GROUP BY 1, 2, 3)""",
        f"""gain{tag} AS (SELECT {cols}theta, sum(baseline_us - end_us) AS gain_us, count(*) AS covered
            FROM ends{tag} JOIN base USING (airport, airport_alert_id) GROUP BY {cols}theta)""",
        f"""miss{tag} AS (SELECT {cols}theta, count(*) AS missed FROM strikes JOIN ends{tag}
            USING (airport, airport_alert_id) WHERE dist < 3 AND us > end_us GROUP BY {cols}theta)""",
        f"""facts{tag} AS (SELECT {key_cols},
              (SELECT count(*) FROM strikes t WHERE dist < 3 {cond}) AS danger,
              (SELECT count(*) FROM base t WHERE true {cond}) AS alerts_total FROM {keys})""",
        f"""curve{tag} AS (SELECT {cols}theta, coalesce(CAST(gain_us AS DOUBLE), 0) / 3.6e9 AS gain_h,
              CASE WHEN danger > 0 THEN coalesce(missed, 0) / CAST(danger AS DOUBLE) ELSE 0 END AS risk,
              coalesce(missed, 0) AS missed, danger, coalesce(covered, 0) AS alerts_covered, alerts_total,
              CASE WHEN covered > 0 THEN CAST(gain_us AS DOUBLE) / 6e7 / covered ELSE 0 END AS gain_min_per_covered,
              CASE WHEN alerts_total > 0 THEN coalesce(CAST(gain_us AS DOUBLE), 0) / 6e7 / alerts_total ELSE 0 END
                AS gain_min_per_alert
            FROM facts{tag} LEFT JOIN gain{tag} {join_by} LEFT JOIN miss{tag} {join_by})""",
    ]


CURVE_COLS = f"{s6s('theta', 'gain_h', 'risk', 'gain_min_per_covered', 'gain_min_per_alert')}, missed, danger, alerts_covered, alerts_total"
CURVE = [THETA_VALUES, BASE, *curve_ctes("preds")]
ONE_THETA = "thetas AS (SELECT 0.85e0 AS theta)"
CROSSED = """crossed AS (SELECT airport, airport_alert_id, min(end_us) AS predicted_end_us FROM preds
  WHERE confidence >= 0.85e0 GROUP BY 1, 2)"""


def curve(t):
    return E.gain_risk_curve(t.strikes(), t.predictions())


@query("prediction_rows", sql("scored", "SELECT airport, airport_alert_id, prediction_us AS prediction_date_us, end_us AS predicted_date_end_alert_us, confidence FROM preds"))
def prediction_rows(t):
    return t.predictions().select(
        "airport",
        "airport_alert_id",
        F.unix_micros("prediction_date").alias("prediction_date_us"),
        F.unix_micros("predicted_date_end_alert").alias("predicted_date_end_alert_us"),
        "confidence",
    )


@query(
    "prediction_summary",
    sql(
        "scored",
        f"""SELECT airport, count(*) AS n_predictions, count(DISTINCT airport_alert_id) AS n_alerts,
            {s6('avg(confidence)', 'score_mean')}, {s6('max(confidence)', 'score_max')} FROM preds GROUP BY 1""",
    ),
)
def prediction_summary(t):
    return shown(
        t.predictions()
        .groupBy("airport")
        .agg(
            F.count("confidence").alias("n_predictions"),
            F.countDistinct("airport_alert_id").alias("n_alerts"),
            F.avg("confidence").alias("score_mean"),
            F.max("confidence").alias("score_max"),
        )
    )


@query(
    "prediction_display",
    sql(
        "scored",
        f"""SELECT lightning_id, strftime(make_timestamp(us), '%H:%M:%S') AS time, {s6s('dist', 'amplitude', 'maxis')},
            {s6('round(s3 * 100, 1)', 'score_pct')}, s3 >= 0.85e0 AS ends_here FROM scored""",
    ),
)
def prediction_display(t):
    return shown(D.prediction_display(t.scored().withColumn("confidence", F.col("s3"))))


@query("first_crossing", sql("scored", "SELECT * FROM crossed", CROSSED))
def first_crossing(t):
    return shown(D.first_crossing(t.predictions()))


@query("baseline_end", sql("strikes", "SELECT * FROM base", BASE))
def baseline_end(t):
    return D.baseline_end(t.strikes())


@query(
    "last_cg",
    sql("strikes", "SELECT airport, airport_alert_id, lightning_id, us AS last_us FROM strikes WHERE is_last"),
)
def last_cg(t):
    return D.last_cg(t.strikes())


@query(
    "oracle_predictions",
    sql("strikes", f"SELECT airport, airport_alert_id, prediction_us AS prediction_date_us, end_us AS predicted_date_end_alert_us, {s6s('confidence')} FROM opreds", ORACLE_PREDS),
)
def oracle_predictions(t):
    return shown(D.oracle_predictions(t.strikes()))


@query("gain_risk_curve", sql("scored", f"SELECT {CURVE_COLS} FROM curve", *CURVE))
def gain_risk_curve(t):
    return shown(curve(t))


@query(
    "gain_per_alert",
    sql("scored", f"SELECT {s6s('theta', 'gain_min_per_covered', 'gain_min_per_alert')} FROM curve", *CURVE),
)
def gain_per_alert(t):
    return shown(curve(t).select("theta", "gain_min_per_covered", "gain_min_per_alert"))


@query(
    "single_theta_report",
    sql(
        "scored",
        f"""SELECT theta, CAST(trunc(gain_h) AS BIGINT) AS hours_saved, {s6('round(risk, 4)', 'risk')}, missed, alerts_covered,
            risk < 0.02e0 AS valid FROM curve""",
        ONE_THETA,
        BASE,
        *curve_ctes("preds"),
    ),
)
def single_theta_report(t):
    return shown(E.single_theta_report(t.strikes(), t.predictions()))


@query(
    "gain_risk_by_airport",
    sql(
        "scored",
        f"SELECT airport, {CURVE_COLS}, risk < 0.02e0 AS valid FROM curve",
        ONE_THETA,
        BASE,
        *curve_ctes("preds", by="airport"),
    ),
)
def gain_risk_by_airport(t):
    return shown(E.gain_risk_by_airport(t.strikes(), t.predictions()))


@query(
    "best_theta",
    sql(
        "scored",
        f"""SELECT coalesce(theta, 0.85e0) AS theta, {s6s('gain_h', 'risk')}, theta IS NOT NULL AS found
            FROM (SELECT 1 AS one) LEFT JOIN (SELECT * FROM curve WHERE risk < 0.02e0 ORDER BY gain_h DESC, theta LIMIT 1) ON true""",
        *CURVE,
    ),
)
def best_theta(t):
    return shown(E.best_theta(curve(t)))


@query(
    "best_theta_oracle",
    sql(
        "strikes",
        f"""SELECT coalesce(theta, 0.85e0) AS theta, {s6s('gain_h', 'risk')}, theta IS NOT NULL AS found
            FROM (SELECT 1 AS one) LEFT JOIN (SELECT * FROM curve WHERE risk < 0.02e0 ORDER BY gain_h DESC, theta LIMIT 1) ON true""",
        THETA_VALUES,
        BASE,
        ORACLE_PREDS,
        *curve_ctes("opreds"),
    ),
)
def best_theta_oracle(t):
    """Best threshold of the look-ahead predictions."""
    strikes = t.strikes()
    return shown(E.best_theta(E.gain_risk_curve(strikes, D.oracle_predictions(strikes))))


@query(
    "curve_comparison",
    sql(
        "scored",
        f"""SELECT c.theta, {s6('c.gain_h', 'ours_gain_h')}, {s6('c.risk * 100', 'ours_risk_pct')},
            c.alerts_covered AS ours_alerts, c.risk < 0.02e0 AS ours_valid, {s6('o.gain_h', 'other_gain_h')},
            {s6('o.risk * 100', 'other_risk_pct')}, o.alerts_covered AS other_alerts, o.risk < 0.02e0 AS other_valid,
            {s6('c.gain_h - o.gain_h', 'delta_gain_h')} FROM curve c JOIN curve_o o ON c.theta = o.theta""",
        *CURVE,
        ORACLE_PREDS,
        *curve_ctes("opreds", "_o"),
    ),
)
def curve_comparison(t):
    strikes = t.strikes()
    ours = E.gain_risk_curve(strikes, t.predictions())
    return shown(E.compare_curves(ours, E.gain_risk_curve(strikes, D.oracle_predictions(strikes))))


@query(
    "missed_strikes",
    sql(
        "scored",
        f"""SELECT lightning_id, airport, airport_alert_id, us AS date_us, {s6s('dist')}, icloud, predicted_end_us
            FROM strikes JOIN crossed USING (airport, airport_alert_id) WHERE dist < 3 AND us > predicted_end_us""",
        CROSSED,
    ),
)
def missed_strikes(t):
    return shown(E.missed_strikes(t.strikes(), t.predictions()))


@query(
    "alerts_covered",
    sql(
        "scored",
        """SELECT DISTINCT airport, airport_alert_id FROM strikes JOIN crossed USING (airport, airport_alert_id)""",
        CROSSED,
    ),
)
def alerts_covered(t):
    return E.alerts_covered(t.strikes(), t.predictions())


@query(
    "unknown_alerts",
    sql(
        "scored",
        """SELECT DISTINCT airport, airport_alert_id + 3 AS airport_alert_id FROM preds
           EXCEPT SELECT airport, airport_alert_id FROM strikes""",
    ),
)
def unknown_alerts(t):
    """Predictions whose alert number was shifted; those that hit no alert are reported."""
    shifted = t.predictions().withColumn("airport_alert_id", F.col("airport_alert_id") + 3)
    return E.unknown_alerts(t.strikes(), shifted)


@query(
    "alert_kpis",
    sql(
        "scored",
        f"""SELECT airport, airport_alert_id, n_cg, {s6s('duration_min', 'score_max')}, n_over, crossing_us,
            {s6('coalesce((last_us + 1800000000 - crossing_us) / 6e7, 0)', 'gain_min')}
            FROM (SELECT airport, airport_alert_id, count(*) AS n_cg, (max(us) - min(us)) / 6e7 AS duration_min,
                         max(confidence) AS score_max, count(*) FILTER (WHERE confidence >= 0.85e0) AS n_over,
                         min(us) FILTER (WHERE confidence >= 0.85e0) AS crossing_us, max(us) AS last_us
                  FROM scored GROUP BY 1, 2)""",
    ),
)
def alert_kpis(t):
    return shown(D.alert_kpis(t.confident()))


@query(
    "alert_trace",
    sql(
        "scored",
        f"""SELECT lightning_id, airport, airport_alert_id, {s6('t_since_start_s / 60', 't_min')}, {s6s('confidence', 'dist')},
            n_cg_5min, CASE WHEN confidence >= 0.85e0 THEN 'LIFT' ELSE 'KEEP' END AS decision, is_last AS is_true_last
            FROM scored""",
    ),
)
def alert_trace(t):
    """Score traces of all alerts; the user interface shows one at a time."""
    return shown(D.alert_trace(t.confident(), F.lit(True)))


@query(
    "k_consecutive",
    sql(
        "scored",
        """SELECT airport, airport_alert_id, min(us) AS lift_us FROM (
             SELECT *, lag(confidence) OVER (PARTITION BY airport, airport_alert_id ORDER BY us, lightning_id) AS before FROM scored)
           WHERE confidence >= 0.85e0 AND before >= 0.85e0 GROUP BY 1, 2""",
    ),
)
def k_consecutive(t):
    return D.k_consecutive(t.confident(), k=2, split=t.split())


@query(
    "decision_label",
    sql(
        "scored",
        """SELECT lightning_id, CASE WHEN confidence >= 0.85e0 THEN 'LIFT' ELSE 'KEEP' END AS decision,
           CASE WHEN s3 >= 0.95e0 THEN 'high' WHEN s3 >= 0.85e0 THEN 'medium' WHEN s3 < 0.7e0 THEN 'low' ELSE 'fair' END AS band
           FROM scored""",
    ),
)
def label(t):
    return t.confident().select(
        "lightning_id",
        decision_label(F.col("confidence"), D.THETA).alias("decision"),
        theta_band(F.col("s3")).alias("band"),
    )
