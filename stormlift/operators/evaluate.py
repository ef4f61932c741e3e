"""Gain against risk: hours saved over the fixed rule, and dangerous strikes after the lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlift.functions.scalars import ALERT, HOUR, MINUTE, big_sum, in_alert, micros
from stormlift.operators.decide import THETA, baseline_end, first_crossing

THETAS = [round(i * 0.05, 2) for i in range(20)]
MAX_RISK = 0.02
RADIUS_KM = 3.0


def alert_ends(preds: DataFrame, thetas: list[float]) -> DataFrame:
    """Per alert one predicted end (microseconds) per theta, in one aggregate: ``e0, e1, ...``."""
    end = micros("predicted_date_end_alert")
    return preds.groupBy(*ALERT).agg(
        *[F.min(F.when(F.col("confidence") >= t, end)).alias(f"e{k}") for k, t in enumerate(thetas)]
    )


def _tall(wide: DataFrame, thetas: list[float], names: list[str], by: list[str]) -> DataFrame:
    """Columns ``{name}{k}`` to one row per theta."""
    rows = [F.struct(F.lit(t).alias("theta"), *[F.col(f"{n}{k}").alias(n) for n in names]) for k, t in enumerate(thetas)]
    return wide.select(*by, F.inline(F.array(*rows)))


def gain_risk_curve(
    strikes: DataFrame,
    preds: DataFrame,
    thetas: list[float] = THETAS,
    by: list[str] = (),
    gap_min: int = 30,
    radius_km: float = RADIUS_KM,
    strike_scope: str = "all",
) -> DataFrame:
    """Gain, missed strikes, risk and coverage for every theta, in one plan.

    The thetas are columns, not copies of rows: one aggregate finds all ends of an alert, one
    join with the dangerous strikes counts all misses. Predictions for alerts absent from
    ``strikes`` are skipped. ``by`` may be ``["airport"]``; every airport is kept.
    """
    by = list(by)
    n = range(len(thetas))
    ends = alert_ends(preds, thetas)
    lifted = baseline_end(strikes, gap_min, strike_scope).join(ends, ALERT, "left")
    gains = lifted.groupBy(*by).agg(
        *[big_sum(F.col("baseline_us") - F.col(f"e{k}")).alias(f"gain{k}") for k in n],
        *[F.count(f"e{k}").alias(f"covered{k}") for k in n],
        *[F.count(F.lit(1)).alias(f"alerts{k}") for k in n],
    )
    danger = strikes.filter(F.col("dist") < radius_km).select(*ALERT, micros("date").alias("us"))
    misses = (
        danger.filter(in_alert())
        .join(ends, ALERT)
        .groupBy(*by)
        .agg(*[F.count_if(F.col("us") > F.col(f"e{k}")).alias(f"missed{k}") for k in n])
    )
    total = strikes.groupBy(*by).agg(
        *[F.count_if(F.col("dist") < radius_km).alias(f"danger{k}") for k in n]
    )
    parts = [
        _tall(gains, thetas, ["gain", "covered", "alerts"], by),
        _tall(misses, thetas, ["missed"], by),
        _tall(total, thetas, ["danger"], by),
    ]
    rows = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    facts = rows.groupBy(*by, "theta").agg(
        F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("missed", "danger", "covered", "alerts")],
    )

    def safe(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(F.lit(0.0))

    return facts.select(
        *by,
        "theta",
        (F.col("gain") / HOUR).alias("gain_h"),
        safe(F.col("missed"), "danger").alias("risk"),
        "missed",
        "danger",
        F.col("covered").alias("alerts_covered"),
        F.col("alerts").alias("alerts_total"),
        safe(F.col("gain") / MINUTE, "covered").alias("gain_min_per_covered"),
        safe(F.col("gain") / MINUTE, "alerts").alias("gain_min_per_alert"),
    )


def best_theta(curve: DataFrame, max_risk: float = MAX_RISK, default: float = THETA) -> DataFrame:
    """The lowest theta of largest gain with risk below ``max_risk``; ``default`` if there is none."""
    pick = F.max_by(
        F.struct("theta", "gain_h", "risk"), F.when(F.col("risk") < max_risk, F.struct("gain_h", -F.col("theta")))
    )
    best = curve.agg(pick.alias("b"))
    return best.select(
        F.coalesce("b.theta", F.lit(float(default))).alias("theta"),
        F.col("b.gain_h").alias("gain_h"),
        F.col("b.risk").alias("risk"),
        F.col("b.theta").isNotNull().alias("found"),
    )


def compare_curves(ours: DataFrame, other: DataFrame, max_risk: float = MAX_RISK) -> DataFrame:
    """Two curves side by side: validity and the difference in gain."""

    def side(curve: DataFrame, tag: str) -> DataFrame:
        return curve.select(
            "theta",
            F.col("gain_h").alias(f"{tag}_gain_h"),
            (F.col("risk") * 100).alias(f"{tag}_risk_pct"),
            F.col("alerts_covered").alias(f"{tag}_alerts"),
            (F.col("risk") < max_risk).alias(f"{tag}_valid"),
        )

    both = side(ours, "ours").join(side(other, "other"), "theta")
    return both.withColumn("delta_gain_h", F.col("ours_gain_h") - F.col("other_gain_h"))


def single_theta_report(strikes: DataFrame, preds: DataFrame, theta: float = THETA, **kw) -> DataFrame:
    """Whole hours saved and the risk at one theta."""
    curve = gain_risk_curve(strikes, preds, [theta], **kw)
    return curve.select(
        "theta",
        F.col("gain_h").cast("bigint").alias("hours_saved"),
        F.round("risk", 4).alias("risk"),
        "missed",
        "alerts_covered",
        (F.col("risk") < MAX_RISK).alias("valid"),
    )


def gain_risk_by_airport(strikes: DataFrame, preds: DataFrame, theta: float = THETA, **kw) -> DataFrame:
    curve = gain_risk_curve(strikes, preds, [theta], by=["airport"], **kw)
    return curve.withColumn("valid", F.col("risk") < MAX_RISK)


def unknown_alerts(strikes: DataFrame, preds: DataFrame) -> DataFrame:
    """Alerts that have predictions but no strikes."""
    known = strikes.filter(in_alert()).select(*ALERT).distinct()
    return preds.select(*ALERT).distinct().join(known, ALERT, "left_anti")


def alerts_covered(strikes: DataFrame, preds: DataFrame, theta: float = THETA) -> DataFrame:
    """Alerts of the strike table for which some prediction passes theta."""
    alerts = strikes.filter(in_alert()).select(*ALERT).distinct()
    return alerts.join(first_crossing(preds, theta), ALERT, "left_semi")


def missed_strikes(strikes: DataFrame, preds: DataFrame, theta: float = THETA, radius_km: float = RADIUS_KM) -> DataFrame:
    """Dangerous strikes (CG and IC) after the predicted end of their alert."""
    late = F.col("date") > F.col("predicted_end")
    return (
        strikes.filter(in_alert() & (F.col("dist") < radius_km))
        .join(first_crossing(preds, theta), ALERT)
        .filter(late)
        .select("lightning_id", *ALERT, "date", "dist", "icloud", "predicted_end")
    )
