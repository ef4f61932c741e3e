"""From scores to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlift.functions.scalars import ALERT, MINUTE, decision_label, in_alert, is_cg, micros
from stormlift.operators.windows import MAX_GROUP_ROWS, ROW, must_cut, place

THETA = 0.85


def prediction_rows(scored: DataFrame) -> DataFrame:
    """One prediction per scored CG strike; the alert would end at that strike."""
    return scored.select(
        *ALERT,
        F.col("date").alias("prediction_date"),
        F.col("date").alias("predicted_date_end_alert"),
        "confidence",
    )


def first_crossing(preds: DataFrame, theta: float = THETA) -> DataFrame:
    """Earliest predicted end per alert among predictions with confidence >= theta."""
    passed = preds.filter(F.col("confidence") >= theta)
    return passed.groupBy(*ALERT).agg(F.min("predicted_date_end_alert").alias("predicted_end"))


def k_consecutive(
    scored: DataFrame, theta: float = THETA, k: int = 2, split: str = "auto", split_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """First strike of each alert that closes ``k`` scores in a row >= theta."""
    slim = scored.select("lightning_id", *ALERT, micros("date").alias("us"), "confidence")
    placed, blocks = place(slim, must_cut(slim, split, split_rows)[0], split_rows, k)
    w = Window.partitionBy(*ALERT, *blocks).orderBy(*ROW)
    run = F.sum((F.col("confidence") >= theta).cast("int")).over(w.rowsBetween(-(k - 1), 0))
    hits = placed.withColumn("_run", run).filter((F.col("_run") == k) & ~F.col("_halo"))
    return hits.groupBy(*ALERT).agg(F.min("us").alias("lift_us"))


def baseline_end(strikes: DataFrame, gap_min: int = 30, scope: str = "all") -> DataFrame:
    """Last strike of each alert plus the fixed waiting time, as epoch microseconds."""
    rows = strikes.filter(in_alert())
    if scope == "cg":
        rows = rows.filter(is_cg())
    elif scope != "all":
        raise ValueError(f"scope must be all or cg, not {scope}")
    return rows.groupBy(*ALERT).agg((F.max(micros("date")) + gap_min * MINUTE).alias("baseline_us"))


def oracle_predictions(strikes: DataFrame) -> DataFrame:
    """Ten predictions per alert around its true last strike; confidence grows with lateness."""
    last = strikes.filter(in_alert()).groupBy(*ALERT).agg(F.max(micros("date")).alias("_t"))
    spread = last.select("*", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(-20, 20, 4)])).alias("_i"))
    return spread.select(
        *ALERT,
        F.timestamp_micros(F.col("_t") + (F.col("_i") - 20) * MINUTE).alias("prediction_date"),
        F.timestamp_micros(F.col("_t") + F.col("_i") * MINUTE).alias("predicted_date_end_alert"),
        ((F.col("_i") + 20) / 40).alias("confidence"),
    )


def clock(date: str) -> Column:
    """HH:MM:SS in UTC, whatever the session's time zone."""
    second = F.pmod(F.floor(micros(date) / 1_000_000), F.lit(86_400))
    return F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(F.pmod(second, F.lit(3600)) / 60), F.pmod(second, F.lit(60)))


def prediction_display(scored: DataFrame, theta: float = THETA) -> DataFrame:
    """The detail table: clock time, rounded score and the threshold flag."""
    return scored.select(
        "lightning_id",
        clock("date").alias("time"),
        F.round("dist", 2).alias("dist"),
        "amplitude",
        "maxis",
        F.round(F.col("confidence") * 100, 1).alias("score_pct"),
        (F.col("confidence") >= theta).alias("ends_here"),
    )


def alert_kpis(scored: DataFrame, theta: float = THETA, gap_min: int = 30) -> DataFrame:
    """Per alert: strikes, duration, best score, strikes over theta, first crossing, gain in minutes.

    Here the gain counts from the last CG strike, and is 0 where no score reaches theta.
    """
    us = micros("date")
    over = F.col("confidence") >= theta
    kpis = scored.groupBy(*ALERT).agg(
        F.count(F.lit(1)).alias("n_cg"),
        ((F.max(us) - F.min(us)) / MINUTE).alias("duration_min"),
        F.max("confidence").alias("score_max"),
        F.count_if(over).alias("n_over"),
        F.min(F.when(over, us)).alias("crossing_us"),
        F.max(us).alias("_last"),
    )
    gain = (F.col("_last") + gap_min * MINUTE - F.col("crossing_us")) / MINUTE
    return kpis.withColumn("gain_min", F.coalesce(gain, F.lit(0.0))).drop("_last")


def alert_trace(scored: DataFrame, one: Column, theta: float = THETA) -> DataFrame:
    """Chart rows of the alerts picked by ``one``: minutes, score, distance, density, decision."""
    rows = scored.filter(one)
    return rows.select(
        "lightning_id",
        *ALERT,
        (F.col("t_since_start_s") / 60).alias("t_min"),
        "confidence",
        "dist",
        "n_cg_5min",
        decision_label(F.col("confidence"), theta).alias("decision"),
        F.coalesce("is_last_lightning_cloud_ground", F.lit(False)).alias("is_true_last"),
    )


def last_cg(strikes: DataFrame) -> DataFrame:
    """Last CG strike of each alert."""
    newest = F.max(F.struct(micros("date").alias("us"), "lightning_id"))
    return (
        strikes.filter(in_alert() & is_cg())
        .groupBy(*ALERT)
        .agg(newest.alias("_last"))
        .select(*ALERT, F.col("_last.lightning_id").alias("lightning_id"), F.col("_last.us").alias("last_us"))
    )
