"""Cutting a site's strikes into alerts: a gap longer than 30 minutes opens a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlift.functions.scalars import MINUTE, micros


def session_slots(strikes: DataFrame, by: list[str], gap_us: int = 30 * MINUTE) -> DataFrame:
    """One row per (site, slot) with its session number and the session's facts.

    Two strikes inside a slot as long as the gap always share a session, so only the first and
    last strike of each slot matter. The window runs over slots, of which a site has at most
    17,532 a year, however many strikes it has.
    """
    us = micros("date")
    slots = strikes.groupBy(*by, F.floor(us / F.lit(gap_us)).alias("slot")).agg(
        F.min(us).alias("lo"),
        F.max(us).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(~F.col("icloud"), F.struct(us.alias("us"), "lightning_id"))).alias("cg"),
    )
    along = Window.partitionBy(*by).orderBy("slot")
    opens = F.coalesce((F.col("lo") - F.lag("hi").over(along) > gap_us).cast("long"), F.lit(1))
    slots = slots.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(along))
    whole = Window.partitionBy(*by, "session")
    return slots.select(
        *by,
        "slot",
        "session",
        F.min("lo").over(whole).alias("session_start"),
        F.max("hi").over(whole).alias("session_end"),
        F.sum("n").over(whole).alias("session_size"),
        F.max("cg").over(whole).alias("last_cg"),
    )


def with_sessions(strikes: DataFrame, by: list[str], gap_us: int = 30 * MINUTE) -> DataFrame:
    """Every strike with ``session`` (1, 2, ... per site), its start, end, size and last CG strike."""
    slot = F.floor(micros("date") / F.lit(gap_us))
    return strikes.withColumn("slot", slot).join(session_slots(strikes, by, gap_us), [*by, "slot"]).drop("slot")


def sessions(strikes: DataFrame, by: list[str], gap_us: int = 30 * MINUTE) -> DataFrame:
    """One row per session."""
    return (
        session_slots(strikes, by, gap_us)
        .groupBy(*by, "session")
        .agg(
            F.first("session_start").alias("start_us"),
            F.first("session_end").alias("end_us"),
            F.first("session_size").alias("n"),
        )
    )
