"""A strike table derived from the ``events`` table (rules in FIXTURES.md).

Event time is compressed 60 times, a user becomes a storm cell, ten cells share an airport,
and a cell's sessions become alerts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlift.functions.geo import east, north
from stormlift.functions.scalars import r6
from stormlift.operators.sessions import with_sessions

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01 UTC
SQUEEZE = 60
USERS_PER_AIRPORT = 10


def event_strikes(events: DataFrame) -> DataFrame:
    """Strikes without alerts; row by row, so it also runs on a stream of events."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    site = F.floor(F.col("user_id") / USERS_PER_AIRPORT)
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.select(
        F.col("event_id").alias("lightning_id"),
        F.timestamp_micros(F.floor((us - ORIGIN_US) / SQUEEZE) + ORIGIN_US).alias("date"),
        (((cents % 8000) - 4000) / 100.0).alias("amplitude"),
        F.col("value").alias("maxis"),
        F.col("event_type").isin("error", "signup").alias("icloud"),
        ((cents % 3000) / 100.0).alias("dist"),
        (F.get_json_object("props", "$.k").cast("bigint") * 18 / 5.0).alias("azimuth"),
        F.format_string("AP%03d", site).alias("airport"),
        "user_id",
    )


def site_point() -> tuple:
    """(lat, lon) of an airport from its number."""
    number = F.substring("airport", 3, 10).cast("bigint")
    return 40 + (number * 37 % 1000) / 100.0, -5 + (number * 61 % 1500) / 100.0


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = site_point()
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    airports = users.select(F.format_string("AP%03d", F.floor(F.col("user_id") / USERS_PER_AIRPORT)).alias("airport"))
    return airports.distinct().select("airport", lat.alias("lat"), lon.alias("lon"))


def with_alerts(strikes: DataFrame) -> DataFrame:
    """Alert ids and labels from the sessions of each cell."""
    cut = with_sessions(strikes, ["user_id"])
    alert = F.when(F.col("session_size") >= 2, F.col("user_id") % USERS_PER_AIRPORT * 1000 + F.col("session"))
    is_last = F.col("lightning_id") == F.col("last_cg.lightning_id")
    lat0, lon0 = site_point()
    rad = F.radians("azimuth")
    return cut.select(
        "lightning_id",
        "date",
        r6(east(lon0, lat0, F.col("dist") * F.sin(rad))).alias("lon"),
        r6(north(lat0, F.col("dist") * F.cos(rad))).alias("lat"),
        "amplitude",
        "maxis",
        "icloud",
        "dist",
        "azimuth",
        "airport",
        alert.alias("airport_alert_id"),
        F.when(alert.isNotNull() & ~F.col("icloud"), is_last).alias("is_last_lightning_cloud_ground"),
    )


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_alerts(event_strikes(spark.read.parquet(f"{sf_dir}/events.parquet")))
