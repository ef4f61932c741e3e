"""Flat-earth geometry around a site: 111 km per degree, longitude scaled by cos(latitude)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0


def north(lat0: Column, km: Column) -> Column:
    return lat0 + km / KM_PER_DEGREE


def east(lon0: Column, lat0: Column, km: Column) -> Column:
    return lon0 + km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat0)))


def rings(sites: DataFrame, radii_km: list[float], points: int = 100) -> DataFrame:
    """Points of a circle around each site, first and last point the same."""
    angle = F.col("i") * F.lit(2 * math.pi / (points - 1))
    r = F.col("radius_km")
    spread = (
        sites.select("*", F.explode(F.array(*[F.lit(float(x)) for x in radii_km])).alias("radius_km"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    )
    return spread.select(
        "airport",
        "radius_km",
        F.col("i").cast("bigint").alias("point"),
        east(F.col("lon"), F.col("lat"), r * F.cos(angle)).alias("lon"),
        north(F.col("lat"), r * F.sin(angle)).alias("lat"),
    )
