"""Declared schemas and the one normalisation step every strike goes through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlift.functions.scalars import flag, flag_or_false, utc_time

STRIKES = T.StructType(
    [
        T.StructField("lightning_id", T.LongType(), False),
        T.StructField("lightning_airport_id", T.LongType()),
        T.StructField("date", T.TimestampType(), False),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("amplitude", T.DoubleType()),
        T.StructField("maxis", T.DoubleType()),
        T.StructField("icloud", T.BooleanType(), False),
        T.StructField("dist", T.DoubleType()),
        T.StructField("azimuth", T.DoubleType()),
        T.StructField("airport", T.StringType(), False),
        T.StructField("airport_alert_id", T.LongType()),
        T.StructField("is_last_lightning_cloud_ground", T.BooleanType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("airport", T.StringType(), False),
        T.StructField("airport_alert_id", T.LongType(), False),
        T.StructField("prediction_date", T.TimestampType()),
        T.StructField("predicted_date_end_alert", T.TimestampType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Columns an uploaded strike file must bring; the others are filled with null.
REQUIRED = ["date", "airport", "airport_alert_id", "dist", "azimuth", "amplitude", "maxis", "icloud"]

FLAGS = {"icloud", "is_last_lightning_cloud_ground"}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def check_contract(columns: list[str]) -> None:
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"strike input lacks columns: {', '.join(missing)}")


def normalize(raw: DataFrame) -> DataFrame:
    """Cast any strike-shaped input (text or typed) to ``STRIKES``.

    Alert ids written as floats ("12.0") become integers; an unreadable flag counts as CG,
    an unreadable label as no label. Times without a zone are UTC. Rows without a readable date or airport are not strikes.
    """
    check_contract(raw.columns)
    cols = []
    for field in STRIKES:
        name = field.name
        if name not in raw.columns:
            value = F.lit(None)
        elif name == "icloud":
            value = flag_or_false(name)
        elif name in FLAGS:
            value = flag(name)
        elif isinstance(field.dataType, T.LongType):
            as_text = F.col(name).cast("string")
            value = F.coalesce(as_text.try_cast("bigint"), as_text.try_cast("double").try_cast("bigint"))
        elif isinstance(field.dataType, T.StringType):
            value = F.col(name)
        elif isinstance(field.dataType, T.TimestampType):
            value = utc_time(F.col(name), dict(raw.dtypes)[name])
        else:
            value = F.col(name).try_cast(field.dataType)
        cols.append(value.cast(field.dataType).alias(name))
    return raw.select(cols).filter(F.col("date").isNotNull() & F.col("airport").isNotNull())
