import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

T0 = datetime(2024, 6, 1, 12, 0, tzinfo=timezone.utc)
STRIKE_TYPES = (
    "lightning_id long, date timestamp, amplitude double, maxis double, icloud boolean, dist double, azimuth double, "
    "airport string, airport_alert_id long, is_last_lightning_cloud_ground boolean"
)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def strike(no, seconds, airport="A", alert=1, ic=False, dist=10.0, amp=-5.0, last=None):
    return (no, at(seconds), float(amp), 1.0, ic, float(dist), 90.0, airport, alert, last)


@pytest.fixture()
def strikes(spark):
    return lambda *rows: spark.createDataFrame(list(rows), STRIKE_TYPES)


def by_id(df, *cols):
    return {r["lightning_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}
