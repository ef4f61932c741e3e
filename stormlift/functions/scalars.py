"""Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE

ALERT = ["airport", "airport_alert_id"]


def micros(date: str | Column) -> Column:
    """Epoch microseconds: every time difference is taken on these integers."""
    return F.unix_micros(date)


def utc_month(us: str) -> Column:
    """The month in UTC of epoch microseconds, whatever the session's time zone."""
    return F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(us) / (24 * HOUR)).cast("int")))


def utc_hour(us: str) -> Column:
    return F.floor(F.pmod(F.col(us), F.lit(24 * HOUR)) / HOUR)


def utc_time(c: Column, kind: str) -> Column:
    """A timestamp from text or a zone-less timestamp, read as UTC where no zone is written; null if unreadable."""
    if kind not in ("string", "timestamp_ntz", "date"):
        return c.try_cast("timestamp")
    text = F.trim(c.cast("string"))
    zoned = text.rlike(r"[0-9]:[0-9]{2}.*([zZ]|[+-][0-9]{1,2}(:?[0-9]{2})?| ?[A-Za-z].*)$")
    whole = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    return F.when(zoned, text.try_cast("timestamp")).otherwise(F.concat(whole, F.lit("Z")).try_cast("timestamp"))


def r6(c: Column | str) -> Column:
    """Six decimals, with -0.0 folded into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def flag(c: Column | str) -> Column:
    """Text or boolean to boolean; null where the text is neither true nor false."""
    return F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")).try_cast("boolean")


def flag_or_false(c: Column | str) -> Column:
    return F.coalesce(flag(c), F.lit(False))


def number_or_zero(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def is_cg() -> Column:
    return ~F.col("icloud")


def in_alert() -> Column:
    return F.col("airport_alert_id").isNotNull()


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def big_sum(c: Column) -> Column:
    """Sum of microseconds that cannot overflow a long, as a double."""
    return F.sum(c.cast("decimal(20,0)")).cast("double")


def decision_label(confidence: Column, theta: float) -> Column:
    return F.when(confidence >= F.lit(theta), "LIFT").otherwise("KEEP")


def theta_band(theta: Column) -> Column:
    """How careful a threshold is. High from 0.95, medium from 0.85, low below 0.70."""
    return F.when(theta >= 0.95, "high").when(theta >= 0.85, "medium").when(theta < 0.70, "low").otherwise("fair")
