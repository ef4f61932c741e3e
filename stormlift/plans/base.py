"""Registry of the named queries, the tables they start from, and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlift.functions.scalars import micros
from stormlift.operators.decide import prediction_rows
from stormlift.operators.features import features_v4, position_features
from stormlift.operators.windows import MAX_GROUP_ROWS, largest_groups
from stormlift.sources import events
from stormlift.workspace import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its independent check, if it has one."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_kept: dict[tuple, object] = {}


class Tables:
    """What the queries read, all derived from the given tables.

    The strike table, and the scored table the metrics start from, are written once per session
    and input, clustered by site and time, as their owners would keep them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def once(self, name: str, make: Callable[[], object]):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived_strikes(self) -> DataFrame:
        return events.strikes(self.spark, self.sf_dir)

    def strikes(self) -> DataFrame:
        def write() -> DataFrame:
            made = self.derived_strikes()
            order = ["airport", "date", "lightning_id"]
            return materialise(made.repartitionByRange(*order).sortWithinPartitions(*order), "strikes")

        return self.once("strikes", write)

    def raw_strikes(self) -> DataFrame:
        return events.event_strikes(self.read("events"))

    def sites(self) -> DataFrame:
        return events.sites(self.spark, self.sf_dir)

    def big(self) -> tuple[bool, bool]:
        """Whether alerts, and site-hours, must be cut; measured once per input."""
        us = micros("date")
        return self.once("big", lambda: largest_groups(self.strikes().withColumn("us", us), MAX_GROUP_ROWS))

    def split(self) -> str:
        return "always" if any(self.big()) else "never"

    def features(self, context: bool = True) -> DataFrame:
        """The V4 table; unused columns and their windows are pruned by the optimizer."""
        return features_v4(self.strikes(), context, self.split())

    def scored_table(self) -> DataFrame:
        """``scored``, written once: the out-of-fold table metrics are computed from."""
        return self.once("scored", lambda: materialise(self.scored(), "scored"))

    def scored(self) -> DataFrame:
        """Labelled CG strikes with the three fixture scores."""
        return position_features(self.strikes(), self.split()).select(
            "lightning_id",
            "date",
            "airport",
            "airport_alert_id",
            "is_last_lightning_cloud_ground",
            F.col("is_last_lightning_cloud_ground").cast("int").alias("y"),
            "dist",
            "amplitude",
            "maxis",
            "t_since_start_s",
            "n_cg_5min",
            F.least(F.lit(1.0), F.col("dt_prev_s") / 600).alias("s1"),
            F.least(F.lit(1.0), F.col("rank_cg") / F.lit(20.0)).alias("s2"),
            (F.col("dist") / 30).alias("s3"),
            F.pmod(F.col("airport_alert_id"), F.lit(5)).cast("bigint").alias("fold"),
        )

    def confident(self) -> DataFrame:
        return self.scored().withColumn("confidence", F.col("s1"))

    def predictions(self) -> DataFrame:
        return prediction_rows(self.confident())


def r6(c: Column | str) -> Column:
    """Six decimals for comparison; the nudge sends exact decimal ties the same way in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-10), 6) + F.lit(0.0)


def shown(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, timestamps to epoch microseconds, integers to bigint."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = r6(c)
        elif kind == "timestamp":
            c, name = F.unix_micros(c), f"{name}_us"
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(cols)


# ---------------------------------------------------------------------------------------------
# SQL side

_STRIKES = """
ev AS (
  SELECT event_id AS lightning_id,
         1704067200000000 + ((epoch_us(ts) - 1704067200000000) // 60) AS us,
         user_id, printf('AP%03d', user_id // 10) AS airport, user_id // 10 AS site,
         CAST(round(value * 100) AS BIGINT) AS cents, value AS maxis,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 18 / 5e0 AS azimuth,
         event_type IN ('error', 'signup') AS icloud
  FROM events),
ev1 AS (
  SELECT *, (cents % 3000) / 100e0 AS dist, ((cents % 8000) - 4000) / 100e0 AS amplitude,
         CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, lightning_id)),
ev2 AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY us, lightning_id
                                  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM ev1),
ev3 AS (
  SELECT *, count(*) OVER (PARTITION BY user_id, session) AS session_size,
         row_number() OVER (PARTITION BY user_id, session, icloud
                            ORDER BY us DESC, lightning_id DESC) AS from_end,
         40 + (site * 37 % 1000) / 100e0 AS lat0, -5 + (site * 61 % 1500) / 100e0 AS lon0
  FROM ev2),
strikes AS (
  SELECT lightning_id, us, airport, dist, azimuth, amplitude, maxis, icloud,
         CASE WHEN session_size >= 2 THEN (user_id % 10) * 1000 + session END AS airport_alert_id,
         CASE WHEN session_size >= 2 AND NOT icloud THEN from_end = 1 END AS is_last,
         round(lat0 + dist * cos(radians(azimuth)) / 111e0, 6) + 0e0 AS lat,
         round(lon0 + dist * sin(radians(azimuth)) / (111e0 * cos(radians(lat0))), 6) + 0e0 AS lon
  FROM ev3)"""

_CG = """
cg AS (
  SELECT *, row_number() OVER wa - 1 AS rank_cg,
         min(us) OVER (PARTITION BY airport, airport_alert_id) AS start_us,
         (us - min(us) OVER (PARTITION BY airport, airport_alert_id)) / 1e6 AS t_since_start_s,
         coalesce((us - lag(us) OVER wa) / 1e6, 0e0) AS dt_prev_s,
         abs(amplitude) AS amp_abs, CAST(sign(amplitude) AS DOUBLE) AS amp_sign
  FROM strikes WHERE airport_alert_id IS NOT NULL AND NOT icloud
  WINDOW wa AS (PARTITION BY airport, airport_alert_id ORDER BY us, lightning_id))"""

_DENSITY = (
    """
dens AS (
  SELECT lightning_id AS did, """
    + ", ".join(
        f"""count(*) OVER (PARTITION BY airport, airport_alert_id ORDER BY us
            RANGE BETWEEN {m * 60_000_000} PRECEDING AND CURRENT ROW)
         - (count(*) OVER (PARTITION BY airport, airport_alert_id, us)
            - row_number() OVER (PARTITION BY airport, airport_alert_id, us ORDER BY lightning_id)) AS n_cg_{m}min"""
        for m in (2, 5, 10, 15, 30)
    )
    + " FROM cg)"
)

_SCORED = """
scored AS (
  SELECT cg.*, CAST(is_last AS BIGINT) AS y, least(1e0, dt_prev_s / 600) AS s1,
         least(1e0, rank_cg / 20e0) AS s2, dist / 30 AS s3, airport_alert_id % 5 AS fold,
         least(1e0, dt_prev_s / 600) AS confidence, n_cg_5min
  FROM cg JOIN dens ON did = lightning_id),
preds AS (
  SELECT airport, airport_alert_id, us AS prediction_us, us AS end_us, confidence FROM scored)"""

_CTX = (
    """
ctx AS (
  SELECT lightning_id AS cid, """
    + ", ".join(
        f"""count(*) FILTER (WHERE icloud) OVER (PARTITION BY airport ORDER BY us
            RANGE BETWEEN {m * 60_000_000} PRECEDING AND CURRENT ROW) AS n_ic_{m}min"""
        for m in (2, 5, 10, 30)
    )
    + ", "
    + ", ".join(
        f"""count(*) OVER (PARTITION BY airport ORDER BY us
            RANGE BETWEEN {m * 60_000_000} PRECEDING AND CURRENT ROW) AS n_all_{m}min"""
        for m in (2, 5, 10)
    )
    + " FROM strikes)"
)


def _frame(expr: str, n: int) -> str:
    return f"{expr} OVER (PARTITION BY airport, airport_alert_id ORDER BY us, lightning_id ROWS {n - 1} PRECEDING)"


def _rolling() -> str:
    out = []
    for n in (3, 5, 10, 15, 20):
        two = _frame("count(*)", n) + " >= 2"
        a = 2 / (n + 1)
        out += [
            f"{_frame('avg(dt_prev_s)', n)} AS dt_mean_{n}",
            f"{_frame('max(dt_prev_s)', n)} AS dt_max_{n}",
            f"coalesce({_frame('stddev_samp(dt_prev_s)', n)}, 0) AS dt_std_{n}",
            f"list_reduce(list(dt_prev_s) OVER (PARTITION BY airport, airport_alert_id ORDER BY us, lightning_id "
            f"ROWS UNBOUNDED PRECEDING), lambda a, b: a * {1 - a!r}e0 + b * {a!r}e0) AS dt_ema_{n}",
            f"{_frame('avg(dist)', n)} AS dist_mean_{n}",
            f"CASE WHEN {two} THEN {_frame('regr_slope(dist, rank_cg)', n)} END AS dist_trend_{n}",
            f"{_frame('avg(amp_abs)', n)} AS amp_mean_{n}",
            f"CASE WHEN {two} THEN {_frame('regr_slope(amp_abs, rank_cg)', n)} END AS amp_trend_{n}",
        ]
    return ", ".join(out)


_FEAT = (
    """
rolled AS (
  SELECT *, """
    + _rolling()
    + """,
         coalesce(dt_prev_s - lag(dt_prev_s) OVER wa, 0) AS dt_accel,
         coalesce(dist - lag(dist, 3) OVER wa, 0) AS dist_momentum
  FROM cg WINDOW wa AS (PARTITION BY airport, airport_alert_id ORDER BY us, lightning_id)),
feat AS (
  SELECT r.*, d.*, c.*,
         n_cg_5min / (n_cg_10min + 1e0) AS rate_decline_cg,
         n_ic_5min / (n_cg_5min + 1e0) AS ratio_ic_cg_5min,
         n_ic_10min / (n_cg_10min + 1e0) AS ratio_ic_cg_10min,
         n_ic_5min - n_ic_10min / 2e0 AS ic_trend,
         n_all_5min AS total_activity,
         n_all_5min / (n_all_10min + 1e0) AS activity_decline,
         month(make_timestamp(us)) AS month, hour(make_timestamp(us)) AS hour,
         n_cg_10min / (n_cg_30min + 1e0) AS rate_decline_cg_long,
         n_ic_5min / (n_ic_30min + 1e0) AS rate_decline_ic,
         n_ic_30min / (n_cg_30min + 1e0) AS ratio_ic_cg_30min,
         dt_prev_s / (dt_mean_10 + 1) * (1 / (n_cg_5min + 1e0)) * (n_ic_10min / (n_cg_10min + 1e0)) AS composite_decline,
         dt_prev_s / (t_since_start_s / (rank_cg + 1) + 1) AS dt_relative
  FROM rolled r JOIN dens d ON d.did = r.lightning_id JOIN ctx c ON c.cid = r.lightning_id)"""
)

_LEVELS = {
    "strikes": [_STRIKES],
    "cg": [_STRIKES, _CG],
    "dens": [_STRIKES, _CG, _DENSITY],
    "ctx": [_STRIKES, _CTX],
    "scored": [_STRIKES, _CG, _DENSITY, _SCORED],
    "feat": [_STRIKES, _CG, _DENSITY, _CTX, _FEAT],
    "scored_feat": [_STRIKES, _CG, _DENSITY, _SCORED, _CTX, _FEAT],
}


def sql(level: str, body: str, *more: str) -> str:
    """``body`` over the derived tables up to ``level``; ``more`` are further WITH entries."""
    return "WITH " + ",\n".join([*_LEVELS[level], *more]) + "\n" + body


def s6(expr: str, name: str | None = None) -> str:
    """SQL twin of ``r6``."""
    return f"round({expr} + 1e-10, 6) + 0e0 AS {name or expr}"


def s6s(*names: str) -> str:
    return ", ".join(s6(n) for n in names)
