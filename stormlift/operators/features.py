"""The causal feature table: one row per CG strike of an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlift.functions.scalars import ALERT, flag, in_alert, is_cg, micros, number_or_zero, utc_hour, utc_month
from stormlift.operators.ordered import dense_index
from stormlift.operators.windows import (
    ALL_MINUTES,
    CG_MINUTES,
    IC_MINUTES,
    MAX_GROUP_ROWS,
    NUMBER,
    cg_density,
    context_counts,
    ema,
    ema_reach,
    last_rows,
    must_cut,
    place,
    row_order,
    slope,
)
from stormlift.workspace import materialise

ROLL = (3, 5, 10, 20)
V4_ROLL = 15

RAW = ["dist", "azimuth", "amplitude", "maxis"]
POSITION = ["rank_cg", "t_since_start_s", "dt_prev_s", "amp_abs", "amp_sign"]
STEMS = ("dt_mean", "dt_max", "dt_std", "dt_ema", "dist_mean", "dist_trend", "amp_mean", "amp_trend")
ROLLING = [f"{stem}_{n}" for n in ROLL for stem in STEMS]
DENSITY = [f"n_cg_{m}min" for m in CG_MINUTES] + ["rate_decline_cg"]
CONTEXT = [f"n_ic_{m}min" for m in IC_MINUTES] + [f"n_all_{m}min" for m in ALL_MINUTES]
RATIOS = ["ratio_ic_cg_5min", "ratio_ic_cg_10min", "ic_trend", "total_activity", "activity_decline"]
CALENDAR = ["month", "hour"]
V3 = [*POSITION, *ROLLING, *DENSITY, *CONTEXT, *RATIOS, *CALENDAR, *RAW]
V4_EXTRA = [
    "rate_decline_cg_long", "rate_decline_ic", "dt_accel", "dt_mean_15", "dist_trend_15", "amp_trend_15",
    "ratio_ic_cg_30min", "composite_decline", "dt_relative", "dist_momentum",
]
V4 = [*V3, *V4_EXTRA]
MODEL_COLUMNS = [*V3, "airport_enc"]
# The columns that the threshold-tuned models leave out.
UNUSED_BY_TUNED = {"dt_std_20", "dt_ema_20", "amp_trend_20", "amplitude"}
TUNED_V3 = [c for c in V3 if c not in UNUSED_BY_TUNED]
TUNED_V4 = [*TUNED_V3, *V4_EXTRA]

KEYS = ["lightning_id", "date", *ALERT, "is_last_lightning_cloud_ground"]

# Columns that know the future of an alert, or the answer. Fixed names.
LEAKS = {"total_in_alert", "rel_pos", "relative_pos", "remaining", "remaining_in_alert", "is_last", "confidence",
         "rank_in_alert"}


def leaks_in(columns: list[str]) -> list[str]:
    return sorted(LEAKS & set(columns))


def check_no_leaks(columns: list[str]) -> None:
    if found := leaks_in(columns):
        raise ValueError(f"feature table holds columns that know the future: {', '.join(found)}")


def model_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """Model inputs present in ``df``: the wanted ones, or all but keys, metadata and leaks."""
    meta = {*KEYS, "lightning_airport_id", "lon", "lat", "icloud", "y", "fold", "us"}
    pool = wanted if wanted is not None else [c for c in df.columns if c not in meta | LEAKS]
    return [c for c in pool if c in df.columns]


def with_missing_as_zero(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})


def model_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Every model column as a double, null and unreadable as 0; the other columns as they are."""
    df = with_missing_as_zero(df, features)
    return df.withColumns({c: number_or_zero(c) for c in features})


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a readable label, as ``y`` 0/1."""
    out = df.withColumn("y", flag("is_last_lightning_cloud_ground").cast("int"))
    return out.filter(F.col("y").isNotNull())


def encode_airport(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``airport_enc``: the airport's place in alphabetical order, 0 for airports not in ``known``."""
    codes = dense_index((known if known is not None else df).select("airport").distinct(), ["airport"], "airport_enc")
    return df.join(codes, "airport", "left").withColumn("airport_enc", F.coalesce("airport_enc", F.lit(0)))


def _per_alert(cg: DataFrame, blocks: list[str], v4: bool, rolls: tuple[int, ...]) -> DataFrame:
    """Lag, row-frame and exponential columns; all windows share one partitioning and order."""
    w = Window.partitionBy(*ALERT, *blocks).orderBy(*row_order(cg))
    df = _timed(cg)
    # the exponential means first: each of their rounds copies the row, which is still narrow here
    df = ema(df, "dt_prev_s", rolls, w, F.col("rank_cg") == 0, "dt_ema")
    frames = {}
    for n in rolls:
        rows = last_rows(w, n)
        frames |= {
            f"dt_mean_{n}": F.avg("dt_prev_s").over(rows),
            f"dt_max_{n}": F.max("dt_prev_s").over(rows),
            f"dt_std_{n}": F.coalesce(F.stddev_samp("dt_prev_s").over(rows), F.lit(0.0)),
            f"dist_mean_{n}": F.avg("dist").over(rows),
            f"dist_trend_{n}": slope(F.col("dist"), w, n),
            f"amp_mean_{n}": F.avg("amp_abs").over(rows),
            f"amp_trend_{n}": slope(F.col("amp_abs"), w, n),
        }
    if v4:
        frames |= {
            "dt_accel": F.coalesce(F.col("dt_prev_s") - F.lag("dt_prev_s").over(w), F.lit(0.0)),
            "dist_momentum": F.coalesce(F.col("dist") - F.lag("dist", 3).over(w), F.lit(0.0)),
            f"dt_mean_{V4_ROLL}": F.avg("dt_prev_s").over(last_rows(w, V4_ROLL)),
            f"dist_trend_{V4_ROLL}": slope(F.col("dist"), w, V4_ROLL),
            f"amp_trend_{V4_ROLL}": slope(F.col("amp_abs"), w, V4_ROLL),
        }
    return df.withColumns(frames)


def _ratios(df: DataFrame) -> DataFrame:
    def per(a: str, b: str):
        return F.col(a) / (F.col(b) + 1)

    return df.withColumns(
        {
            "rate_decline_cg": per("n_cg_5min", "n_cg_10min"),
            "ratio_ic_cg_5min": per("n_ic_5min", "n_cg_5min"),
            "ratio_ic_cg_10min": per("n_ic_10min", "n_cg_10min"),
            "ic_trend": F.col("n_ic_5min") - F.col("n_ic_10min") / 2,
            "total_activity": F.col("n_all_5min"),
            "activity_decline": per("n_all_5min", "n_all_10min"),
            "month": utc_month("us").cast("bigint"),
            "hour": utc_hour("us"),
        }
    )


def derived_columns(rows: DataFrame) -> DataFrame:
    """The model columns that follow from a row's own windows and counts; ``rows`` may be a stream."""
    return _ratios(rows.withColumns({"amp_abs": F.abs("amplitude"), "amp_sign": F.signum("amplitude")}))


def _v4_ratios(df: DataFrame) -> DataFrame:
    calm = F.col("dt_prev_s") / (F.col("dt_mean_10") + 1)
    sparse = 1 / (F.col("n_cg_5min") + 1)
    usual_gap = F.col("t_since_start_s") / (F.col("rank_cg") + 1)
    return df.withColumns(
        {
            "rate_decline_cg_long": F.col("n_cg_10min") / (F.col("n_cg_30min") + 1),
            "rate_decline_ic": F.col("n_ic_5min") / (F.col("n_ic_30min") + 1),
            "ratio_ic_cg_30min": F.col("n_ic_30min") / (F.col("n_cg_30min") + 1),
            "composite_decline": calm * sparse * F.col("ratio_ic_cg_10min"),
            "dt_relative": F.col("dt_prev_s") / (usual_gap + 1),
        }
    )


def _slim(strikes: DataFrame, split: str, split_rows: int) -> tuple[DataFrame, bool, bool]:
    """The columns features need, and whether alerts and site-hours must be cut.

    Cut forms join a strike's counts back to it. Strike ids may be absent or repeat, so the strikes
    are then numbered in a written table, where the numbers cannot change.
    """
    slim = strikes.select(*[c for c in [*KEYS, "icloud", *RAW] if c in strikes.columns]).withColumn("us", micros("date"))
    if "lightning_id" not in slim.columns:
        slim = slim.withColumn("lightning_id", F.lit(None).cast("bigint"))
    cut = must_cut(slim, split, split_rows)
    if any(cut):
        slim = materialise(slim.withColumn(NUMBER, F.monotonically_increasing_id()), "numbered")
    return slim, *cut


def position_features(strikes: DataFrame, split: str = "auto", split_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Only position, gap and density columns: what simple gap rules need."""
    slim, big_alert, _ = _slim(strikes, split, split_rows)
    placed, _ = place(slim.filter(in_alert() & is_cg()), big_alert, split_rows, 1)
    placed = placed.filter(~F.col("_halo")).withColumnRenamed("rank", "rank_cg")
    df = cg_density(_timed(placed), big_alert)
    return df.select(*[c for c in KEYS if c in df.columns], *POSITION, *DENSITY[:-1], *RAW)


def _timed(placed: DataFrame) -> DataFrame:
    return placed.withColumns(
        {
            "t_since_start_s": (F.col("us") - F.col("start_us")) / 1e6,
            "dt_prev_s": F.coalesce((F.col("us") - F.col("prev_us")) / 1e6, F.lit(0.0)),
            "amp_abs": F.abs("amplitude"),
            "amp_sign": F.signum("amplitude"),
        }
    )


def _features(
    strikes: DataFrame, v4: bool, context: bool, split: str, split_rows: int, rolls: tuple[int, ...] = ROLL
) -> DataFrame:
    slim, big_alert, big_hour = _slim(strikes, split, split_rows)
    wanted = in_alert() & is_cg()
    if context:
        cg = context_counts(slim, wanted, dense=big_hour)
    else:
        cg = slim.filter(wanted).withColumns({c: F.lit(0).cast("bigint") for c in CONTEXT})
    cg = cg.drop("icloud")
    placed, blocks = place(cg, big_alert, split_rows, max(ema_reach(rolls), *rolls) + 8)
    placed = placed.withColumnRenamed("rank", "rank_cg").drop("total")
    if big_alert:  # counts first: they need each strike once
        counts = cg_density(placed.filter(~F.col("_halo")), True).select(NUMBER, *DENSITY[:-1])
        df = _per_alert(placed, blocks, v4, rolls).filter(~F.col("_halo")).join(counts, NUMBER)
    else:
        df = _per_alert(cg_density(placed, False), blocks, v4, rolls)
    df = _ratios(df)
    if v4:
        df = _v4_ratios(df)
    names = V4 if v4 else V3
    names = [*names, *[c for n in rolls for stem in STEMS if (c := f"{stem}_{n}") not in names]]
    return df.select(*[c for c in KEYS if c in df.columns], *names)


def features_v3(
    strikes: DataFrame, context: bool = True, split: str = "auto", split_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """The 61 numeric model columns (``encode_airport`` adds the 62nd) with the strike's keys.

    ``strikes`` is the full table: the airport-wide counts see IC strikes and strikes outside
    alerts. ``context=False`` sets those counts to 0. ``split`` says whether alerts and site-hours
    are cut into blocks: ``auto`` measures the largest ones and cuts above ``split_rows``.
    """
    return _features(strikes, False, context, split, split_rows)


def features_v4(
    strikes: DataFrame,
    context: bool = True,
    split: str = "auto",
    split_rows: int = MAX_GROUP_ROWS,
    also: tuple[int, ...] = (),
) -> DataFrame:
    """``features_v3`` plus the ten columns of the fourth version; ``also`` adds row-frame lengths."""
    return _features(strikes, True, context, split, split_rows, (*ROLL, *also))


def cold_start_features(rows: DataFrame) -> DataFrame:
    """Feature rows for strikes known only by a summary: rank and gap to the previous strike.

    Input: ``rank_cg, dt_prev_s, dist, azimuth, amplitude, maxis, month, hour`` plus any keys.
    """
    dt = F.col("dt_prev_s")
    cols = {
        "t_since_start_s": F.col("rank_cg") * dt,
        "amp_abs": F.abs("amplitude"),
        "amp_sign": F.signum("amplitude"),
    }
    for n in ROLL:
        cols |= {
            f"dt_mean_{n}": dt,
            f"dt_max_{n}": dt * 1.5,
            f"dt_std_{n}": dt * 0.3,
            f"dt_ema_{n}": dt,
            f"dist_mean_{n}": F.col("dist"),
            f"dist_trend_{n}": F.lit(0.0),
            f"amp_mean_{n}": F.abs("amplitude"),
            f"amp_trend_{n}": F.lit(0.0),
        }
    for m in CG_MINUTES:
        fits = F.floor(F.lit(60.0 * m) / F.greatest(dt, F.lit(1.0)))
        cols[f"n_cg_{m}min"] = F.greatest(F.lit(1), fits).cast("bigint")
    cols |= {c: F.lit(0).cast("bigint") for c in [*CONTEXT, "total_activity"]}
    cols |= {c: F.lit(0.0) for c in ("ratio_ic_cg_5min", "ratio_ic_cg_10min", "ic_trend")}
    cols["activity_decline"] = F.lit(0.5)
    return rows.withColumns(cols).withColumn("rate_decline_cg", F.col("n_cg_5min") / (F.col("n_cg_10min") + 1))
