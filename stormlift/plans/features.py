"""Feature-table queries. All read the one feature table; the optimizer keeps only what they show."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormlift.functions.scalars import in_alert, is_cg, micros
from stormlift.operators.explore import alert_clock
from stormlift.operators.features import (
    CONTEXT,
    RATIOS,
    ROLL,
    STEMS,
    TUNED_V4,
    V3,
    V4,
    V4_EXTRA,
    check_no_leaks,
    cold_start_features,
    encode_airport,
    leaks_in,
    model_columns,
    model_matrix,
    MODEL_COLUMNS,
)
from stormlift.operators.features import features_v4 as build_v4
from stormlift.operators.windows import context_counts, context_counts_by_join
from stormlift.plans.base import query, s6, shown, sql

INTS = {"rank_cg", "total_activity", "month", "hour"} | {c for c in V4 if c.startswith("n_")}


def cols(names: list[str]) -> str:
    return ", ".join(n if n in INTS else s6(n) for n in names)


def pick(t, names, context: bool = False):
    return shown(t.features(context).select("lightning_id", *names))


def feat_sql(names: list[str], level: str = "feat") -> str:
    return sql(level, f"SELECT lightning_id, {cols(names)} FROM feat")


DT = [f"dt_{s}_{n}" for n in ROLL for s in ("mean", "max", "std")]
EMA = [f"dt_ema_{n}" for n in ROLL]
DIST = [f"dist_{s}_{n}" for n in ROLL for s in ("mean", "trend")]
AMP = ["amp_abs", "amp_sign", *[f"amp_{s}_{n}" for n in ROLL for s in ("mean", "trend")]]
DENS = ["n_cg_2min", "n_cg_5min", "n_cg_10min", "n_cg_15min", "n_cg_30min"]


@query("feat_position", feat_sql(["rank_cg", "t_since_start_s"]))
def feat_position(t):
    return pick(t, ["rank_cg", "t_since_start_s"])


@query("feat_dt", feat_sql(["dt_prev_s", *DT]))
def feat_dt(t):
    return pick(t, ["dt_prev_s", *DT])


@query("feat_dt_ema", feat_sql(EMA))
def feat_dt_ema(t):
    return pick(t, EMA)


@query("feat_dist", feat_sql(DIST))
def feat_dist(t):
    return pick(t, DIST)


@query("feat_amp", feat_sql(AMP))
def feat_amp(t):
    return pick(t, AMP)


@query("feat_cg_density", feat_sql(DENS))
def feat_cg_density(t):
    return pick(t, DENS)


@query("feat_ratios", feat_sql(["rate_decline_cg", *RATIOS]))
def feat_ratios(t):
    return pick(t, ["rate_decline_cg", *RATIOS], context=True)


@query("feat_v4", feat_sql(V4_EXTRA))
def feat_v4(t):
    return pick(t, V4_EXTRA, context=True)


@query("ctx_counts", feat_sql(CONTEXT))
def ctx_counts(t):
    strikes = t.strikes().withColumn("us", micros("date"))
    return context_counts(strikes, in_alert() & is_cg(), t.big()[1]).select("lightning_id", *CONTEXT)


@query("ctx_counts_range_join", feat_sql(CONTEXT))
def ctx_counts_range_join(t):
    """The same counts as a bucketed range join."""
    strikes = t.strikes().withColumn("us", micros("date"))
    return context_counts_by_join(strikes, in_alert() & is_cg()).select("lightning_id", *CONTEXT)


@query("ctx_counts_probes", feat_sql(CONTEXT))
def ctx_counts_probes(t):
    """The same counts for site-hours of any size, as running sums over one time line."""
    strikes = t.strikes().withColumn("us", micros("date"))
    return context_counts(strikes, in_alert() & is_cg(), dense=True).select("lightning_id", *CONTEXT)


ENC = "enc AS (SELECT airport AS eap, row_number() OVER (ORDER BY airport) - 1 AS airport_enc FROM (SELECT DISTINCT airport FROM strikes))"


@query(
    "features_v3",
    sql(
        "feat",
        f"""SELECT lightning_id, us AS date_us, airport, airport_alert_id, is_last AS is_last_lightning_cloud_ground,
            airport_enc, {cols(V3)} FROM feat JOIN enc ON eap = airport""",
        ENC,
    ),
)
def features_v3(t):
    table = t.features().drop(*V4_EXTRA)
    check_no_leaks(table.columns)
    return shown(encode_airport(table))


@query("features_v4", feat_sql(V4))
def features_v4(t):
    return pick(t, V4, context=True)


FIFTEEN = [f"{stem}_15" for stem in STEMS]


@query("feat_windows_15", feat_sql(FIFTEEN))
def feat_windows_15(t):
    """All row-frame columns over fifteen strikes, as the evaluation table has them."""
    table = build_v4(t.strikes(), context=False, split=t.split(), also=(15,))
    return shown(table.select("lightning_id", *FIFTEEN))


@query(
    "features_v4_blocked",
    feat_sql(V4),
)
def features_v4_blocked(t):
    """The same table computed in blocks, the form for alerts too large for one task."""
    return shown(build_v4(t.strikes(), split="always", split_rows=1024).select("lightning_id", *V4))


@query(
    "encode_airport",
    sql("strikes", "SELECT lightning_id, airport, airport_enc FROM strikes JOIN enc ON eap = airport", ENC),
)
def encode(t):
    return encode_airport(t.strikes().select("lightning_id", "airport")).select("lightning_id", "airport", "airport_enc")


MATRIX = [*TUNED_V4, "airport_enc"]


@query(
    "model_matrix",
    sql(
        "feat",
        f"""SELECT lightning_id, {", ".join(s6(f"coalesce(CAST({c} AS DOUBLE), 0)", c) for c in MATRIX)},
            CAST(0 AS DOUBLE) AS not_there
            FROM feat JOIN enc ON eap = airport""",
        ENC,
    ),
)
def matrix(t):
    """Model inputs as doubles; null trends and an absent feature become 0."""
    table = model_matrix(encode_airport(t.features()), [*MATRIX, "not_there"])
    return shown(table.select("lightning_id", *MATRIX, "not_there"))


@query("model_columns", sql("feat", f"SELECT lightning_id, {cols(V3)}, airport_enc FROM feat JOIN enc ON eap = airport", ENC))
def chosen_columns(t):
    """The model's inputs taken out of the wider table; a wanted column that is not there is left out."""
    table = encode_airport(t.features())
    return shown(table.select("lightning_id", *model_columns(table, [*MODEL_COLUMNS, "not_there"])))


@query(
    "leak_guard",
    sql(
        "strikes",
        "SELECT name AS \"column\", n, CAST(0 AS BIGINT) AS n_left FROM (SELECT unnest(['rank_in_alert', 'relative_pos', 'total_in_alert']) AS name, "
        "(SELECT count(*) FROM strikes WHERE airport_alert_id IS NOT NULL) AS n)",
    ),
)
def leak_guard(t):
    """The columns of the exploration table that the guard refuses, their values, and how many are model inputs (none)."""
    table = alert_clock(t.strikes(), t.split())
    found, taken = leaks_in(table.columns), model_columns(table)
    counts = table.agg(*[F.count(c).alias(c) for c in found])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n"), F.lit(int(c in taken)).cast("bigint").alias("n_left")) for c in found]
    return counts.select(F.inline(F.array(*cells)))


COLD_IN = """cold AS (
  SELECT lightning_id, CAST(1 + lightning_id % 40 AS BIGINT) AS rank_cg, maxis * 3 AS dt_prev_s, dist, azimuth,
         amplitude, maxis, month(make_timestamp(us)) AS month, hour(make_timestamp(us)) AS hour FROM strikes)"""

COLD = [c for c in V3 if c not in ("rank_cg", "dt_prev_s", "month", "hour", "dist", "azimuth", "amplitude", "maxis")]


def cold_expr(c: str) -> str:
    if c.startswith("n_cg_"):
        return f"greatest(1, CAST(floor({c[5:-3]} * 60e0 / greatest(dt_prev_s, 1e0)) AS BIGINT))"
    if c.startswith(("n_ic", "n_all")) or c == "total_activity":
        return "CAST(0 AS BIGINT)"
    fixed = {
        "t_since_start_s": "rank_cg * dt_prev_s", "amp_abs": "abs(amplitude)", "amp_sign": "CAST(sign(amplitude) AS DOUBLE)",
        "rate_decline_cg": f"{cold_expr('n_cg_5min')} / ({cold_expr('n_cg_10min')} + 1e0)" if c == "rate_decline_cg" else "",
        "activity_decline": "5e-1",
    }
    if c in fixed:
        return fixed[c]
    stem = c.rsplit("_", 1)[0]
    return {
        "dt_mean": "dt_prev_s", "dt_max": "dt_prev_s * 1.5e0", "dt_std": "dt_prev_s * 3e-1", "dt_ema": "dt_prev_s",
        "dist_mean": "dist", "amp_mean": "abs(amplitude)",
    }.get(stem, "0e0")


@query(
    "cold_start_features",
    sql(
        "strikes",
        "SELECT lightning_id, rank_cg, "
        + ", ".join(cold_expr(c) + f" AS {c}" if c in INTS else s6(cold_expr(c), c) for c in COLD)
        + " FROM cold",
        COLD_IN,
    ),
)
def cold_start(t):
    """Approximate features of strikes known by rank and gap alone, for every strike."""
    rows = t.strikes().select(
        "lightning_id",
        (1 + F.col("lightning_id") % 40).cast("bigint").alias("rank_cg"),
        (F.col("maxis") * 3).alias("dt_prev_s"),
        "dist",
        "azimuth",
        "amplitude",
        "maxis",
        F.month("date").alias("month"),
        F.hour("date").alias("hour"),
    )
    return shown(cold_start_features(rows).select("lightning_id", "rank_cg", *COLD))


