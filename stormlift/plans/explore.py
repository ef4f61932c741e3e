"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormlift.functions.geo import rings
from stormlift.functions.scalars import flag, in_alert, is_cg, number_or_zero
from stormlift.operators import explore as X
from stormlift.operators.features import labelled
from stormlift.operators.sessions import sessions
from stormlift.plans.base import query, s6, s6s, shown, sql
from stormlift.sources.readers import read_strikes, read_strikes_checked, write_table
from stormlift.workspace import new_path

STRIKE_COLS = "lightning_id, us AS date_us, airport, dist, azimuth, amplitude, maxis, icloud, airport_alert_id"
KEYS = ["lightning_id", "date", "airport", "dist", "azimuth", "amplitude", "maxis", "icloud", "airport_alert_id"]
DAY = "make_timestamp(us)"


def keyed(df):
    return df.select(*KEYS, F.unix_micros("date").alias("date_us")).drop("date")


# --- sources -------------------------------------------------------------------------------


@query(
    "normalize_strikes",
    sql(
        "strikes",
        f"""SELECT lightning_id, row_number() OVER (PARTITION BY airport ORDER BY us, lightning_id) AS lightning_airport_id,
           us AS date_us, {s6s('lon', 'lat')}, amplitude, maxis, icloud, dist, azimuth, airport, airport_alert_id,
           is_last AS is_last_lightning_cloud_ground FROM strikes""",
    ),
)
def normalize_strikes(t):
    """Strikes as they come in text files (ids as floats, flags as words), cast back."""
    from stormlift.sources.schema import normalize

    numbered = X.numbered_per_airport(t.strikes())
    text = numbered.select(
        "lightning_id",
        "lightning_airport_id",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS+00:00").alias("date"),
        *[F.col(c).cast("string").alias(c) for c in ("lon", "lat", "amplitude", "maxis", "dist", "azimuth")],
        F.when(F.col("icloud"), " True").otherwise("False ").alias("icloud"),
        "airport",
        F.col("airport_alert_id").cast("double").cast("string").alias("airport_alert_id"),
        F.initcap(F.col("is_last_lightning_cloud_ground").cast("string")).alias("is_last_lightning_cloud_ground"),
    )
    return shown(normalize(text))


@query(
    "derive_strikes",
    sql(
        "strikes",
        f"""SELECT lightning_id, us AS date_us, {s6s('lon', 'lat')}, amplitude, maxis, icloud, dist, azimuth, airport,
            airport_alert_id, is_last AS is_last_lightning_cloud_ground FROM strikes""",
    ),
)
def derive_strikes(t):
    """Alerts and labels found from raw strikes."""
    return shown(t.derived_strikes())


@query(
    "sink_roundtrip",
    sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes"),
)
def sink_roundtrip(t):
    """Strikes written as CSV and read back through the checked reader."""
    from stormlift.sources.readers import read_strikes, write_table
    from stormlift.workspace import new_path

    path = new_path(t.spark, "csv")
    write_table(t.strikes(), path, "csv")
    return keyed(read_strikes(t.spark, path))


@query(
    "coerce_numeric",
    """SELECT event_id, coalesce(try_cast(props AS DOUBLE), 0) AS props_num,
       coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k_num,
       coalesce(try_cast(event_type AS BOOLEAN), false) AS type_flag FROM events""",
)
def coerce_numeric(t):
    """Readable numbers stay, anything else becomes 0; unreadable flags become false."""
    return t.read("events").select(
        "event_id",
        number_or_zero("props").alias("props_num"),
        number_or_zero(F.get_json_object("props", "$.k")).alias("k_num"),
        F.coalesce(flag("event_type"), F.lit(False)).alias("type_flag"),
    )


@query(
    "dataset_overview",
    sql(
        "strikes",
        """SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns, min(us) AS first_us, max(us) AS last_us,
           count(DISTINCT airport) AS n_airports,
           count(DISTINCT CASE WHEN airport_alert_id IS NOT NULL THEN (airport, airport_alert_id) END) AS n_alerts,
           count(*) FILTER (WHERE dist < 3) AS n_danger FROM strikes""",
    ),
)
def dataset_overview(t):
    return X.dataset_overview(t.strikes())


@query("preview", sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes ORDER BY lightning_id LIMIT 5"))
def preview(t):
    return keyed(t.strikes()).orderBy("lightning_id").limit(5)


# --- filters -------------------------------------------------------------------------------


@query("filter_in_alert", sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes WHERE airport_alert_id IS NOT NULL"))
def filter_in_alert(t):
    return keyed(t.strikes().filter(in_alert()))


@query("filter_cg", sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes WHERE NOT icloud"))
def filter_cg(t):
    return keyed(t.strikes().filter(is_cg()))


@query("filter_ic", sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes WHERE icloud"))
def filter_ic(t):
    return keyed(t.strikes().filter("icloud"))


@query(
    "alert_slice",
    sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes WHERE airport = 'AP000' AND airport_alert_id = 1001"),
)
def alert_slice(t):
    """One alert, as picked by a user."""
    return keyed(t.strikes().filter((F.col("airport") == "AP000") & (F.col("airport_alert_id") == 1001)))


@query("danger_strikes", sql("strikes", f"SELECT {STRIKE_COLS} FROM strikes WHERE dist < 3"))
def danger_strikes(t):
    return keyed(t.strikes().filter(F.col("dist") < 3))


@query(
    "labelled_rows",
    sql("strikes", "SELECT lightning_id, CAST(is_last AS BIGINT) AS y FROM strikes WHERE is_last IS NOT NULL"),
)
def labelled_rows(t):
    return shown(labelled(t.strikes()).select("lightning_id", "y"))


@query(
    "alerts_mid_size",
    sql(
        "strikes",
        f"""SELECT {STRIKE_COLS} FROM (SELECT *, count(*) OVER (PARTITION BY airport, airport_alert_id) AS n FROM strikes
            WHERE airport_alert_id IS NOT NULL) WHERE n > 20 AND n < 100""",
    ),
)
def alerts_mid_size(t):
    return keyed(X.mid_size_alerts(t.strikes(), 20, 100))


@query(
    "first_mid_alert",
    sql(
        "strikes",
        """SELECT airport, min(airport_alert_id) AS airport_alert_id FROM (SELECT airport, airport_alert_id, count(*) AS n
           FROM strikes WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2) WHERE n > 20 AND n < 100 GROUP BY 1""",
    ),
)
def first_mid_alert(t):
    return X.first_alerts(X.mid_size_alerts(t.strikes(), 20, 100))


@query(
    "temporal_split",
    sql(
        "strikes",
        f"""SELECT CASE WHEN us <= 1704067200000000 + 21600000000 THEN 'train' ELSE 'eval' END AS part, count(*) AS n,
           count(DISTINCT airport) AS n_airports, min(us) AS first_us, max(us) AS last_us FROM strikes GROUP BY 1""",
    ),
)
def temporal_split(t):
    """Train up to a date, evaluation after it."""
    cut = F.unix_micros("date") <= 1_704_067_200_000_000 + 21_600_000_000
    us = F.unix_micros("date")
    return (
        X.temporal_split(t.strikes(), cut)
        .groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("airport").alias("n_airports"),
            F.min(us).alias("first_us"),
            F.max(us).alias("last_us"),
        )
    )


# --- aggregates ----------------------------------------------------------------------------


@query(
    "airport_overview",
    sql(
        "strikes",
        f"""SELECT a.airport, n_strikes, n_cg, n_ic, {s6s('dist_mean', 'amp_mean', 'amp_abs_mean')}, n_alerts, n_in_alerts,
           {s6('round(n_ic / CAST(nullif(n_cg, 0) AS DOUBLE), 2)', 'ic_cg_ratio')}
           FROM (SELECT airport, count(*) AS n_strikes, count(*) FILTER (WHERE NOT icloud) AS n_cg,
                        count(*) FILTER (WHERE icloud) AS n_ic, avg(dist) AS dist_mean, avg(amplitude) AS amp_mean,
                        avg(abs(amplitude)) AS amp_abs_mean FROM strikes GROUP BY 1) a
           LEFT JOIN (SELECT airport, count(DISTINCT airport_alert_id) AS n_alerts, count(*) AS n_in_alerts FROM strikes
                      WHERE airport_alert_id IS NOT NULL GROUP BY 1) b ON a.airport = b.airport""",
    ),
)
def airport_overview(t):
    return shown(X.airport_overview(t.strikes()))


ALERT_STATS = """alert_stats AS (
  SELECT airport, airport_alert_id, count(*) AS n_strikes, count(*) FILTER (WHERE NOT icloud) AS n_cg,
         count(*) FILTER (WHERE icloud) AS n_ic, min(us) AS start_us, max(us) AS end_us, min(dist) AS dist_min,
         max(dist) AS dist_max, max(abs(amplitude)) AS amp_abs_max, (max(us) - min(us)) / 6e7 AS duration_min,
         month(make_timestamp(min(us))) AS start_month
  FROM strikes WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2)"""


@query(
    "alert_overview",
    sql(
        "strikes",
        f"""SELECT * EXCLUDE (duration_min, dist_min, dist_max, amp_abs_max),
            {s6s('duration_min', 'dist_min', 'dist_max', 'amp_abs_max')} FROM alert_stats""",
        ALERT_STATS,
    ),
)
def alert_overview(t):
    return shown(X.alert_overview(t.strikes()))


def describe_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {s6(f'avg({c})', 'mean')}, {s6(f'stddev_samp({c})', 'std')},
            {s6(f'min({c})', 'min')}, {s6(f'max({c})', 'max')}, {s6(f'quantile_cont({c}, 0.25)', 'q25')},
            {s6(f'quantile_cont({c}, 0.5)', 'q50')}, {s6(f'quantile_cont({c}, 0.75)', 'q75')} FROM {table}"""
        for c in columns
    )


NUMERIC = ["dist", "azimuth", "amplitude", "maxis", "lon", "lat"]


@query("describe_numeric", sql("strikes", describe_sql("strikes", NUMERIC)))
def describe_numeric(t):
    return shown(X.describe(t.strikes(), NUMERIC))


DURATIONS = ["duration_min", "n_strikes", "n_cg", "dist_min"]


@query(
    "describe_duration",
    sql(
        "strikes",
        describe_sql("ds", DURATIONS),
        ALERT_STATS,
        "ds AS (SELECT duration_min, CAST(n_strikes AS DOUBLE) n_strikes, CAST(n_cg AS DOUBLE) n_cg, dist_min FROM alert_stats)",
    ),
)
def describe_duration(t):
    return shown(X.describe(X.alert_overview(t.strikes()), DURATIONS))


@query(
    "null_profile",
    sql(
        "strikes",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({s}) AS n_null FROM strikes"
            for c, s in [
                *[(x, x) for x in ("lightning_id", "lon", "lat", "amplitude", "maxis", "icloud", "dist", "azimuth", "airport")],
                ("date", "us"),
                ("airport_alert_id", "airport_alert_id"),
                ("is_last_lightning_cloud_ground", "is_last"),
            ]
        ),
    ),
)
def null_profile(t):
    return X.null_profile(t.strikes())


@query(
    "label_counts",
    sql("strikes", "SELECT is_last AS is_last_lightning_cloud_ground, count(*) AS n FROM strikes GROUP BY 1"),
)
def label_counts(t):
    return X.value_counts(t.strikes(), "is_last_lightning_cloud_ground")


def pivot_sql(row: str, name: str, col: str, values: list, prefix: str, table: str = "strikes") -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE {col} = {v if not isinstance(v, bool) else str(v).lower()}) AS {prefix}{str(v).lower()}"
        for v in values
    )
    return f"SELECT {row} AS {name}, {cells} FROM {table} GROUP BY 1"


MONTHS, HOURS = list(range(1, 13)), list(range(24))


@query("pivot_icloud_airport", sql("strikes", pivot_sql("airport", "airport", "icloud", [False, True], "icloud_")))
def pivot_icloud_airport(t):
    return X.crosstab(t.strikes(), "airport", F.col("icloud"), [False, True], "icloud_", "airport")


@query("pivot_month_airport", sql("strikes", pivot_sql("airport", "airport", f"month({DAY})", MONTHS, "m")))
def pivot_month_airport(t):
    return X.crosstab(t.strikes(), "airport", F.month("date"), MONTHS, "m", "airport")


@query("pivot_hour_airport", sql("strikes", pivot_sql("airport", "airport", f"hour({DAY})", HOURS, "h")))
def pivot_hour_airport(t):
    return X.crosstab(t.strikes(), "airport", F.hour("date"), HOURS, "h", "airport")


@query(
    "pivot_year_airport",
    sql("strikes", f"SELECT year({DAY}) AS year, airport, count(*) AS n FROM strikes GROUP BY 1, 2"),
)
def pivot_year_airport(t):
    return shown(X.long_crosstab(t.strikes(), F.year("date"), "airport", "year"))


@query("heatmap_month_hour", sql("strikes", pivot_sql(f"month({DAY})", "month", f"hour({DAY})", HOURS, "h")))
def heatmap_month_hour(t):
    return shown(X.crosstab(t.strikes(), F.month("date"), F.hour("date"), HOURS, "h", "month"))


@query(
    "pivot_start_month",
    sql("strikes", pivot_sql("airport", "airport", "start_month", MONTHS, "m", "alert_stats"), ALERT_STATS),
)
def pivot_start_month(t):
    return X.crosstab(X.alert_overview(t.strikes()), "airport", F.col("start_month"), MONTHS, "m", "airport")


@query(
    "class_balance",
    sql(
        "cg",
        f"""SELECT count(*) AS n, count(*) FILTER (WHERE is_last) AS n_pos,
           {s6('count(*) FILTER (WHERE is_last) / CAST(count(*) AS DOUBLE)', 'pos_rate')},
           {s6('count(*) FILTER (WHERE NOT is_last) / CAST(nullif(count(*) FILTER (WHERE is_last), 0) AS DOUBLE)', 'neg_per_pos')}
           FROM cg""",
    ),
)
def class_balance(t):
    return shown(X.class_balance(labelled(t.strikes())))


CLOCK = """clock AS (
  SELECT *, row_number() OVER w - 1 AS rank_in_alert, (us - lag(us) OVER w) / 1e6 AS time_prev,
         (us - min(us) OVER (PARTITION BY airport, airport_alert_id)) / 6e7 AS time_since_start,
         count(*) OVER (PARTITION BY airport, airport_alert_id) AS total_in_alert,
         (row_number() OVER w - 1) / CAST(count(*) OVER (PARTITION BY airport, airport_alert_id) AS DOUBLE) AS relative_pos
  FROM strikes WHERE airport_alert_id IS NOT NULL
  WINDOW w AS (PARTITION BY airport, airport_alert_id ORDER BY us, lightning_id))"""


def hist_sql(table: str, value: str, bins: int, by: str = "") -> str:
    part, cols, using = (f"PARTITION BY {by}", f"{by}, ", by) if by else ("", "", "")
    return f"""SELECT {cols}bin, {s6('lo + bin * width', '"left"')}, count(*) AS n, {s6('count(*) / (total * width)', 'density')}
      FROM (SELECT *, CAST(least(floor((v - lo) / width), {bins - 1}) AS BIGINT) AS bin FROM (
        SELECT *, (hi - lo) / {bins} AS width FROM (
          SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5e0 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5e0 ELSE hi0 END AS hi
          FROM (SELECT {cols}v, min(v) OVER ({part}) AS lo0, max(v) OVER ({part}) AS hi0, count(*) OVER ({part}) AS total
                FROM (SELECT {cols}{value} AS v FROM {table}) WHERE v IS NOT NULL))))
      GROUP BY {cols}bin, lo, width, total"""


@query("hist_dist", sql("strikes", hist_sql("strikes", "dist", 30, "airport")))
def hist_dist(t):
    return shown(X.histogram(t.strikes(), F.col("dist"), 30, ["airport"]))


@query("hist_amp_abs", sql("strikes", hist_sql("strikes", "abs(amplitude)", 50, "airport")))
def hist_amp_abs(t):
    return shown(X.histogram(t.strikes(), F.abs("amplitude"), 50, ["airport"]))


@query("hist_maxis", sql("strikes", hist_sql("strikes", "maxis", 40, "airport")))
def hist_maxis(t):
    return shown(X.histogram(t.strikes(), F.col("maxis"), 40, ["airport"]))


@query("hist_overall", sql("strikes", hist_sql("strikes", "dist", 30)))
def hist_overall(t):
    return shown(X.histogram(t.strikes(), F.col("dist"), 30))


@query("hist_duration", sql("strikes", hist_sql("alert_stats", "duration_min", 30, "airport"), ALERT_STATS))
def hist_duration(t):
    return shown(X.histogram(X.alert_overview(t.strikes()), F.col("duration_min"), 30, ["airport"]))


@query(
    "hist_alert_size",
    sql("strikes", hist_sql("alert_stats", "CAST(n_strikes AS DOUBLE)", 30, "airport"), ALERT_STATS),
)
def hist_alert_size(t):
    return shown(X.histogram(X.alert_overview(t.strikes()), F.col("n_strikes"), 30, ["airport"]))


@query("hist_alert_dist_min", sql("strikes", hist_sql("alert_stats", "dist_min", 30, "airport"), ALERT_STATS))
def hist_alert_dist_min(t):
    return shown(X.histogram(X.alert_overview(t.strikes()), F.col("dist_min"), 30, ["airport"]))


@query("hist_by_label", sql("cg", hist_sql("cg", "dist", 30, "is_last")))
def hist_by_label(t):
    rows = t.strikes().filter(F.col("is_last_lightning_cloud_ground").isNotNull())
    rows = rows.withColumnRenamed("is_last_lightning_cloud_ground", "is_last")
    return shown(X.histogram(rows, F.col("dist"), 30, ["is_last"]))


@query(
    "hist_clipped",
    sql(
        "strikes",
        hist_sql("labelled", "least(greatest(time_prev, 0e0), 600e0)", 50, "is_last"),
        CLOCK,
        "labelled AS (SELECT * FROM clock WHERE is_last IS NOT NULL AND time_prev IS NOT NULL)",
    ),
)
def hist_clipped(t):
    """Gaps to the previous strike of the alert, clipped to ten minutes, last against other strikes."""
    rows = X.alert_clock(t.strikes(), t.split()).filter(F.col("is_last_lightning_cloud_ground").isNotNull())
    rows = rows.withColumnRenamed("is_last_lightning_cloud_ground", "is_last")
    return shown(X.histogram(rows, F.col("time_prev"), 50, ["is_last"], (0, 600)))


@query(
    "type_by_label",
    sql(
        "strikes",
        """SELECT is_last, icloud, count(*) AS n FROM strikes WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2""",
    ),
)
def type_by_label(t):
    rows = t.strikes().filter(in_alert())
    return rows.groupBy(F.col("is_last_lightning_cloud_ground").alias("is_last"), "icloud").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "eda_positions",
    sql(
        "strikes",
        f"""SELECT lightning_id, rank_in_alert, total_in_alert, {s6s('time_prev', 'time_since_start', 'relative_pos')}
            FROM clock""",
        CLOCK,
    ),
)
def eda_positions(t):
    return shown(
        X.alert_clock(t.strikes(), t.split()).select(
            "lightning_id", "rank_in_alert", "total_in_alert", "time_prev", "time_since_start", "relative_pos"
        )
    )


CORR = ["dist", "amp_abs", "maxis", "relative_pos", "time_since_start", "icloud_int", "is_last_int"]


@query(
    "corr_matrix",
    sql(
        "strikes",
        " UNION ALL ".join(
            f"SELECT '{a}' AS \"row\", '{b}' AS col, {s6(f"nullif(corr({a}, {b}), CAST('NaN' AS DOUBLE))", 'r')} FROM m"
            for i, a in enumerate(CORR)
            for b in CORR[:i]
        ),
        CLOCK,
        """m AS (SELECT dist, abs(amplitude) AS amp_abs, maxis, relative_pos, time_since_start,
           CAST(icloud AS INT) AS icloud_int, CAST(is_last AS INT) AS is_last_int FROM clock)""",
    ),
)
def corr_matrix(t):
    rows = X.alert_clock(t.strikes(), t.split()).withColumns(
        {
            "amp_abs": F.abs("amplitude"),
            "icloud_int": F.col("icloud").cast("int"),
            "is_last_int": F.col("is_last_lightning_cloud_ground").cast("int"),
        }
    )
    return shown(X.correlations(rows, CORR))


SIGNALS = {
    "dt_prev_s": "dt_prev_s",
    "dist": "dist",
    "amp_abs": "amp_abs",
    "ic_share_5min": "n_ic_5min / CAST(n_all_5min AS DOUBLE)",
    "n_cg_10min": "n_cg_10min",
}


@query(
    "last_vs_rest",
    sql(
        "feat",
        f"""SELECT signal, {s6s('mean_rest', 'mean_last')}, {s6('100 * (mean_last / nullif(mean_rest, 0) - 1)', 'gap_pct')}
            FROM ({
            " UNION ALL ".join(
                f"SELECT '{n}' AS signal, avg({e}) FILTER (WHERE NOT is_last) AS mean_rest, avg({e}) FILTER (WHERE is_last) AS mean_last FROM feat"
                for n, e in SIGNALS.items()
            )
        })""",
    ),
)
def last_vs_rest(t):
    return shown(X.last_vs_rest(t.features()))


@query(
    "alert_picker",
    sql(
        "strikes",
        """SELECT airport, airport_alert_id, n_cg, '#' || airport_alert_id || ' (' || n_cg || ' strikes)' AS label
           FROM (SELECT airport, airport_alert_id, count(*) FILTER (WHERE NOT icloud) AS n_cg FROM strikes
                 WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2)""",
    ),
)
def alert_picker(t):
    return X.alert_picker(t.strikes()).orderBy("airport", "airport_alert_id")


@query(
    "random_alert",
    sql(
        "strikes",
        """SELECT airport, airport_alert_id FROM (SELECT DISTINCT airport, airport_alert_id FROM strikes WHERE airport_alert_id IS NOT NULL)
           ORDER BY md5(airport || '|' || airport_alert_id || '|42'), airport, airport_alert_id LIMIT 1""",
    ),
)
def random_alert(t):
    return X.random_alert(t.strikes())


@query(
    "alert_trajectory",
    sql(
        "strikes",
        f"""SELECT lightning_id, airport, airport_alert_id, {s6('time_since_start', 't_min')}, {s6s('dist', 'lon', 'lat')},
            CASE WHEN is_last THEN 'last_cg' WHEN icloud THEN 'ic' ELSE 'cg' END AS kind FROM clock""",
        CLOCK,
    ),
)
def alert_trajectory(t):
    return shown(X.trajectory(t.strikes(), t.split()))


@query(
    "airport_dim_join",
    sql(
        "strikes",
        f"""SELECT s.lightning_id, s.airport, {s6('d.lat', 'site_lat')}, {s6('d.lon', 'site_lon')}
            FROM strikes s JOIN (SELECT DISTINCT airport, lat0 AS lat, lon0 AS lon FROM ev3) d ON s.airport = d.airport""",
    ),
)
def airport_dim_join(t):
    dim = t.sites().select("airport", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    return shown(t.strikes().join(dim, "airport").select("lightning_id", "airport", "site_lat", "site_lon"))


@query(
    "geo_rings",
    sql(
        "strikes",
        f"""SELECT airport, radius_km, point,
            {s6('lon0 + radius_km * cos(angle) / (111e0 * cos(radians(lat0)))', 'lon')},
            {s6('lat0 + radius_km * sin(angle) / 111e0', 'lat')}
            FROM (SELECT airport, lat0, lon0, r.radius_km, p.point, p.point * (2 * pi() / 99) AS angle
                  FROM (SELECT DISTINCT airport, lat0, lon0 FROM ev3), (VALUES (30e0), (3e0)) r(radius_km),
                       (SELECT unnest(range(100)) AS point) p)""",
    ),
)
def geo_rings(t):
    return shown(rings(t.sites(), [30.0, 3.0]))


@query(
    "calendar_parts",
    sql(
        "strikes",
        f"""SELECT lightning_id, month({DAY}) AS month, hour({DAY}) AS hour, year({DAY}) AS year,
            (isodow({DAY}) - 1) AS dayofweek FROM strikes""",
    ),
)
def calendar_parts(t):
    return shown(
        t.strikes().select(
            "lightning_id",
            F.month("date").alias("month"),
            F.hour("date").alias("hour"),
            F.year("date").alias("year"),
            F.weekday("date").alias("dayofweek"),
        )
    )


@query(
    "union_sources",
    sql("strikes", "SELECT 'cg' AS source, lightning_id FROM strikes WHERE NOT icloud UNION ALL SELECT 'ic', lightning_id FROM strikes WHERE icloud"),
)
def union_sources(t):
    """Separately filtered parts appended by name."""
    s = t.strikes()
    cg = s.filter(is_cg()).select(F.lit("cg").alias("source"), "lightning_id")
    return cg.unionByName(s.filter("icloud").select("lightning_id", F.lit("ic").alias("source")))


@query(
    "alert_sessions",
    sql(
        "strikes",
        "SELECT user_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM ev2 GROUP BY 1, 2",
    ),
)
def alert_sessions(t):
    return sessions(t.raw_strikes(), ["user_id"])


SCANNED = ["lightning_id", "airport", "airport_alert_id", "dist", "azimuth", "amplitude", "maxis", "icloud"]


@query(
    "scan_csv",
    sql("strikes", f"SELECT {', '.join(SCANNED)}, us, is_last AS is_last_lightning_cloud_ground FROM strikes"),
)
def scan_csv(t):
    """Strikes written as CSV and read through the upload contract."""
    path = new_path(t.spark, "csv")
    write_table(t.strikes(), path, "csv")
    return read_strikes(t.spark, path).select(*SCANNED, F.unix_micros("date").alias("us"), "is_last_lightning_cloud_ground")


@query("scan_sample", sql("strikes", "SELECT least(count(*), 1000) AS n_rows, least(count(*), 1000) AS n_known, least(count(*), 1000) AS n_ids FROM strikes"))
def scan_sample(t):
    """A row-capped scan of a CSV: how many rows came, how many are strikes of the table, how many differ."""
    path = new_path(t.spark, "csv")
    write_table(t.strikes(), path, "csv")
    taken = read_strikes(t.spark, path, rows=1000).select("lightning_id")
    known = taken.join(t.strikes().select("lightning_id", F.lit(True).alias("known")), "lightning_id", "left")
    return known.agg(F.count(F.lit(1)).alias("n_rows"), F.count("known").alias("n_known"), F.countDistinct("lightning_id").alias("n_ids"))


@query(
    "rejected_rows",
    sql(
        "strikes",
        """SELECT lightning_id, CASE lightning_id % 20 WHEN 1 THEN 'date' WHEN 2 THEN 'airport' ELSE 'malformed' END AS reason,
             (SELECT count(*) FROM strikes WHERE lightning_id % 20 NOT IN (1, 2, 3)) AS n_accepted
           FROM strikes WHERE lightning_id % 20 IN (1, 2, 3)""",
    ),
)
def rejected_rows(t):
    """Rows of a CSV upload that are no strikes, each with its reason, and how many were taken."""
    path, kind = new_path(t.spark, "upload"), F.col("lightning_id") % 20
    fields = [F.col(c).cast("string").alias(c) for c in ("lightning_id", "date", "airport", "airport_alert_id", "dist", "azimuth", "amplitude", "maxis", "icloud")]
    broken = t.strikes().select(*fields).withColumns({"date": F.when(kind == 1, "no time").otherwise(F.col("date")), "airport": F.when(kind == 2, None).otherwise(F.col("airport"))})
    line = F.to_csv(F.struct(*broken.columns))
    broken.select(F.when(kind == 3, F.substring_index(line, ",", 4)).otherwise(line).alias("value")).write.text(path)
    good, rejected = read_strikes_checked(t.spark, path, columns=broken.columns)
    return rejected.select(F.col("lightning_id").cast("bigint").alias("lightning_id"), "reason", F.lit(good.count()).cast("bigint").alias("n_accepted"))
