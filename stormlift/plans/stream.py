"""Streaming queries: the whole strike table replayed file by file in several batches, the sink table returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormlift.operators import learn as L
from stormlift.operators.decide import first_crossing, prediction_rows
from stormlift.operators.features import CONTEXT, MODEL_COLUMNS, V3
from stormlift.plans import replay as R
from stormlift.plans.base import query, s6, shown, sql
from stormlift.plans.features import cols
from stormlift.plans.learn import training
from stormlift.streaming import flows as S
from stormlift.streaming import live as V
from stormlift.workspace import materialise, new_path


def replay(t, flow, table=None, **kw):
    return R.replay(t.strikes() if table is None else table, flow, **kw)


@query("stream_dedupe", sql("strikes", "SELECT lightning_id, airport, us FROM strikes"))
def stream_dedupe(t):
    """Every strike delivered twice, counted once."""
    out = replay(t, S.dedupe, copies=2).filter("lightning_id >= 0")
    return out.select("lightning_id", "airport", F.unix_micros("date").alias("us"))


@query(
    "stream_sessions",
    sql("strikes", "SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM ev2 GROUP BY user_id, session"),
)
def stream_sessions(t):
    raw = t.raw_strikes()
    return shown(replay(t, lambda s: S.live_sessions(s, ["user_id"]), raw).filter("user_id >= 0"))


@query(
    "stream_activity",
    sql(
        "strikes",
        """SELECT airport, (us // 60000000 - k) * 60000000 AS start_us, (us // 60000000 - k + 10) * 60000000 AS end_us,
           count(*) FILTER (WHERE icloud) AS n_ic, count(*) FILTER (WHERE NOT icloud) AS n_cg, count(*) AS n_all
           FROM strikes, range(10) r(k) GROUP BY 1, 2, 3""",
    ),
)
def stream_activity(t):
    return shown(replay(t, S.live_activity).filter("airport <> ''"))


INTS = S.INTEGERS


@query(
    "stream_features",
    sql(
        "feat",
        "SELECT lightning_id, us, airport, airport_alert_id, "
        + ", ".join(c if c in INTS else s6(c) for c in S.LIVE_FEATURES)
        + " FROM feat",
    ),
)
def stream_features(t):
    return shown(replay(t, S.live_features))


@query(
    "stream_decisions",
    sql(
        "scored",
        """SELECT airport, airport_alert_id, min(us) AS us FROM scored WHERE confidence >= 0.85e0 GROUP BY 1, 2""",
    ),
)
def stream_decisions(t):
    out = replay(t, lambda s: S.live_decisions(s, lambda f: min(1.0, f["dt_prev_s"] / 600)))
    return out.select("airport", "airport_alert_id", "us")


@query("stream_context", sql("feat", f"SELECT lightning_id, us, airport, {', '.join(CONTEXT)} FROM feat"))
def stream_context(t):
    return replay(t, S.live_context)


@query(
    "stream_features_full",
    sql("feat", f"SELECT lightning_id, us AS date_us, airport, airport_alert_id, is_last AS is_last_lightning_cloud_ground, {cols(V3)} FROM feat"),
)
def stream_features_full(t):
    """Every numeric model column of every CG strike in an alert, from the stream."""
    return shown(replay(t, V.live_rows))


THETA = 0.5


def stream_pack(t):
    """A logistic model fitted on all labelled strikes, saved and loaded as a pack; written once."""

    def write():
        rows, path = training(t), new_path(t.spark, "pack")
        codes = rows.select("airport", F.col("airport_enc").cast("bigint").alias("airport_enc")).distinct()
        L.save_pack(path, L.fit(rows, MODEL_COLUMNS, "logistic_balanced"), MODEL_COLUMNS, THETA, codes)
        return path

    return L.load_pack(t.spark, t.once("stream-pack", write))


@query(
    "stream_scored_checks",
    sql(
        "cg",
        """SELECT count(*) AS n_scored, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS unlike_batch,
             CAST(0 AS BIGINT) AS decided_twice, CAST(0 AS BIGINT) AS decided_unlike_batch FROM cg""",
    ),
)
def stream_scored_checks(t):
    """Strikes scored live by a fitted pack, and decided once an alert: how much differs from the batch form."""
    pack = stream_pack(t)
    batch = materialise(L.score_pack(t.features(), pack), "batch-scores")
    path, files = R.feed(t.strikes())
    ledger, scores = (V.Ledger(t.spark, new_path(t.spark, name)) for name in ("decisions", "scores"))
    kept = "lightning_id bigint, date timestamp, airport string, airport_alert_id bigint, confidence double"
    decide = V.decide_once(ledger, THETA)

    def sink(rows, no):
        """The batch's scores are written, and decided on as written: the stateful step runs once."""
        scores.write("scores", no, rows.select("lightning_id", "date", "airport", "airport_alert_id", "confidence"))
        scores.complete(no)
        decide(t.spark.read.schema(kept).parquet(f"{scores.path}/scores/batch={no}"), no)

    V.run_to_end(V.live_scores(R.source(path, t.strikes(), files), pack), sink, new_path(t.spark, "progress"))
    live = scores.read("scores", kept)
    decided = ledger.read("decisions", V.DECISION).groupBy("airport", "airport_alert_id").agg(F.min("us").alias("us"), F.count("*").alias("n"))
    want = first_crossing(prediction_rows(batch), THETA).select("airport", "airport_alert_id", F.unix_micros("predicted_end").alias("want_us"))
    far = F.abs(F.col("confidence") - F.col("batch")) > 1e-6
    seen = live.join(batch.select("lightning_id", F.col("confidence").alias("batch")), "lightning_id", "full")
    alike = seen.agg(F.count("confidence").alias("n_scored"), F.count_if(~F.col("confidence").between(0, 1)).alias("out_of_range"), F.count_if(F.coalesce(far, F.lit(True))).alias("unlike_batch"))
    ends = decided.join(want, ["airport", "airport_alert_id"], "full")
    ends = ends.agg(F.count_if(F.col("n") > 1).alias("decided_twice"), F.count_if(~F.col("us").eqNullSafe(F.col("want_us"))).alias("decided_unlike_batch"))
    return alike.withColumn("_", F.lit(1)).join(ends.withColumn("_", F.lit(1)), "_").drop("_")


@query(
    "stream_late",
    sql(
        "strikes",
        """SELECT lightning_id, airport, us FROM strikes, (SELECT min(us) AS lo, max(us) AS hi FROM strikes) b
           WHERE lightning_id % 5 = 0 AND us <= ((SELECT max(us) FROM strikes) // 1000) * 1000 - 600000000""",
    ),
)
def stream_late(t):
    """Every fifth strike delivered after all others: those that the watermark had passed by then, kept aside."""
    strikes = t.strikes()
    held = (F.col("lightning_id") % 5 == 0) & (F.col("date") < strikes.agg(F.max("date")).scalar())
    path = new_path(t.spark, "feed")
    files = max(1, -(-strikes.count() // R.FILE_ROWS))
    for part in (strikes.filter(~held), strikes.filter(held)):
        part.repartition(files).write.mode("append").parquet(path)
    ledger = V.Ledger(t.spark, new_path(t.spark, "late"))
    V.run_to_end(R.source(path, strikes, files), V.late_strikes(ledger), new_path(t.spark, "progress"))
    return ledger.read("late", "lightning_id bigint, date timestamp, airport string").select("lightning_id", "airport", F.unix_micros("date").alias("us"))
