"""Training queries. Models are kept small; what they return is checked by properties, not by SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stormlift.functions.scalars import in_alert
from stormlift.operators import airports as AP
from stormlift.operators import evaluate as E
from stormlift.operators import learn as L
from stormlift.operators import metrics as M
from stormlift.operators.decide import prediction_rows
from stormlift.operators.features import MODEL_COLUMNS, encode_airport, model_matrix
from stormlift.operators.neighbours import nearest
from stormlift.operators.ordered import layout
from stormlift.plans.base import query, s6, shown, sql
from stormlift.workspace import materialise, new_path

SIZE, DEPTH, STEP = 5, 3, 0.1
PLAIN = ["dt_prev_s", "dist", "amplitude", "maxis", "azimuth"]
IDS = ["lightning_id", "airport", "airport_alert_id", "y", "fold"]
CUT_US = 1_704_067_200_000_000 + 21_600_000_000


def training(t):
    """The labelled model matrix with folds and the vector of its columns, written once per session and input."""

    def write():
        rows = t.features().withColumn("y", F.col("is_last_lightning_cloud_ground").cast("int"))
        rows = L.with_folds(model_matrix(encode_airport(rows), MODEL_COLUMNS))
        keys = ["lightning_id", "date", "airport", "airport_alert_id", "y", "fold"]
        return materialise(L.assembled(rows.select(*keys, *MODEL_COLUMNS), MODEL_COLUMNS), "training", L.FILE_ROWS)

    return t.once("training", write)


def shown_scores(df):
    return shown(df.select(*IDS, "score"))


FOLDED = """folds AS (
  SELECT airport AS fap, airport_alert_id AS fid, CASE WHEN m < 5 THEN m ELSE 9 - m END AS fold
  FROM (SELECT airport, airport_alert_id,
               (row_number() OVER (ORDER BY count(*) DESC, airport, airport_alert_id) - 1) % 10 AS m
        FROM cg GROUP BY 1, 2))"""


@query("group_kfold", sql("cg", "SELECT fap AS airport, fid AS airport_alert_id, fold FROM folds", FOLDED))
def group_kfold(t):
    return L.group_folds(t.strikes().filter(in_alert() & ~F.col("icloud")))


@query(
    "class_weights",
    sql(
        "cg",
        f"""SELECT CAST(is_last AS BIGINT) AS y, count(*) AS n_class,
            {s6('(SELECT count(*) FROM cg) / (2e0 * count(*))', 'balanced')},
            {s6('CASE WHEN is_last THEN (SELECT count(*) FILTER (WHERE NOT is_last) / CAST(count(*) FILTER (WHERE is_last) AS DOUBLE) FROM cg) ELSE 1e0 END', 'scaled')}
            FROM cg GROUP BY is_last""",
    ),
)
def class_weights(t):
    rows = t.strikes().filter(F.col("is_last_lightning_cloud_ground").isNotNull())
    return shown(L.class_weights(rows.withColumn("y", F.col("is_last_lightning_cloud_ground").cast("int"))))


@query("train_gbt")
def train_gbt(t):
    rows = training(t)
    return shown_scores(L.score(rows, L.fit(rows, MODEL_COLUMNS, "gbt_balanced")))


@query("train_rf")
def train_rf(t):
    rows = training(t)
    return shown_scores(L.score(rows, L.fit(rows, MODEL_COLUMNS, "forest_balanced", SIZE, DEPTH)))


@query("train_lr")
def train_lr(t):
    rows = training(t)
    return shown_scores(L.score(rows, L.fit(rows, MODEL_COLUMNS, "logistic_balanced")))


#: What the store holds: boosted trees three ways, a forest and the logistic regression, each with all its configured
#: trees and depth: 1,200 trees of depth 7, 500 of depth 15, and the regression to convergence.
STORED = {"gbt_balanced": {}, "gbt_scaled": {}, "gbt_v4": {}, "forest_balanced": {}, "logistic_balanced": {}}


def stored(t):
    """Out-of-fold scores of five models, written once."""
    return t.once("oof-store", lambda: L.oof_store(training(t), MODEL_COLUMNS, STORED, new_path(t.spark, "oof-store")))


@query("oof_scores")
def oof_scores(t):
    return shown_scores(stored(t).filter("model = 'gbt_balanced'"))


@query("oof_metrics")
def oof_metrics(t):
    """Metrics of the out-of-fold scores of every stored model, best F1 first."""
    return shown(M.binary_metrics(stored(t).withColumnRenamed("model", "name"), ["name"]).orderBy(F.desc("f1")))


@query(
    "oof_store_checks",
    sql(
        "cg",
        "SELECT model, (SELECT count(*) FROM cg) AS n, (SELECT count(*) FROM cg WHERE is_last) AS n_pos, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS out_of_range, "
        f"CAST(0 AS BIGINT) AS wrong_fold FROM (VALUES {', '.join(f'({c!r})' for c in STORED)}) m(model)",
    ),
)
def oof_store_checks(t):
    """Every stored model has one score between 0 and 1 for each strike, in the fold its alert was dealt to."""
    rows = stored(t).join(L.group_folds(t.strikes().filter(in_alert() & ~F.col("icloud"))).withColumnRenamed("fold", "dealt"), ["airport", "airport_alert_id"], "left")
    once = rows.groupBy("model", "lightning_id").agg(F.count("*").alias("times"), F.max("y").alias("y"), F.max("score").alias("score"), F.max(~F.col("fold").eqNullSafe(F.col("dealt"))).alias("off"))
    return once.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("times") > 1).alias("twice"),
        F.count_if(~F.col("score").between(0, 1)).alias("out_of_range"), F.count_if("off").alias("wrong_fold"),
    )


@query("train_early_stop")
def train_early_stop(t):
    """Boosting stopped by a held-back training fold; every fold is scored by the model that has not seen it."""
    rows = training(t)
    parts = [
        L.score(rows.filter(F.col("fold") == f), L.fit(rows.filter(F.col("fold") != f), MODEL_COLUMNS, "gbt_v4", stop_fold=(f + 1) % L.FOLDS))
        for f in range(L.FOLDS)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return shown_scores(out)


def airport_models(t):
    """Every airport's models of all folds, and the global ones; fitted once."""

    def fit():
        rows = training(t)
        return AP.fit_airports(rows, MODEL_COLUMNS), AP.fit_airports(rows, MODEL_COLUMNS, own=False)

    return t.once("airport-models", fit)


def airport_scores(t):
    return t.once("airport-oof", lambda: materialise(AP.score_airports(training(t), MODEL_COLUMNS, *airport_models(t), by_fold=True).select(*IDS, "score", "model"), "airport-oof"))


@query("train_per_airport")
def train_per_airport(t):
    """Out-of-fold scores of every strike by its airport's own models."""
    return shown_scores(airport_scores(t))


@query("airport_oof_metrics")
def airport_oof_metrics(t):
    """Seven fields for every airport, at its own best threshold on out-of-fold scores."""
    return shown(AP.airport_metrics(airport_scores(t)))


BOTH_CLASSES = "SELECT airport, count(*) AS n, count(*) FILTER (WHERE is_last) AS n_pos FROM cg GROUP BY 1"


@query(
    "airport_oof_checks",
    sql("cg", f"SELECT airport, n, n_pos, CAST(5 AS BIGINT) AS folds, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS twice FROM ({BOTH_CLASSES})"),
)
def airport_oof_checks(t):
    """What must hold for any model: each strike of an airport scored once, by its fold's models, between 0 and 1."""
    once = airport_scores(t).groupBy("airport", "lightning_id").agg(F.count("*").alias("times"), F.max("y").alias("y"), F.max("fold").alias("fold"), F.max("score").alias("score"))
    return once.groupBy("airport").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), F.count_distinct("fold").alias("folds"),
        F.count_if(~F.col("score").between(0, 1)).alias("out_of_range"), F.count_if(F.col("times") > 1).alias("twice"),
    )


def airport_pack(t):
    """The airports' models saved with their thresholds as a pack of two versions, and its newest loaded."""

    def write():
        path, (own, whole) = new_path(t.spark, "airport-pack"), airport_models(t)
        for version in (1, 2):
            AP.save_airport_pack(path, version, MODEL_COLUMNS, own, whole, AP.airport_metrics(airport_scores(t)))
        return path

    return AP.load_airport_pack(t.spark, t.once("airport-pack", write))


@query("score_with_fallback")
def score_with_fallback(t):
    """Every airport by its own row of the pack, airports without one by the global row."""
    return shown_scores(AP.apply_airport_pack(training(t), airport_pack(t)))


@query(
    "pack_routing",
    sql("cg", f"SELECT airport, CASE WHEN n_pos > 0 AND n_pos < n THEN 'own' ELSE 'global' END AS model, n FROM ({BOTH_CLASSES})"),
)
def pack_routing(t):
    """Which row of the pack scored how many strikes of an airport."""
    return AP.apply_airport_pack(training(t), airport_pack(t)).groupBy("airport", "model").agg(F.count("*").alias("n"))


@query("score")
def score(t):
    """A pack saved, loaded and applied."""
    rows = training(t)
    path = new_path(t.spark, "pack")
    L.save_pack(path, L.fit(rows, MODEL_COLUMNS, "logistic_balanced"), MODEL_COLUMNS, 0.85,
                rows.select("airport", F.col("airport_enc").cast("bigint").alias("airport_enc")).distinct())
    scored = L.score_pack(rows, L.load_pack(t.spark, path)).withColumnRenamed("confidence", "score")
    return shown_scores(scored)


@query("feature_importance")
def feature_importance(t):
    rows = training(t)
    return shown(L.feature_importance(L.fit(rows, MODEL_COLUMNS, "forest_balanced", SIZE, DEPTH)))


@query("top_features")
def top_features(t):
    """The twenty model columns of largest importance."""
    rows = training(t)
    table = L.feature_importance(L.fit(rows, MODEL_COLUMNS, "gbt_balanced", SIZE, DEPTH, step=STEP))
    return shown(L.top_features(table, 20))


@query("stacking")
def stacking(t):
    """A meta-learner over the out-of-fold scores of the five stored models, on the same outer folds."""
    return shown(L.stack(L.aligned(stored(t), list(STORED)), list(STORED)).select(*IDS, "stacked"))


@query("ensemble_oof")
def ensemble_oof(t):
    """The mean of three stored models' scores, strike by strike."""
    three = list(STORED)[:3]
    return shown(M.mean_ensemble(L.aligned(stored(t), three), three).select(*IDS, *three, "ensemble"))


@query("calibrate_isotonic")
def calibrate_isotonic(t):
    rows = t.scored_table().withColumn("score", F.col("s1"))
    fitted = L.isotonic(rows).transform(rows.withColumn("features", F.col("score")))
    return shown(fitted.select("lightning_id", "score", F.col("prediction").alias("calibrated")))


@query("calibrate_platt")
def calibrate_platt(t):
    rows = t.scored_table().withColumn("score", F.col("s3"))
    model = L.platt(rows)
    line = F.lit(float(model.coefficients[0])), F.lit(float(model.intercept))
    p = F.least(F.greatest(F.col("score"), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = line[0] * F.log(p / (1 - p)) + line[1]
    return shown(rows.select("lightning_id", "score", (1 / (1 + F.exp(-odds))).alias("calibrated")))


@query(
    "calibration_checks",
    sql(
        "scored",
        "SELECT name AS model, n, pos AS n_pos, CAST(0 AS BIGINT) AS mean_off, CAST(0 AS BIGINT) AS falls FROM "
        "(SELECT unnest(['isotonic', 'platt']) AS name, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM scored)",
    ),
)
def calibration_checks(t):
    """What must hold for both calibrations: the mean is the positive rate; isotonic never falls, the line never turns."""
    out = []
    for name, source, least in (("isotonic", "s1", 1e-6), ("platt", "s3", 1e-3)):
        rows = t.scored_table().withColumn("score", F.col(source)).select("lightning_id", "score", "y")
        made = (calibrate_isotonic if name == "isotonic" else calibrate_platt)(t).select("lightning_id", "calibrated")
        both = rows.join(made, "lightning_id")
        # equal calibrated values are one block of scores; runs of blocks are compared within ranges of the score
        blocks = both.groupBy("calibrated").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        cut = layout(blocks, [], ["lo"], "blocks")
        near = Window.partitionBy("_part").orderBy("_row")
        overlap = F.lag("hi").over(near) > F.col("lo")
        fell, rose = (F.lag("calibrated").over(near) >= F.col("calibrated")) | overlap, (F.lag("calibrated").over(near) <= F.col("calibrated")) | overlap
        turns = cut.select(fell.alias("fell"), rose.alias("rose"))
        # a line through the log-odds falls everywhere if the score points the wrong way, but never turns
        falls = turns.agg((F.count_if("fell") if name == "isotonic" else F.least(F.count_if("fell"), F.count_if("rose"))).alias("falls"))
        means = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), F.avg("calibrated").alias("c"), F.avg("y").alias("y"))
        off = F.coalesce(F.abs(F.col("c") - F.col("y")) > least, F.lit(False)).cast("bigint")
        out.append(means.select(F.lit(name).alias("model"), "n", "n_pos", off.alias("mean_off")).withColumn("falls", falls.scalar()))
    return out[0].unionByName(out[1])


@query(
    "importance_checks",
    "SELECT name AS model, CAST(%d AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS negative, CAST(1 AS BIGINT) AS sums_to_one, CAST(20 AS BIGINT) AS n_top, "
    "CAST(0 AS BIGINT) AS larger_outside FROM (VALUES ('gbt_balanced')) m(name)" % len(MODEL_COLUMNS),
)
def importance_checks(t):
    """What must hold for any importances: one a column, none negative, sum 1, none larger outside the top twenty."""
    table = L.feature_importance(L.fit(training(t), MODEL_COLUMNS, "gbt_balanced", SIZE, DEPTH, step=STEP))
    top = L.top_features(table, 20)
    all_of = table.join(top.select("feature", F.lit(True).alias("top")), "feature", "left")
    least = F.min(F.when(F.col("top"), F.col("importance")))
    most = F.max(F.when(F.col("top").isNull(), F.col("importance")))
    return all_of.agg(
        F.lit("gbt_balanced").alias("model"), F.countDistinct("feature").alias("n_columns"), F.count_if(F.col("importance") < 0).alias("negative"),
        (F.abs(F.sum("importance") - 1) < 1e-9).cast("bigint").alias("sums_to_one"), F.count("top").alias("n_top"), (most > least).cast("bigint").alias("larger_outside"),
    )


def later_alerts(t):
    """Alerts whose first strike of any kind comes after the cut: none stands on both sides."""
    starts = t.strikes().filter(in_alert()).groupBy("airport", "airport_alert_id").agg(F.min(F.unix_micros("date")).alias("start"))
    return starts.filter(F.col("start") > CUT_US).select("airport", "airport_alert_id")


def later_strikes(t):
    """Strikes of later alerts, and strikes outside alerts after the cut."""
    strikes = t.strikes()
    inside = strikes.join(later_alerts(t), ["airport", "airport_alert_id"], "left_semi")
    return inside.unionByName(strikes.filter(F.col("airport_alert_id").isNull() & (F.unix_micros("date") > CUT_US)).select(*inside.columns))


def later_scores(t):
    """CG strikes of later alerts, scored by a model fitted on all earlier alerts; written once."""

    def write():
        rows, late = training(t), materialise(later_alerts(t), "later-alerts")
        model = L.fit(rows.join(late, ["airport", "airport_alert_id"], "left_anti"), MODEL_COLUMNS, "logistic_balanced")
        return materialise(L.score(rows.join(late, ["airport", "airport_alert_id"], "left_semi"), model, "confidence"), "later")

    return t.once("later", write)


@query("end_to_end_curve")
def end_to_end_curve(t):
    """Train before a date, score after it, and weigh the decisions of every threshold."""
    return shown(E.gain_risk_curve(later_strikes(t), prediction_rows(later_scores(t))))


@query(
    "end_to_end_checks",
    sql(
        "cg",
        f"""SELECT (SELECT count(*) FROM cg JOIN started USING (airport, airport_alert_id) WHERE start > {CUT_US}) AS n_scored,
             CAST(0 AS BIGINT) AS out_of_range, CAST(20 AS BIGINT) AS thetas,
             CAST(0 AS BIGINT) AS gain_rises, CAST(0 AS BIGINT) AS misses_rise, CAST(0 AS BIGINT) AS covered_rises,
             (SELECT count(*) FROM strikes LEFT JOIN started USING (airport, airport_alert_id)
              WHERE coalesce(start, us) > {CUT_US} AND dist < 3) AS danger,
             (SELECT count(*) FROM started WHERE start > {CUT_US}) AS alerts_total""",
        "started AS (SELECT airport, airport_alert_id, min(us) AS start FROM strikes WHERE airport_alert_id IS NOT NULL GROUP BY 1, 2)",
    ),
)
def end_to_end_checks(t):
    """What must hold for any model: one score a strike, and nothing grows with the threshold."""
    scored = later_scores(t)
    curve = E.gain_risk_curve(later_strikes(t), prediction_rows(scored))
    order = Window.orderBy("theta")  # twenty rows
    rises = {c: F.col(c) > F.lag(c).over(order) + 1e-9 for c in ("gain_h", "missed", "alerts_covered")}
    steps = curve.withColumns({f"{c}_rises": r for c, r in rises.items()})
    held = steps.agg(
        F.count("*").alias("thetas"),
        F.count_if("gain_h_rises").alias("gain_rises"),
        F.count_if("missed_rises").alias("misses_rise"),
        F.count_if("alerts_covered_rises").alias("covered_rises"),
        F.max("danger").alias("danger"),
        F.max("alerts_total").alias("alerts_total"),
    )
    seen = scored.agg(F.count("*").alias("n_scored"), F.count_if(~F.col("confidence").between(0, 1)).alias("out_of_range"))
    return shown(seen.withColumn("_", F.lit(1)).join(held.withColumn("_", F.lit(1)), "_").drop("_"))  # one row each


@query("end_to_end_best", None)
def end_to_end_best(t):
    """The threshold to run with, from the scores of strikes the model has not seen."""
    return shown(E.best_theta(E.gain_risk_curve(later_strikes(t), prediction_rows(later_scores(t)))))


def plain_rows(t):
    rows = t.features(context=False)
    label = F.col("is_last_lightning_cloud_ground").cast("int").alias("y")
    return materialise(rows.select("lightning_id", label, *PLAIN), "plain")


DISTANCE = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in PLAIN) + ")"


@query(
    "minority_neighbours",
    sql(
        "cg",
        f"""SELECT id, nid, {s6('dist')}, place FROM (
              SELECT a.lightning_id AS id, b.lightning_id AS nid, {DISTANCE} AS dist,
                     row_number() OVER (PARTITION BY a.lightning_id ORDER BY {DISTANCE}, b.lightning_id) AS place
              FROM cg a JOIN cg b ON a.lightning_id <> b.lightning_id WHERE a.is_last AND b.is_last) n WHERE place <= 5""",
    ),
)
def minority_neighbours(t):
    """Five nearest positive rows of each positive row, the neighbours SMOTE interpolates to."""
    return shown(nearest(L.vectors(plain_rows(t).filter("y = 1"), PLAIN), 5))


@query("smote")
def smote(t):
    return shown(L.smote(plain_rows(t), PLAIN))


@query("smote_tomek")
def smote_tomek(t):
    return shown(L.smote_tomek(plain_rows(t), PLAIN))


@query(
    "tomek_links",
    sql(
        "cg",
        """SELECT x.id AS a, x.nid AS b FROM near x JOIN near y ON x.nid = y.id AND y.nid = x.id
           WHERE x.id < x.nid AND x.label <> y.label""",
        f"""near AS (SELECT a.lightning_id AS id, a.is_last AS label, arg_min(b.lightning_id, ({DISTANCE}, b.lightning_id)) AS nid
            FROM cg a JOIN cg b ON a.lightning_id <> b.lightning_id GROUP BY 1, 2)""",
    ),
)
def tomek_links(t):
    return L.tomek_links(plain_rows(t), PLAIN)
