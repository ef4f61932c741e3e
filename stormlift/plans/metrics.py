"""Metric queries on the three fixture scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormlift.operators import metrics as M
from stormlift.plans.base import query, s6, s6s, shown, sql

SCORES = ["s1", "s2", "s3"]


def table_cte(source: str = "scored", by: str = "", score: str = "s1", tag: str = "") -> list[str]:
    """The distinct-score table by plain windows, and the curve columns on top."""
    cols, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return [
        f"""tally{tag} AS (SELECT {cols}{score} AS score, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY {cols}{score})""",
        f"""st{tag} AS (SELECT {cols}score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
              CAST(sum(pos) OVER ({part} ORDER BY score DESC) AS BIGINT) AS tp,
              CAST(sum(neg) OVER ({part} ORDER BY score DESC) AS BIGINT) AS fp,
              CAST(sum(pos) OVER ({part}) AS BIGINT) AS p, CAST(sum(neg) OVER ({part}) AS BIGINT) AS n FROM tally{tag})""",
        f"""cv{tag} AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS "precision",
              CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END AS recall,
              CASE WHEN n > 0 THEN fp / CAST(n AS DOUBLE) ELSE 0 END AS fpr FROM st{tag})""",
        f"""f1{tag} AS (SELECT *, 2 * "precision" * recall / ("precision" + recall + 1e-8) AS f1 FROM cv{tag})""",
    ]


def all_metrics(by: str, tag: str = "") -> str:
    """Every metric at the F1-optimal threshold, per group."""
    cols, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {cols}p + n AS n, p AS n_pos, {s6s('auc_roc', 'auc_pr')},
      {s6('tp / CAST(tp + fp AS DOUBLE)', '"precision"')}, {s6('CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END', 'recall')},
      {s6('2 * tp / CAST(2 * tp + fp + p - tp AS DOUBLE)', 'f1')},
      {s6('''coalesce((CAST(tp AS DOUBLE) * (n - fp) - CAST(fp AS DOUBLE) * (p - tp))
           / nullif(sqrt(tp + fp) * sqrt(p) * sqrt(n) * sqrt(n - fp + p - tp), 0), 0)''', 'mcc')},
      {s6('score', 'best_threshold')}
      FROM (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY f1 DESC, score) AS rn FROM f1{tag}) WHERE rn = 1)
      JOIN (SELECT {cols}sum(neg * (tp - pos / 2e0)) / nullif(max(p) * max(n), 0) AS auc_roc,
                   sum(pos * "precision") / nullif(max(p), 0) AS auc_pr FROM f1{tag} {f"GROUP BY {by}" if by else ""}) {on}"""


def scored(t, score: str = "s1"):
    return t.scored_table().withColumn("score", F.col(score))


def grid_sql(points: int, by: str = "", tag: str = "", source: str = "scored", score: str = "s1") -> list[str]:
    cols = f"{by}, " if by else ""
    ts = ", ".join(f"({x!r}e0)" if "e" not in repr(x) else f"({x!r})" for x in M.grid(points))
    return [
        f"""sweep{tag} AS (SELECT {cols}threshold, sum(CASE WHEN {score} >= threshold THEN y ELSE 0 END) AS tp,
              sum(CASE WHEN {score} >= threshold THEN 1 - y ELSE 0 END) AS fp, sum(y) AS p
            FROM {source}, (VALUES {ts}) g(threshold) GROUP BY {cols}threshold)""",
        f"""swept{tag} AS (SELECT {cols}threshold, CASE WHEN p + tp + fp > 0 THEN 2 * tp / CAST(p + tp + fp AS DOUBLE) ELSE 0 END AS f1,
              CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS "precision",
              CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END AS recall FROM sweep{tag})""",
    ]


@query(
    "roc_auc",
    sql(
        "scored",
        f"""SELECT (SELECT count(*) FROM scored WHERE y = 1) AS n_pos, (SELECT count(*) FROM scored WHERE y = 0) AS n_neg,
            {s6('sum(neg * (tp - pos / 2e0)) / (max(p) * max(n))', 'auc_roc')} FROM st""",
        *table_cte(),
    ),
)
def roc_auc(t):
    m = M.rank_metrics(M.score_table(scored(t)))
    return shown(m.select("n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"), "auc_roc"))


@query(
    "avg_precision",
    sql("scored", f"""SELECT {s6('sum(pos * "precision") / max(p)', 'auc_pr')} FROM cv""", *table_cte()),
)
def avg_precision(t):
    return shown(M.rank_metrics(M.score_table(scored(t))).select("auc_pr"))


@query(
    "pr_curve",
    sql("scored", f"""SELECT {s6('score', 'threshold')}, tp, fp, {s6s('"precision"', 'recall', 'f1')} FROM f1""", *table_cte(score="s3")),
)
def pr_curve(t):
    c = M.curves(M.score_table(scored(t, "s3")))
    return shown(c.select(F.col("score").alias("threshold"), "tp", "fp", "precision", "recall", "f1"))


@query(
    "roc_curve",
    sql("scored", f"SELECT {s6('score', 'threshold')}, tp, fp, {s6('recall', 'tpr')}, {s6s('fpr')} FROM cv", *table_cte(score="s3")),
)
def roc_curve(t):
    c = M.curves(M.score_table(scored(t, "s3")))
    return shown(c.select(F.col("score").alias("threshold"), "tp", "fp", F.col("recall").alias("tpr"), "fpr"))


@query(
    "best_f1_threshold",
    sql(
        "scored",
        f"SELECT {s6('score', 'best_threshold')}, {s6('f1', 'best_f1')} FROM f1 ORDER BY f1.f1 DESC, score LIMIT 1",
        *table_cte(),
    ),
)
def best_f1_threshold(t):
    return shown(M.rank_metrics(M.score_table(scored(t))).select("best_threshold", "best_f1"))


@query(
    "confusion_metrics",
    sql(
        "scored",
        f"""SELECT tp, fp, fn, tn, {s6('tp / CAST(tp + fp AS DOUBLE)', '"precision"')}, {s6('tp / CAST(tp + fn AS DOUBLE)', 'recall')},
            {s6('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)', 'f1')},
            {s6('(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))', 'mcc')}
            FROM (SELECT count(*) FILTER (WHERE s1 >= 0.85e0 AND y = 1) AS tp, count(*) FILTER (WHERE s1 >= 0.85e0 AND y = 0) AS fp,
                         count(*) FILTER (WHERE s1 < 0.85e0 AND y = 1) AS fn, count(*) FILTER (WHERE s1 < 0.85e0 AND y = 0) AS tn
                  FROM scored)""",
    ),
)
def confusion_metrics(t):
    return shown(M.metrics_at(scored(t), 0.85))


@query("f1_grid_100", sql("scored", f"""SELECT {s6s('threshold', 'f1', '"precision"', 'recall')} FROM swept""", *grid_sql(100)))
def f1_grid_100(t):
    return shown(M.f1_on_grid(scored(t), 100))


@query(
    "f1_grid_200",
    sql(
        "scored",
        f"""SELECT {s6s('threshold', 'f1', '"precision"', 'recall')} FROM swept ORDER BY swept.f1 DESC, swept.threshold LIMIT 1""",
        *grid_sql(200),
    ),
)
def f1_grid_200(t):
    return shown(M.best_on_grid(scored(t), 200))


@query("binary_metrics", sql("scored", all_metrics(""), *table_cte()))
def binary_metrics(t):
    return shown(M.binary_metrics(scored(t)))


@query("metrics_by_airport", sql("scored", all_metrics("airport"), *table_cte(by="airport")))
def metrics_by_airport(t):
    return shown(M.binary_metrics(scored(t), ["airport"]))


@query(
    "airport_metrics_json",
    sql(
        "scored",
        f"""SELECT airport, '{{' || CASE WHEN auc_roc IS NULL THEN '' ELSE '"auc":' || CAST(auc_roc AS DECIMAL(9,6)) || ',' END
              || '"f1":' || CAST(f1 AS DECIMAL(9,6)) || ',"precision":' || CAST("precision" AS DECIMAL(9,6))
              || ',"recall":' || CAST(recall AS DECIMAL(9,6)) || ',"threshold":' || CAST(best_threshold AS DECIMAL(9,6))
              || ',"n":' || n || ',"n_pos":' || n_pos || '}}' AS json FROM ({all_metrics("airport")})""",
        *table_cte(by="airport"),
    ),
)
def airport_metrics_json(t):
    """Per-airport metrics as JSON text, the form the JSON sink writes."""
    m = shown(M.binary_metrics(scored(t), ["airport"]))
    six = [F.col(c).cast("decimal(9,6)").alias(n) for c, n in
           (("auc_roc", "auc"), ("f1", "f1"), ("precision", "precision"), ("recall", "recall"), ("best_threshold", "threshold"))]
    return m.select("airport", F.to_json(F.struct(*six, "n", "n_pos")).alias("json"))


TALL = "tall AS (" + " UNION ALL ".join(f"SELECT '{s}' AS name, y, {s} AS s FROM scored" for s in (*SCORES, "ensemble")) + ")"
TALL = TALL.replace("ensemble AS s FROM", "(s1 + s2 + s3) / 3 AS s FROM")


@query("model_table", sql("scored", all_metrics("name"), TALL, *table_cte("tall", "name", "s")))
def model_table(t):
    return shown(M.model_table(M.mean_ensemble(t.scored_table(), SCORES), [*SCORES, "ensemble"]))


@query(
    "top_models",
    sql(
        "scored",
        f"""SELECT name, {s6s('f1')} FROM (SELECT name, 2 * tp / CAST(tp + fp + p AS DOUBLE) AS f1,
              row_number() OVER (PARTITION BY name ORDER BY f1.f1 DESC, score) AS rn FROM f1) x WHERE rn = 1
            ORDER BY x.f1 DESC, name LIMIT 2""",
        TALL,
        *table_cte("tall", "name", "s"),
    ),
)
def top_models(t):
    table = M.model_table(M.mean_ensemble(t.scored_table(), SCORES), [*SCORES, "ensemble"])
    return shown(table.select("name", "f1").orderBy(F.desc("f1"), "name").limit(2))


@query(
    "ensemble_mean",
    sql("scored", f"SELECT lightning_id, {s6('(s1 + s2 + s3) / 3', 'ensemble')} FROM scored"),
)
def ensemble_mean(t):
    return shown(M.mean_ensemble(t.scored_table(), SCORES).select("lightning_id", "ensemble"))


@query(
    "fold_summary",
    sql(
        "scored",
        "SELECT "
        + ", ".join(
            s6(f"{a}({c})", f"{n}_{tag}")
            for c, n in (("auc_roc", "auc"), ("auc_pr", "ap"), ("best", "f1"))
            for a, tag in (("avg", "mean"), ("stddev_pop", "sd"))
        )
        + """ FROM (SELECT fold, sum(neg * (tp - pos / 2e0)) / (max(p) * max(n)) AS auc_roc,
                    sum(pos * "precision") / max(p) AS auc_pr FROM cv GROUP BY fold)
              JOIN (SELECT fold, max(f1) AS best FROM swept GROUP BY fold) USING (fold)""",
        *table_cte(by="fold"),
        *grid_sql(100, "fold"),
    ),
)
def fold_summary(t):
    return shown(M.fold_summary(scored(t)))


TALL2 = "tall AS (SELECT 'old' AS name, y, s2 AS s FROM scored UNION ALL SELECT 'new', y, s1 FROM scored)"


@query(
    "oof_compare",
    sql(
        "scored",
        "SELECT "
        + ", ".join(s6(f"max({c}) FILTER (WHERE name = '{n}')", f"{n}_{c}") for n in ("old", "new") for c in ("auc_roc", "f1", "threshold"))
        + f""", {s6("max(f1) FILTER (WHERE name = 'new') - max(f1) FILTER (WHERE name = 'old')", "delta_f1")}
          FROM (SELECT name, sum(neg * (tp - pos / 2e0)) / (max(p) * max(n)) AS auc_roc FROM cv GROUP BY name)
          JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f1 DESC, threshold) AS rn FROM swept)
                WHERE rn = 1) USING (name)""",
        TALL2,
        *table_cte("tall", "name", "s"),
        *grid_sql(200, "name", source="tall", score="s"),
    ),
)
def oof_compare(t):
    rows = t.scored_table()
    keys = ["airport", "airport_alert_id", "lightning_id"]
    old = rows.select(*keys, F.col("s2").alias("score"))
    return shown(M.oof_compare(old, rows.select(*keys, "y", F.col("s1").alias("score")), keys))


@query(
    "calibration_bins",
    sql(
        "scored",
        f"""SELECT CAST(least(floor(s3 * 10), 9) AS BIGINT) AS bin, count(*) AS n, {s6('avg(s3)', 'mean_score')},
            {s6('avg(y)', 'pos_rate')} FROM scored GROUP BY 1""",
    ),
)
def calibration_bins(t):
    return shown(M.calibration(scored(t, "s3")))
