"""Ranking and threshold metrics of scored, labelled rows.

Everything rests on one table: positives and negatives per distinct score, with running sums.
``by`` lists grouping columns; an empty list means the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlift.operators.ordered import running

EPS = 1e-8


def score_table(scored: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    """Per distinct score: ``pos``, ``neg`` there; ``tp``, ``fp`` at or above; totals ``P``, ``N``."""
    by = list(by)
    tally = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")
    )
    r = running(tally, by, ["score"], {"cpos": F.col("pos"), "cneg": F.col("neg")})
    return r.select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("cpos_total") - F.col("cpos") + F.col("pos")).alias("tp"),
        (F.col("cneg_total") - F.col("cneg") + F.col("neg")).alias("fp"),
        F.col("cpos_total").alias("P"),
        F.col("cneg_total").alias("N"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def curves(table: DataFrame) -> DataFrame:
    """``score_table`` with precision, recall, false-positive rate and F1 at each threshold."""
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("P")
    with_pr = table.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, p), "fpr": ratio(fp, F.col("N"))}
    )
    pr, rc = F.col("precision"), F.col("recall")
    return with_pr.withColumn("f1", 2 * pr * rc / (pr + rc + EPS))


def rank_metrics(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """ROC AUC (ties count half), average precision (steps), and the lowest threshold of best F1."""
    c = curves(table)
    wins = (F.col("neg") * (F.col("tp") - F.col("pos") / 2)).cast("double")
    top = F.max_by(F.struct("score", "f1"), F.struct("f1", -F.col("score")))
    out = c.groupBy(*by).agg(
        F.max("P").alias("n_pos"),
        F.max(F.col("P") + F.col("N")).alias("n"),
        (F.sum(wins) / F.nullif(F.max(F.col("P").cast("double") * F.col("N")), F.lit(0.0))).alias("auc_roc"),
        (F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.max("P"), F.lit(0))).alias("auc_pr"),
        top.alias("_top"),
    )
    return out.select(
        *by, "n", "n_pos", "auc_roc", "auc_pr", F.col("_top.score").alias("best_threshold"), F.col("_top.f1").alias("best_f1")
    )


def confusion(tp: Column, fp: Column, p: Column, n: Column) -> dict[str, Column]:
    """Precision, recall, F1 (0 where undefined) and Matthews' coefficient from the four counts."""
    fn, tn = p - tp, n - fp
    d = [c.cast("double") for c in (tp + fp, p, n, tn + fn)]
    under = F.sqrt(d[0]) * F.sqrt(d[1]) * F.sqrt(d[2]) * F.sqrt(d[3])
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, p),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp.cast("double") * tn - fp.cast("double") * fn, under),
    }


def metrics_at(scored: DataFrame, threshold: float, by: list[str] = (), score: str = "score") -> DataFrame:
    """Confusion metrics of ``score >= threshold``."""
    hit, pos = F.col(score) >= threshold, F.col("y") == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(pos).alias("P"),
        F.count_if(~pos).alias("N"),
    )
    cm = confusion(F.col("tp"), F.col("fp"), F.col("P"), F.col("N"))
    return counts.select(*by, "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"),
                         *[c.alias(k) for k, c in cm.items()])


def binary_metrics(scored: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    """All metrics at each group's own F1-optimal threshold."""
    by = list(by)
    c = curves(score_table(scored, by, score))
    top = F.max_by(F.struct("score", "tp", "fp"), F.struct("f1", -F.col("score")))
    wins = (F.col("neg") * (F.col("tp") - F.col("pos") / 2)).cast("double")
    one = c.groupBy(*by).agg(
        F.max("P").alias("P"),
        F.max("N").alias("N"),
        (F.sum(wins) / F.nullif(F.max(F.col("P").cast("double") * F.col("N")), F.lit(0.0))).alias("auc_roc"),
        (F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.max("P"), F.lit(0))).alias("auc_pr"),
        top.alias("t"),
    )
    cm = confusion(F.col("t.tp"), F.col("t.fp"), F.col("P"), F.col("N"))
    return one.select(
        *by,
        (F.col("P") + F.col("N")).alias("n"),
        F.col("P").alias("n_pos"),
        "auc_roc",
        "auc_pr",
        *[v.alias(k) for k, v in cm.items()],
        F.col("t.score").alias("best_threshold"),
    )


def grid(points: int, lo: float = 0.05, hi: float = 0.95) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (hi - lo) / (points - 1)
    return [lo + i * step for i in range(points - 1)] + [hi]


def f1_on_grid(scored: DataFrame, points: int, by: list[str] = (), score: str = "score") -> DataFrame:
    """F1, precision and recall at every grid threshold.

    Rows are counted by how many thresholds they pass, which the even spacing gives at once;
    the sums from above then run over at most ``points`` + 1 rows per group.
    """
    by = list(by)
    lo, hi = 0.05, 0.95
    step = (hi - lo) / (points - 1)

    def threshold(i: Column) -> Column:
        return F.when(i >= points - 1, F.lit(hi)).otherwise(F.lit(lo) + i * F.lit(step))

    s = F.col(score)
    guess = F.least(F.greatest(F.floor((s - lo) / step), F.lit(1)), F.lit(points - 2))  # off by one at most
    passed = sum(((s >= threshold(guess + i)).cast("bigint") for i in (0, 1)), guess - 1) + (
        s >= threshold(guess - 1)
    ).cast("bigint")
    tally = scored.groupBy(*by, passed.alias("k")).agg(
        F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")
    )
    groups = tally.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    zero = F.lit(0).cast("bigint")
    ks = F.explode(F.sequence(zero, F.lit(points).cast("bigint"))).alias("k")
    empty = groups.select(*by, ks).withColumns({"pos": zero, "neg": zero})
    full = tally.unionByName(empty).groupBy(*by, "k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    summed = full.select(
        *by,
        "k",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("P"),
        F.sum("neg").over(whole).alias("N"),
    ).filter(F.col("k") > 0)
    cm = confusion(F.col("tp"), F.col("fp"), F.col("P"), F.col("N"))
    at = threshold(F.col("k") - 1).alias("threshold")
    return summed.select(*by, at, *[cm[k].alias(k) for k in ("f1", "precision", "recall")])


def best_on_grid(scored: DataFrame, points: int, by: list[str] = (), score: str = "score") -> DataFrame:
    """The lowest grid threshold of best F1."""
    swept = f1_on_grid(scored, points, by, score)
    top = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold")))
    return swept.groupBy(*by).agg(top.alias("t")).select(*by, "t.*")


def calibration(scored: DataFrame, bins: int = 10, score: str = "score") -> DataFrame:
    """Mean score against positive rate in equal-width score bins."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    return scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg("y").alias("pos_rate")
    )


def mean_ensemble(scored: DataFrame, scores: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in scores[1:]), F.col(scores[0]))
    return scored.withColumn("ensemble", total / len(scores))


def model_table(scored: DataFrame, scores: list[str]) -> DataFrame:
    """One row of metrics per score column. The columns become rows of one table, swept once."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in scores])
    return binary_metrics(scored.select("y", F.inline(cells)), ["name"])


def fold_summary(scored: DataFrame, score: str = "score") -> DataFrame:
    """AUC, AP and best grid F1 per fold, as mean and population deviation over folds."""
    ranked = rank_metrics(score_table(scored, ["fold"], score), ["fold"])
    f1 = best_on_grid(scored, 100, ["fold"], score).select("fold", "f1")
    per_fold = ranked.join(f1, "fold")
    return per_fold.agg(
        *[
            agg(c).alias(f"{n}_{tag}")
            for c, n in (("auc_roc", "auc"), ("auc_pr", "ap"), ("f1", "f1"))
            for tag, agg in (("mean", F.avg), ("sd", F.stddev_pop))
        ]
    )


def oof_compare(old: DataFrame, new: DataFrame, keys: list[str], points: int = 200) -> DataFrame:
    """Two score sets over the same rows, joined by key: AUC, best grid F1 and their difference.

    A row without an old score counts as score 0 there.
    """
    both = new.select(*keys, "y", F.col("score").alias("new")).join(
        old.select(*keys, F.col("score").alias("old")), keys, "left"
    )
    cells = F.array(
        F.struct(F.lit("old").alias("name"), F.coalesce("old", F.lit(0.0)).alias("score")),
        F.struct(F.lit("new").alias("name"), F.col("new").alias("score")),
    )
    tall = both.select("y", F.inline(cells))
    m = rank_metrics(score_table(tall, ["name"]), ["name"]).select("name", "auc_roc")
    m = m.join(best_on_grid(tall, points, ["name"]).select("name", "f1", "threshold"), "name")

    def one(name: str, c: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(c)))

    return m.agg(
        *[one(n, c).alias(f"{n}_{c}") for n in ("old", "new") for c in ("auc_roc", "f1", "threshold")],
        (one("new", "f1") - one("old", "f1")).alias("delta_f1"),
    )
