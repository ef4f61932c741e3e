"""Training and scoring on Spark ML: folds, weights, resampling, out-of-fold scores, packs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlift.functions.scalars import ALERT
from stormlift.operators.features import model_matrix, with_missing_as_zero
from stormlift.operators.grow import TASK_ROWS, Boosting, Forest
from stormlift.operators.neighbours import nearest
from stormlift.operators.ordered import dense_index
from stormlift.workspace import materialise, new_path

FOLDS = 5
SEED = 42
FILE_ROWS = 100_000  # of a training table: passes of a fit then have tasks of even size
#: Rows that fits running side by side may hold in memory; boosted trees keep nearly a KB of each.
HELD_ROWS = 16_000_000


# --- folds and weights ---------------------------------------------------------------------


def group_folds(rows: DataFrame, k: int = FOLDS, keys: list[str] = ALERT) -> DataFrame:
    """``fold`` per group: groups by falling size are dealt out 0..k-1, k-1..0, and so on."""
    sizes = rows.groupBy(*keys).agg((-F.count("*")).alias("_minus"))
    dealt = dense_index(sizes, ["_minus", *keys], "_place")
    turn = F.pmod(F.col("_place"), F.lit(2 * k))
    return dealt.select(*keys, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).alias("fold"))


def with_folds(rows: DataFrame, k: int = FOLDS, keys: list[str] = ALERT) -> DataFrame:
    return rows.join(group_folds(rows, k, keys), keys)


def class_weights(labelled: DataFrame) -> DataFrame:
    """Per class: rows, balanced weight n / (2 n_c), and the positive class's neg / pos weight."""
    n = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).select(F.struct("n", "pos")).scalar()
    per = labelled.groupBy(F.col("y").cast("bigint").alias("y")).agg(F.count("*").alias("n_class")).withColumn("_t", n)
    neg_per_pos = (F.col("_t.n") - F.col("_t.pos")) / F.nullif(F.col("_t.pos"), F.lit(0))
    return per.select(
        "y",
        "n_class",
        (F.col("_t.n") / (2 * F.col("n_class"))).alias("balanced"),
        F.when(F.col("y") == 1, neg_per_pos).otherwise(F.lit(1.0)).alias("scaled"),
    )


def with_weights(rows: DataFrame, kind: str) -> DataFrame:
    """``w``: 1, or the class's ``balanced`` or ``scaled`` weight; two numbers decide it."""
    if kind == "none":
        return rows.withColumn("w", F.lit(1.0))
    weight = {r["y"]: r[kind] for r in class_weights(rows).collect()}
    return rows.withColumn("w", F.when(F.col("y") == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0)))


# --- model configurations ------------------------------------------------------------------


def gbt(trees: int, step: float, depth: int, rows: float = 0.8, cols: str = "0.8", leaf: int = 1) -> Callable:
    def make(size: int | None = None, max_depth: int | None = None, step_size: float | None = None) -> Estimator:
        return Boosting(
            labelCol="y", weightCol="w", maxIter=size or trees, stepSize=step_size or step,
            maxDepth=max_depth or depth, subsamplingRate=rows, featureSubsetStrategy=cols, minInstancesPerNode=leaf,
            seed=SEED,
        )

    return make


def forest(trees: int, depth: int, leaf: int) -> Callable:
    def make(size: int | None = None, max_depth: int | None = None, step_size: float | None = None) -> Estimator:
        return Forest(
            labelCol="y", weightCol="w", numTrees=size or trees, maxDepth=max_depth or depth, minInstancesPerNode=leaf,
            seed=SEED,
        )

    return make


def logistic(iterations: int = 1000) -> Callable:
    def make(size: int | None = None, max_depth: int | None = None, step_size: float | None = None) -> Estimator:
        return LogisticRegression(labelCol="y", weightCol="w", maxIter=size or iterations)

    return make


# name: (estimator, class weighting, resampling). Tree counts, step sizes, depths, sampling rates: fixed values.
CONFIGS: dict[str, tuple[Callable, str, str | None]] = {
    "gbt_balanced": (gbt(1200, 0.02, 7), "balanced", None),
    "gbt_scaled": (gbt(1200, 0.02, 7), "scaled", None),
    "gbt_smote": (gbt(1200, 0.02, 7), "none", "smote"),
    "gbt_smote_tomek": (gbt(1200, 0.02, 7), "none", "smote_tomek"),
    "boost_scaled": (gbt(1000, 0.02, 7), "scaled", None),
    "boost_smote": (gbt(1000, 0.02, 7), "none", "smote"),
    "forest_balanced": (forest(500, 15, 5), "balanced", None),
    "gbt_plain": (gbt(500, 0.05, 5, cols="all"), "none", None),
    "logistic_balanced": (logistic(), "balanced", None),
    "gbt_tuned": (gbt(2000, 0.01, 8, 0.75, "0.7", 20), "balanced", None),
    "gbt_airport": (gbt(1500, 0.015, 7), "balanced", None),
    "gbt_v4": (gbt(1200, 0.02, 7, leaf=20), "balanced", None),
    "gbt_v4_airport": (gbt(1200, 0.02, 7, leaf=15), "balanced", None),
}


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with the vector of these columns. Written with the table, it spares every pass of a fit
    (three for boosted trees, and one to score) putting the vector together from single columns."""
    return assembler(features).transform(rows.drop("features"))


def is_assembled(rows: DataFrame, features: list[str]) -> bool:
    """Whether ``rows`` hold the vector of exactly these columns in this order, as ``assembled`` marks it."""
    if "features" not in rows.columns:
        return False
    slots = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("numeric", [])
    return [s.get("name") for s in sorted(slots, key=lambda s: s["idx"])] == list(features)


def at_once(rows: DataFrame, most: int) -> int:
    """How many fits on ``rows`` run side by side: as many as keep what they cache under ``HELD_ROWS``, one at least."""
    return max(1, min(most, HELD_ROWS // max(rows.count(), 1)))


def prepared(train: DataFrame, features: list[str], config: str, size: int | None = None, max_depth: int | None = None,
             stop_fold: int | None = None, step: float | None = None) -> tuple[Estimator, DataFrame]:
    """What ``fit`` fits: the estimator, and the rows resampled, weighted and marked to stop early."""
    make, weighting, resample = CONFIGS[config]
    estimator = make(size, max_depth, step)
    stops = stop_fold is not None and isinstance(estimator, GBTClassifier)
    if stops and resample:
        held = train.filter(F.col("fold") == stop_fold)
        train = RESAMPLERS[resample](train.filter(F.col("fold") != stop_fold), features)
        held = held.select(*train.columns).withColumn("_stop", F.lit(True))
        train = train.withColumn("_stop", F.lit(False)).unionByName(held)
    elif stops:  # one scan, not one for each side
        train = train.filter(F.col("fold").isNotNull()).withColumn("_stop", F.col("fold") == stop_fold)
    elif resample:
        train = RESAMPLERS[resample](train, features)
    if stops:
        estimator = estimator.setValidationIndicatorCol("_stop")
    train = with_weights(train, weighting)
    if isinstance(estimator, LogisticRegression):
        weight = train.agg(F.sum("w")).first()[0] or 1.0
        estimator = estimator.setRegParam(1 / weight)
    return estimator, train


def fit(train: DataFrame, features: list[str], config: str, size: int | None = None, max_depth: int | None = None,
        stop_fold: int | None = None, step: float | None = None) -> PipelineModel:
    """Fit one configuration on a labelled model matrix.

    ``size`` replaces the number of trees or iterations and nothing else, ``step`` the step size of
    boosting. ``stop_fold`` names a fold of the training rows held back to stop boosting early, never
    the fold that is scored; it is never resampled. The penalty of the logistic regression is one
    over the weight of all rows, so that it counts as much as one row's loss. A vector that
    ``assembled`` has left in ``train`` is read, not put together again.
    """
    estimator, train = prepared(train, features, config, size, max_depth, stop_fold, step)
    if is_assembled(train, features):
        return PipelineModel([assembler(features), estimator.fit(train)])
    return Pipeline(stages=[assembler(features), estimator]).fit(train.drop("features"))


def positive_score(probability: Column | str = "probability") -> Column:
    return vector_to_array(probability)[1]


def score(rows: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``rows`` with the probability of the positive class; a vector of the model's columns left by ``assembled`` is read."""
    if isinstance(model, PipelineModel) and isinstance(model.stages[0], VectorAssembler):
        if is_assembled(rows, model.stages[0].getInputCols()):
            model = PipelineModel(model.stages[1:])
        else:
            rows = rows.drop("features")
    scored = model.transform(rows).withColumn(name, positive_score())
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def fit_score(train: DataFrame, apart: DataFrame, features: list[str], config: str, name: str = "score", **kw) -> DataFrame:
    """``apart`` scored by a model fitted on ``train``. Many trees over few rows are grown and scored in one task."""
    if isinstance(CONFIGS[config][0](), Boosting | Forest) and is_assembled(apart, features):
        estimator, ready = prepared(train, features, config, **kw)
        ready = ready if is_assembled(ready, features) else assembled(ready, features)
        if (scored := estimator.scored(ready, apart.drop(name), name)) is not None:
            return scored
    return score(apart, fit(train, features, config, **kw), name)


def oof(rows: DataFrame, features: list[str], config: str, k: int = FOLDS, **kw) -> DataFrame:
    """Every row scored by the model that has not seen its fold. ``rows`` should be a written table."""
    parts = [score(rows.filter(F.col("fold") == f), fit(rows.filter(F.col("fold") != f), features, config, **kw))
             for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STORE = "lightning_id bigint, airport string, airport_alert_id bigint, y int, fold bigint, score double, model string"


def oof_store(rows: DataFrame, features: list[str], configs: dict[str, dict], path: str, k: int = FOLDS, parallel: int | None = None) -> DataFrame:
    """Out-of-fold scores of several models as one table (strike, alert, y, fold, score, model), a folder a model.

    ``configs`` maps a configuration to the keywords of its ``fit``. Folds and models are fitted ``parallel``
    at a time: unset, as many as there are cores where a fit is one task, else up to four as memory allows
    (``at_once``). A fit's scores are written as soon as they are there, so no more models than that are held.
    A model whose folder exists is replaced. ``rows`` should be a written table, best one with the vector of the
    columns (``assembled``).
    """
    spark, keys = rows.sparkSession, ["lightning_id", *ALERT, "y", "fold"]
    vector = ["features"] if is_assembled(rows, features) else features

    def one(job: tuple[str, int]) -> tuple[str, DataFrame]:
        config, f = job
        apart = rows.filter(F.col("fold") == f).select(*dict.fromkeys([*keys, *vector]))
        scored = fit_score(rows.filter(F.col("fold") != f), apart, features, config, **configs[config])
        return config, materialise(scored.select(*keys, "score"), "oof-fold")

    most = spark.sparkContext.defaultParallelism if rows.count() <= TASK_ROWS else 4
    with ThreadPoolExecutor(parallel or at_once(rows, most)) as pool:
        parts = list(pool.map(one, [(c, f) for c in configs for f in range(k)]))
    for config in configs:
        whole = None
        for c, part in parts:
            if c == config:
                whole = part if whole is None else whole.unionByName(part)
        whole.write.mode("overwrite").parquet(f"{path}/model={config}")
    return spark.read.schema(STORE).parquet(path)


def aligned(store: DataFrame, models: list[str]) -> DataFrame:
    """The store with a column for each model: one row a strike, whatever order the models were written in."""
    return store.groupBy("lightning_id", *ALERT, "y", "fold").pivot("model", models).agg(F.first("score"))


def by_airport(rows: DataFrame) -> DataFrame:
    """``rows`` written with one folder for each airport, so that a filter on the airport reads only that."""
    path = new_path(rows.sparkSession, "by-airport")
    rows.repartition("airport").write.partitionBy("airport").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def train_per_airport(
    rows: DataFrame, features: list[str], config: str = "gbt_airport", max_models: int | None = None, parallel: int = 4, **kw
) -> dict:
    """One model for every airport that has both classes; the others are scored by the global model
    (``score_with_fallback``). ``max_models`` keeps the largest airports only, if given. ``rows`` is
    written by airport first, and ``parallel`` fits run at a time."""
    sizes = rows.groupBy("airport").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    fits = sizes.filter((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).orderBy(F.desc("n"), "airport")
    chosen = [r["airport"] for r in (fits if max_models is None else fits.limit(max_models)).collect()]
    if not chosen:
        return {}
    apart = by_airport(rows)
    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(chosen, pool.map(lambda a: fit(apart.filter(F.col("airport") == a), features, config, **kw), chosen)))


def score_with_fallback(rows: DataFrame, features: list[str], own: dict[str, Model], whole: Model | None) -> DataFrame:
    """Each airport by its own model, others by the global one, 0 without either."""
    rows = with_missing_as_zero(rows.drop("features"), features)
    if own:
        rows = by_airport(rows)
    parts = [score(rows.filter(F.col("airport") == a), m) for a, m in own.items()]
    rest = rows.filter(~F.col("airport").isin(list(own))) if own else rows
    parts.append(score(rest, whole) if whole is not None else rest.withColumn("score", F.lit(0.0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importance(model: PipelineModel) -> DataFrame:
    """Gain-type importances, which sum to 1: one row per model column."""
    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` columns of largest importance, ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def stack(rows: DataFrame, scores: list[str], k: int = FOLDS, iterations: int = 1000) -> DataFrame:
    """Logistic regression on out-of-fold scores, its penalty chosen by inner folds, outer folds as before.

    Rows are written once with the vector of the scores; outer folds run side by side as memory allows.
    """
    lr = LogisticRegression(labelCol="y", maxIter=iterations)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1e-4, 1e-2, 1.0]).build()
    judge = BinaryClassificationEvaluator(labelCol="y")
    inner = F.pmod(F.xxhash64(*ALERT), F.lit(3)).cast("int")
    ready = materialise(assembled(rows, scores).withColumn("_inner", inner), "stack", FILE_ROWS)

    def one(f: int) -> DataFrame:
        cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="_inner",
                            parallelism=len(grid))
        return cv.fit(ready.filter(F.col("fold") != f)).bestModel.transform(ready.filter(F.col("fold") == f))

    with ThreadPoolExecutor(at_once(ready, k)) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("stacked", positive_score()).drop("features", "rawPrediction", "probability", "prediction", "_inner")


def platt(rows: DataFrame, name: str = "score") -> Model:
    """Logistic regression on the score's log-odds."""
    p = F.least(F.greatest(F.col(name), F.lit(1e-9)), F.lit(1 - 1e-9))
    ready = VectorAssembler(inputCols=["_l"], outputCol="features").transform(rows.withColumn("_l", F.log(p / (1 - p))))
    return LogisticRegression(labelCol="y").fit(ready)


def isotonic(rows: DataFrame, name: str = "score", step: float | None = None) -> Model:
    """Monotone calibration of a score in [0, 1].

    Equal scores are averaged into one weighted point; Spark pools the points in range partitions and
    the pools on the driver. For very many distinct scores ``step`` merges scores of one step into
    their mean, which moves no calibrated value by more than that of scores ``step`` apart.
    """
    group = F.col(name) if step is None else F.floor(F.col(name) / step)
    tally = rows.groupBy(group.alias("_step")).agg(
        F.avg(name).alias("features"), F.avg("y").alias("y"), F.count("*").cast("double").alias("w")
    )
    return IsotonicRegression(labelCol="y", weightCol="w").fit(tally)


# --- resampling ----------------------------------------------------------------------------


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.select(F.col("lightning_id").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))


def _draw(*parts: Column | str) -> Column:
    """A repeatable non-negative draw from the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**53))


def smote_points(rows: DataFrame, features: list[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Synthetic minority points until the classes are even: base, neighbour, share u, vector v.

    Each point lies on the segment from a drawn minority row to one of its k nearest minority
    rows. Draws come from hashes of the point's number, so lost work is redone alike.
    """
    counts = rows.agg(F.sum("y").alias("pos"), F.count("*").alias("n")).first()
    pos, need = int(counts.pos or 0), int(counts.n - 2 * (counts.pos or 0))
    spark = rows.sparkSession
    if pos < 2 or need <= 0:
        return spark.createDataFrame([], "point bigint, base bigint, neighbour bigint, u double, v array<double>")
    k = min(k, pos - 1)
    minority = materialise(vectors(rows.filter(F.col("y") == 1), features), "minority")
    near = nearest(minority, k)
    numbered = dense_index(minority.select("id"), ["id"], "no")
    drawn = spark.range(need).select(
        F.col("id").alias("point"),
        F.pmod(_draw("id", F.lit(seed), F.lit("base")), F.lit(pos)).alias("no"),
        (F.pmod(_draw("id", F.lit(seed), F.lit("place")), F.lit(k)) + 1).alias("place"),
        (_draw("id", F.lit(seed), F.lit("share")) / 2.0**53).alias("u"),
    )
    based = drawn.join(numbered.withColumnRenamed("id", "base"), "no")
    met = based.join(near.select(F.col("id").alias("base"), F.col("nid").alias("neighbour"), "place"), ["base", "place"])
    a, b = minority.select(F.col("id").alias("base"), F.col("v").alias("_a")), minority.select(
        F.col("id").alias("neighbour"), F.col("v").alias("_b")
    )
    both = met.join(a, "base").join(b, "neighbour")
    return both.select(
        "point", "base", "neighbour", "u", F.zip_with("_a", "_b", lambda x, y: x + F.col("u") * (y - x)).alias("v")
    )


def _as_rows(points: DataFrame, features: list[str]) -> DataFrame:
    """Synthetic points as labelled rows; their ids are negative."""
    return points.select(
        (-1 - F.col("point")).alias("lightning_id"),
        F.lit(1).alias("y"),
        *[F.col("v")[i].alias(c) for i, c in enumerate(features)],
    )


def smote(rows: DataFrame, features: list[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """Training rows (id, y, features) with the classes made even."""
    real = rows.select("lightning_id", "y", *[F.col(c).cast("double").alias(c) for c in features])
    return materialise(real.unionByName(_as_rows(smote_points(rows, features, k, seed), features)), "smote")


def tomek_links(rows: DataFrame, features: list[str]) -> DataFrame:
    """Pairs of opposite class that are each other's nearest neighbour, as (a, b) with a < b."""
    near = materialise(nearest(vectors(rows, features), 1).select("id", "nid"), "nearest")  # read from both ends
    mutual = near.alias("x").join(
        near.select(F.col("id").alias("nid"), F.col("nid").alias("id")).alias("y"), ["id", "nid"]
    )
    label = rows.select(F.col("lightning_id").alias("id"), "y")
    pairs = mutual.filter(F.col("id") < F.col("nid")).join(label, "id")
    other = label.select(F.col("id").alias("nid"), F.col("y").alias("y_other"))
    return pairs.join(other, "nid").filter(F.col("y") != F.col("y_other")).select(F.col("id").alias("a"), F.col("nid").alias("b"))


def smote_tomek(rows: DataFrame, features: list[str], k: int = 5, seed: int = SEED) -> DataFrame:
    """``smote``, then both ends of every Tomek link removed."""
    even = smote(rows, features, k, seed)
    links = tomek_links(even, features)
    ends = links.select(F.explode(F.array("a", "b")).alias("lightning_id"))
    return even.join(ends, "lightning_id", "left_anti")


RESAMPLERS = {"smote": smote, "smote_tomek": smote_tomek}


# --- packs ---------------------------------------------------------------------------------


def save_pack(path: str, model: PipelineModel, features: list[str], threshold: float, codes: DataFrame | None = None) -> None:
    """A model with what scoring needs: its columns, threshold and airport codes."""
    spark = SparkSession.getActiveSession()
    model.write().save(f"{path}/model")
    spark.createDataFrame([(features, float(threshold))], "features array<string>, threshold double").write.parquet(
        f"{path}/meta"
    )
    if codes is not None:
        codes.select("airport", "airport_enc").write.parquet(f"{path}/airports")


def load_pack(spark: SparkSession, path: str) -> dict:
    meta = spark.read.parquet(f"{path}/meta").first()
    try:
        codes = spark.read.parquet(f"{path}/airports")
    except Exception as e:  # a pack saved without airport codes
        if "PATH_NOT_FOUND" not in str(e):
            raise
        codes = None
    return {
        "model": PipelineModel.load(f"{path}/model"),
        "features": list(meta["features"]),
        "threshold": meta["threshold"],
        "airports": codes,
    }


def score_pack(rows: DataFrame, pack: dict) -> DataFrame:
    """Score a feature table with a pack; an airport the pack does not know has code 0."""
    if pack["airports"] is not None:
        rows = rows.drop("airport_enc").join(pack["airports"], "airport", "left")
        rows = rows.withColumn("airport_enc", F.coalesce("airport_enc", F.lit(0)))
    return score(model_matrix(rows.drop("features"), pack["features"]), pack["model"], "confidence")
