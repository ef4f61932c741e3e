"""Logistic models for every airport and fold at once, as rows of a table.

Newton's method finds the models. An airport of up to TOGETHER rows is solved whole where its rows meet:
the rows are shuffled once, stream through a task sorted by airport, and only its models leave it. For
a larger airport, and for the model of all airports, a step is one pass over the training rows, in which
every row adds to the equations of the models that may see it; partial sums meet by airport and are
solved there. Sums are made for these few only, so what is shuffled grows with the rows, not with the
number of airports times the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlift.operators.features import with_missing_as_zero
from stormlift.operators.learn import FOLDS
from stormlift.operators.metrics import binary_metrics
from stormlift.workspace import materialise

#: Newton steps at most, the step (relative) at which a model is done, keys whose sums a task holds before it hands them on.
STEPS, NEAR, HELD = 60, 1e-9, 64
#: Rows of an airport that one task solves whole (0.5 KB a row); a larger airport is iterated over all tasks.
TOGETHER = 50_000
#: The key of the model of all airports.
WHOLE = ""

MODELS = "airport string, fold int, coefficients array<double>, intercept double, n long, n_pos long"
_MODEL_TYPES = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64())


def _moments(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature (1 where it does not vary): a row of sums a task reaches the driver.

    Batches are centred before squaring. An aggregate of 120 columns would be one method too long to be compiled.
    """

    def merged(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1)
                part = len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)
                total = part if total is None else merged(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (total[0], total[1].tolist(), total[2].tolist())], names=["n", "mean", "squares"])

    total = None
    for r in rows.select(*features).mapInArrow(run, "n long, mean array<double>, squares array<double>").collect():
        part = r["n"], np.array(r["mean"]), np.array(r["squares"])
        total = part if total is None else merged(total, part)
    if total is None:
        return np.zeros(len(features)), np.ones(len(features))
    sd = np.sqrt(total[2] / total[0])
    return total[1], np.where(sd > 1e-12, sd, 1.0)


def _parts(batches: Iterator[pa.RecordBatch], features: list[str], mean: np.ndarray, sd: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Rows of a batch as one block for each airport: standardised features with a one, fold and label."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1)
        x = np.concatenate([(x - mean) / sd, np.ones((len(x), 1)), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y")], axis=1)], axis=1)
        codes = batch.column("airport").dictionary_encode()
        index, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        for n, name in enumerate(names):  # in the order they come
            yield name, x if len(names) == 1 else x[index == n]


def _begin(d: int, counts: list[tuple[int, int]]) -> np.ndarray:
    """A row a model: loss, share of the step, done, weights of the classes, and three vectors. ``counts``: rows and positives in sight."""
    models = np.zeros((len(counts), 5 + 3 * d))
    for m, (n, pos) in enumerate(counts):
        if 0 < pos < n:
            models[m, 0], models[m, 3], models[m, 4] = np.inf, n / (2 * (n - pos)), n / (2 * pos)
        else:
            models[m, 2] = 1.0
    return models


def _add(sums: np.ndarray, models: np.ndarray, data: np.ndarray, d: int, k: int) -> None:
    """Loss, gradient and curvature of every model of an airport (one for each fold it must not see, one for all rows)."""
    x, fold, y = data[:, :d], data[:, d], data[:, d + 1]
    for m in range(k + 1):
        if models[m, 2]:
            continue
        z = x @ models[m, 5 : 5 + d]
        w = np.where(y > 0, models[m, 4], models[m, 3])
        if m < k:
            w = np.where(fold != m, w, 0.0)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        sums[m, 0] += float((w * (np.logaddexp(0, z) - y * z)).sum())
        sums[m, 1 : 1 + d] += x.T @ (w * (y - p))
        sums[m, 1 + d :] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()


def _way(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    try:
        way = np.linalg.solve(h, g)
    except np.linalg.LinAlgError:
        way = np.full(len(g), np.nan)
    return way if np.isfinite(way).all() else np.linalg.lstsq(h, g, rcond=None)[0]


def _next(models: np.ndarray, sums: np.ndarray, d: int, penalty: float) -> np.ndarray:
    """The next state of an airport from its sums. A step that does not pay is halved."""
    ridge = np.full(d, penalty)
    ridge[-1] = 0.0  # the intercept goes free
    models = models.copy()
    for m in range(len(models)):
        loss, share, done, _, _ = models[m, :5]
        if done:
            continue
        beta, base, way = models[m, 5 : 5 + d], models[m, 5 + d : 5 + 2 * d], models[m, 5 + 2 * d :]
        now = sums[m, 0] + 0.5 * float(ridge @ beta**2)
        if now <= loss + 1e-12 * abs(loss) or share < 1e-6:
            g, h = sums[m, 1 : 1 + d] - ridge * beta, sums[m, 1 + d :].reshape(d, d) + np.diag(ridge + 1e-10)
            base[:] = beta
            way[:] = _way(h, g)
            models[m, 0], models[m, 1] = now, 1.0
            models[m, 2] = float(np.abs(way).max() <= NEAR * (1 + np.abs(beta).max()))
        else:
            models[m, 1] = share / 2
        beta[:] = base + models[m, 1] * way
    return models


def _named(airport: str, models: np.ndarray, counts: list[tuple[int, int]], mean: np.ndarray, sd: np.ndarray) -> list[tuple]:
    """The rows of an airport's models: those that see both classes."""
    d, k, out = len(mean) + 1, len(counts) - 1, []
    for m, (n, pos) in enumerate(counts):
        if 0 < pos < n:
            beta = models[m, 5 + d : 5 + 2 * d]
            coefficients = beta[:-1] / sd
            out.append((airport, -1 if m == k else m, coefficients.tolist(), float(beta[-1] - coefficients @ mean), n, pos))
    return out


def _solved(features: list[str], mean: np.ndarray, sd: np.ndarray, k: int, penalty: float):
    """All models of every airport whose rows come one after the other."""
    d = len(features) + 1

    def solve(airport: str, data: np.ndarray) -> list[tuple]:
        fold, y = data[:, d], data[:, d + 1]
        counts = [(int(s.sum()), int(y[s].sum())) for s in [*(fold != m for m in range(k)), np.ones(len(y), bool)]]
        models = _begin(d, counts)
        for _ in range(STEPS):
            if models[:, 2].all():
                break
            sums = np.zeros((k + 1, 1 + d + d * d))
            _add(sums, models, data, d, k)
            models = _next(models, sums, d, penalty)
        return _named(airport, models, counts, mean, sd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []

        def hand_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate(_MODEL_TYPES)], names=[c.split()[0] for c in MODELS.split(", ")])
            out.clear()
            return made

        for airport, data in _parts(batches, features, mean, sd):
            if airport != last and held:
                out += solve(last, np.concatenate(held))
                held = []
                if len(out) >= HELD:
                    yield hand_on()
            last = airport
            held.append(data)
        if held:
            out += solve(last, np.concatenate(held))
        yield hand_on()

    return run


def _equations(features: list[str], mean: np.ndarray, sd: np.ndarray, k: int, states: dict[str, np.ndarray]):
    """The sums of a task's rows for every airport in ``states``."""
    d = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def hand_on() -> pa.RecordBatch:
            rows = [(a, t.tobytes()) for a, t in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.binary()))], names=["airport", "sums"])

        for airport, data in _parts(batches, features, mean, sd):
            if airport not in states:
                continue
            if airport not in held:
                if len(held) >= HELD:
                    yield hand_on()
                held[airport] = np.zeros((k + 1, 1 + d + d * d))
            _add(held[airport], states[airport], data, d, k)
        if held:
            yield hand_on()

    return run


def _step(d: int, k: int, penalty: float, states: dict[str, np.ndarray]):
    """The next state of every airport from its sums, which arrive sorted by airport."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, out = None, None, []
        for batch in batches:
            for airport, raw in zip(*(batch.column(c).to_pylist() for c in ("airport", "sums")), strict=True):
                part = np.frombuffer(raw).reshape(k + 1, -1)
                if airport != last and total is not None:
                    out.append((last, _next(states[last], total, d, penalty).tobytes()))
                    total = None
                last, total = airport, part if total is None else total + part
        if total is not None:
            out.append((last, _next(states[last], total, d, penalty).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([s for _, s in out], pa.binary())], names=["airport", "state"])

    return run


def fit_airports(rows: DataFrame, features: list[str], folds: int = FOLDS, penalty: float = 1.0, own: bool = True) -> DataFrame:
    """Models as rows: airport, fold, coefficients, intercept, n, n_pos.

    A model of fold f has not seen fold f; fold -1 has seen all rows. Classes are weighted n / (2 n_c) over
    the rows a model sees; the penalty is ``penalty``/2 of the squared coefficients of standardised features.
    Airports whose rows in sight are of one class have no model. ``own=False`` fits one model of all
    airports, under the name WHOLE. ``rows`` (airport, fold, y, features) should be a written table.
    Of airports beyond TOGETHER rows the driver holds the state, 10 KB each for 60 columns.
    """
    rows = rows.select("airport" if own else F.lit(WHOLE).alias("airport"), F.col("fold").cast("double").alias("fold"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = rows.filter(F.col("airport").isNotNull())
    d, k = len(features) + 1, folds
    mean, sd = _moments(rows, features)
    counts = rows.groupBy("airport").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"), *[F.count_if(F.col("fold") == m).alias(f"n{m}") for m in range(k)], *[F.count_if((F.col("fold") == m) & (F.col("y") > 0)).alias(f"p{m}") for m in range(k)])
    large = {r["airport"]: [(r["n"] - r[f"n{m}"], r["pos"] - r[f"p{m}"]) for m in range(k)] + [(r["n"], r["pos"])] for r in counts.filter(F.col("n") > TOGETHER).collect()}

    small = rows.filter(~F.col("airport").isin(list(large))) if large else rows
    made = small.repartition("airport").sortWithinPartitions("airport").mapInArrow(_solved(features, mean, sd, k, penalty), MODELS)
    if not large:
        return materialise(made, "airport-models")

    apart = rows
    if own:  # few airports a task, and as many tasks an airport as its rows ask
        apart = rows.filter(F.col("airport").isin(list(large)))
        apart = materialise(apart.repartitionByRange("airport", F.xxhash64("fold", "y", *features)).sortWithinPartitions("airport"), "large-airports")
    states = {a: _begin(d, c) for a, c in large.items()}
    for _ in range(STEPS):
        left = {a: s for a, s in states.items() if not s[:, 2].all()}
        if not left:
            break
        sums = apart.mapInArrow(_equations(features, mean, sd, k, left), "airport string, sums binary")
        after = sums.repartition("airport").sortWithinPartitions("airport").mapInArrow(_step(d, k, penalty, left), "airport string, state binary")
        states |= {r["airport"]: np.frombuffer(r["state"]).reshape(k + 1, -1) for r in after.collect()}
    iterated = [row for a, c in large.items() for row in _named(a, states[a], c, mean, sd)]
    made = rows.sparkSession.createDataFrame(iterated, MODELS) if not own else made.unionByName(rows.sparkSession.createDataFrame(iterated, MODELS))
    return materialise(made, "airport-models")


def _score(features: list[str], coefficients: Column, intercept: Column) -> Column:
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    z = F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), intercept, lambda s, v: s + v)
    return 1 / (1 + F.exp(-z))


def score_airports(rows: DataFrame, features: list[str], models: DataFrame, whole: DataFrame, by_fold: bool = False) -> DataFrame:
    """``rows`` with ``score`` and ``model`` (own, global or none): one join with the airport's row, the global row as fallback.

    ``by_fold`` takes the models that have not seen a row's ``fold``; otherwise those of all rows.
    """
    rows = with_missing_as_zero(rows, features)
    fold = F.col("fold").cast("int") if by_fold else F.lit(-1)
    own = models.select(F.col("airport").alias("_airport"), F.col("fold").alias("_fold"), F.col("coefficients").alias("_own"), F.col("intercept").alias("_own_at"))
    every = whole.select(F.col("fold").alias("_whole_fold"), F.col("coefficients").alias("_all"), F.col("intercept").alias("_all_at"))  # a row a fold
    out = rows.join(own, (F.col("airport") == F.col("_airport")) & (fold == F.col("_fold")), "left").join(every, fold == F.col("_whole_fold"), "left")
    c, at = F.coalesce("_own", "_all"), F.coalesce("_own_at", "_all_at")
    model = F.when(F.col("_own").isNotNull(), "own").when(F.col("_all").isNotNull(), "global").otherwise("none")
    out = out.withColumn("score", F.coalesce(_score(features, c, at), F.lit(0.0))).withColumn("model", model)
    return out.drop("_airport", "_fold", "_own", "_own_at", "_whole_fold", "_all", "_all_at")


def airport_oof(rows: DataFrame, features: list[str], folds: int = FOLDS, penalty: float = 1.0) -> DataFrame:
    """Out-of-fold scores by every airport's own models, by the global models of the same folds where it has none."""
    return score_airports(rows, features, fit_airports(rows, features, folds, penalty), fit_airports(rows, features, folds, penalty, own=False), by_fold=True)


def airport_metrics(scored: DataFrame) -> DataFrame:
    """Per airport: n, n_pos, AUC, F1, precision, recall and its own best threshold."""
    m = binary_metrics(scored, ["airport"])
    return m.select("airport", "n", "n_pos", F.col("auc_roc").alias("auc"), "f1", "precision", "recall", F.col("best_threshold").alias("threshold"))


# --- packs ---------------------------------------------------------------------------------


def save_airport_pack(path: str, version: int, features: list[str], models: DataFrame, whole: DataFrame, thresholds: DataFrame) -> None:
    """Add a version to a pack table: a row for every airport's model and one for the global one (airport WHOLE).

    ``thresholds`` (airport, threshold) are the airports' own; the global row has 0.5.
    """
    rows = models.filter("fold = -1").unionByName(whole.filter("fold = -1")).join(thresholds.select("airport", "threshold"), "airport", "left")
    kept = rows.select("airport", F.array(*[F.lit(f) for f in features]).alias("features"), "coefficients", "intercept", F.coalesce("threshold", F.lit(0.5)).alias("threshold"), "n", "n_pos")
    kept.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_airport_pack(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version of a pack, by default the newest: its features, model rows and global row."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == version).drop("version").withColumn("fold", F.lit(-1))
    features = rows.select("features").first()
    return {"version": version, "features": list(features[0]), "models": rows.filter(F.col("airport") != WHOLE), "whole": rows.filter(F.col("airport") == WHOLE)}


def apply_airport_pack(rows: DataFrame, pack: dict) -> DataFrame:
    """``rows`` with ``score``, ``model``, the ``threshold`` in force and whether the score ``lifts``: one scan, one join."""
    scored = score_airports(rows, pack["features"], pack["models"], pack["whole"])
    own = pack["models"].select(F.col("airport").alias("_at"), F.col("threshold").alias("_own"))
    every = pack["whole"].select(F.col("threshold").alias("_all"))
    common = every.agg(F.max("_all")).first()[0]
    out = scored.join(own, F.col("airport") == F.col("_at"), "left").withColumn("threshold", F.coalesce("_own", F.lit(common), F.lit(0.5)))
    return out.drop("_at", "_own").withColumn("lifts", F.col("score") >= F.col("threshold"))
