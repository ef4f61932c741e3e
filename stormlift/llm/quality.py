"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import keep, query, row_slices, table, text_buffer, text_of
from stormlift.llm.words import runs, words

#: Fourier features, their seed, the kernel width in standard deviations, folds of the calibration, score bins.
FEATURES, SEED, WIDTH, FOLDS, BINS = 256, 7, 3.0, 3, 2000
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
PREDICT_AT = 0.7
_SLICE = 1 << 19

STATISTICS = (
    "log_words", "log_lines", "words_a_line", "word_bytes", "word_bytes_sd", "short_words", "long_words", "distinct_words",
    "repeated_next", "top_word", "distinct_pairs", "distinct_runs", "upper", "digits", "other_bytes", "symbols", "odd_symbols", "marks", "blanks", "text_bytes_a_word",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for every text of a buffer."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(offsets))

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row_of[mask], minlength=n).astype(float)

    row, start, end, hashed = words(data, offsets)
    count = np.bincount(row, minlength=n).astype(float)
    length = (end - start).astype(float)
    some, chars = np.maximum(count, 1), np.maximum(size, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x, minlength=n) / some

    def distinct(r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many different values a row has, as a share of all, and the share of the most frequent."""
        if not len(r):
            return np.ones(n), np.zeros(n)
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]))
        times, top = np.diff(np.append(first, len(r))), np.zeros(n)
        np.maximum.at(top, r[first], times)
        total = np.bincount(r, minlength=n)
        share = np.where(total > 0, np.bincount(r[first], minlength=n) / np.maximum(total, 1), 1.0)
        return share, top / np.maximum(total, 1)

    average = mean(length)
    same_next = np.concatenate([(row[1:] == row[:-1]) & (hashed[1:] == hashed[:-1]), [False]]) if len(row) else np.zeros(0, bool)
    kinds, top = distinct(row, hashed)
    pairs_at, pairs = runs(row, hashed, 2)
    runs_at, fives = runs(row, hashed, 5)
    upper = per_row((data >= 65) & (data <= 90))
    lower = per_row((data >= 97) & (data <= 122))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    plain = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128) | blank
    usual = np.isin(data, np.frombuffer(b".,;:'\"()-", np.uint8))
    lines = per_row(data == 10) + 1
    columns = [
        np.log1p(count), np.log(lines), np.log1p(count / lines), np.minimum(average, 40), np.minimum(np.sqrt(np.maximum(0, mean(length**2) - average**2)), 40),
        mean((length <= 3).astype(float)), mean((length >= 12).astype(float)), kinds,
        mean(same_next.astype(float)), top, distinct(row[pairs_at], pairs)[0], distinct(row[runs_at], fives)[0],
        upper / np.maximum(1, upper + lower), per_row((data >= 48) & (data <= 57)) / chars, per_row(data >= 128) / chars, per_row(~plain) / chars, per_row(~plain & ~usual) / some,
        per_row((data == 33) | (data == 63)) / some, per_row(blank) / chars, np.minimum(size / some, 60),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_slices(batch, "text", _SLICE):
            x = statistics(*text_buffer(part.column("text")))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "stats"])


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return docs.mapInArrow(_statistics_batches, f"id {docs.schema['id'].dataType.simpleString()}, stats array<float>")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


@dataclass
class Model:
    """Standardisation, Fourier frequencies and phases, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    sd: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        phi = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate([phi, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Isotonic value, with a hundredth of the raw score so that equal steps keep their order."""
        step = np.interp(raw, *self.knots) if len(self.knots[0]) else np.full(len(raw), 0.5)
        return 0.99 * step + 0.01 * np.clip((raw + 1) / 3, 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("stats")
    return x.flatten().to_numpy().reshape(len(x), len(STATISTICS)).astype(float)


def _sums(model: Model):
    """Per partition and fold: the normal equations, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        total = np.zeros((FOLDS, d + 1, d + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            phi = np.concatenate([model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)[:, None].astype(float)], axis=1)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                total[f] += phi[fold == f].T @ phi[fold == f]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _ridge(sums: np.ndarray, ridge: float) -> np.ndarray:
    a, b, n = sums[:-1, :-1], sums[:-1, -1], sums[-2, -2]
    penalty = np.eye(len(b)) * ridge * max(n, 1.0)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit to shares of positives: pooled adjacent violators, each block's ends at its value."""
    blocks: list[list[float]] = []
    for a, n, p in zip(x.tolist(), total.tolist(), positive.tolist(), strict=True):
        blocks.append([a, a, n, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, high, n2, p2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + n2, blocks[-1][3] + p2]
    knots = [(v, p / n) for low, high, n, p in blocks for v in ((low, high) if high > low else (low,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on (id, stats) and (id, y): every labelled row counts.

    The normal equations are summed in the partitions and added up in a tree; three folds are kept
    apart, so that the penalty and the calibration use scores of rows a fold's weights have not seen.
    """
    means = [F.avg(F.col("stats")[i].cast("double")) for i in range(len(STATISTICS))]
    sds = [F.stddev_pop(F.col("stats")[i].cast("double")) for i in range(len(STATISTICS))]
    row = stats.agg(F.array(*means), F.array(*sds)).first()
    mean = np.array([0.0 if v is None else v for v in row[0]])
    sd = np.array([1.0 if not v or v < 1e-9 else v for v in row[1]])
    rng = np.random.default_rng(SEED)
    frequencies = rng.standard_normal((len(STATISTICS), FEATURES)) / (WIDTH * np.sqrt(len(STATISTICS) / 4))
    model = Model(mean, sd, frequencies, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(0), np.zeros(0)))
    train = stats.join(labels, "id").select("stats", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"))
    partial = train.mapInArrow(_sums(model), "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    shape = (FOLDS, FEATURES + 2, FEATURES + 2)
    sums = partial.treeAggregate(np.zeros(int(np.prod(shape))), lambda x, y: x + y, lambda x, y: x + y, depth=2).reshape(shape)
    if not sums.any():
        return model
    whole = sums.sum(axis=0)

    def unseen_error(ridge: float) -> float:
        error = 0.0
        for f in range(FOLDS):
            w = np.append(_ridge(whole - sums[f], ridge), -1.0)
            error += float(w @ sums[f] @ w)
        return error

    ridge = min(RIDGES, key=unseen_error)
    by_fold = [_ridge(whole - sums[f], ridge) for f in range(FOLDS)]
    model.weights = _ridge(whole, ridge)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                phi, fold = model.features(_matrix(batch)), batch.column("fold").to_numpy(zero_copy_only=False)
                raw = np.choose(fold, [phi @ w for w in by_fold])
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(raw, -1, 2)), batch.column("y")], names=["raw", "y"])

    width = 3 / BINS
    bins = train.mapInArrow(unseen, "raw double, y double").groupBy(F.floor((F.col("raw") + 1) / width).alias("bin")).agg(F.avg("raw").alias("x"), F.count("*").alias("n"), F.sum("y").alias("p"))
    rows = sorted((r["x"], r["n"], r["p"]) for r in bins.collect())  # BINS rows at most
    model.knots = isotonic(*(np.array(c, float) for c in zip(*rows, strict=True)))
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 4, held: int = 2, predict_at: float = PREDICT_AT) -> DataFrame:
    """A calibrated quality score of every whole text.

    Labels are read only from rows whose crc32(id as text) mod ``parts`` is not ``held``, and nothing but
    the text enters a score. Statistics of all texts are written once; standardisation uses all of them.

    Defined cases: null and empty texts have the statistics of an empty text and a score; null ids are
    scored, not learned from; null labels are skipped; labels or rows that share an id all count; with
    no label to learn from every score is the same half; an empty table stays empty; other columns are ignored.

    Returns the id column, held_out, score, predicted.
    """
    stats = keep(document_statistics(df, id_col, text_col), "statistics")
    known = labels.where((remainder(id_col, parts) != held) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    model = fit(stats, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.calibrated(model.raw(_matrix(batch))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    scored = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), (remainder("id", parts) == held).alias("held_out"), "score", (F.col("score") >= predict_at).cast("int").alias("predicted"))


@query("op3_quality_classifier")
def quality_classifier(spark, sf_dir):
    """No SQL: tested by held-out accuracy."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
