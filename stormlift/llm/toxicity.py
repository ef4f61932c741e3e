"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nyström landmarks.

The kernel compares two words by the subsequences of three characters they share, wherever gaps fall:
a subsequence that spans b + 1 places weighs DECAY ** (b - 2), up to SPAN places, and counts are
divided by a length that grows with the word. Word begin and end are characters of their own. Whatever
is no letter takes no place, and nor does a blank between single characters, so spelled-out words and
words with any number of inserted marks have the subsequences of the plain word.

A sentence scores as its worst word; a document by its two worst words, calibrated to a probability. Training sentences carry the
label of their document, so a toxic one is known only to hold some toxic word: after a first fit on
document frequencies, each round keeps the worst word of every toxic training text as its witness and
all words of the others as counterexamples. As the machine is linear in the kernel's features, its
landmarks fold into one weight for each subsequence, and a corpus is scored with one table look-up
for each gapped triple.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import keep, query, table, text_buffer, text_of
from stormlift.llm.quality import remainder

SPAN, DECAY = 6, 0.6
#: (second, third) place of every gapped triple, and its weight.
GAPS = tuple((a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b))
#: 32 character classes: 0 is skipped, 1 to 26 letters, 27 and 28 word begin and end, 29 to 31 bytes of other letters.
CLASSES, BEGIN, END = 32, 27, 28
#: The documented bounds of the training sample: toxic and clean texts, and the bytes of a training text.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 600, 1800, 4000
LANDMARKS, ROUNDS, FOLDS, REPEATS, PENALTY, SEED = 96, 3, 4, 5, 1e-5, 3
#: Word scores stay within -FAR and FAR; a text without words has two at FAR.
FAR = -3.0
_SLICE = 1 << 18


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b).lower()
        out[b] = ord(c) - 96 if b < 128 and c.isalpha() else 29 + b % 3 if b >= 128 else 0
    return out


_CLASS_OF = _byte_classes()


@cache
def _letters() -> np.ndarray:
    """Which code points are letters; marks, joined or of no width, punctuation, digits and signs are not."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]] = True
    return out


def _no_letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to non-ASCII characters of valid UTF-8 that are no letters."""
    out = np.zeros(len(raw), bool)
    lead = np.flatnonzero(raw >= 0xC0)
    size = 2 + (raw[lead] >= 0xE0).astype(np.int64) + (raw[lead] >= 0xF0)
    for n in (2, 3, 4):
        at = lead[(size == n) & (lead + n <= len(raw))]
        point = raw[at].astype(np.int64) & (0x7F >> n)
        for k in range(1, n):
            point = point << 6 | (raw[at + k] & 0x3F)
        at = at[~_letters()[np.minimum(point, sys.maxunicode)]]
        for k in range(n):
            out[at + k] = True
    return out


@dataclass
class Words:
    """Words of some texts as places in one buffer of blanks and letters, and as bytes, each text set between line ends."""

    classes: np.ndarray
    blank: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first_byte: np.ndarray
    end_byte: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Longest runs without blanks, each text set between line ends; spaces between single characters do not split."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(n) + 1, size)
    raw = np.full(len(data) + n + 1, 10, np.uint8)
    raw[place] = data
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    if len(raw) > 4:
        single = blank[:-2] & ~blank[1:-1] & blank[2:]  # at the place before the character
        gap = np.zeros(len(raw), bool)
        gap[2:-2] = blank[2:-2] & single[:-2] & single[2:] & (raw[2:-2] == 32)
        blank &= ~gap
    edge = np.diff(blank.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    classes = _CLASS_OF[raw]
    classes[_no_letters(raw)] = 0
    taken = (classes > 0) | blank
    place = np.concatenate([[0], np.cumsum(taken)])
    text = np.searchsorted(offsets[1:] + np.arange(n) + 1, starts, "right") if n else np.zeros(0, np.int64)
    return Words(classes[taken], blank[taken], place[starts], place[ends], text, starts, ends)


def _scale(lengths: np.ndarray) -> np.ndarray:
    """What the kernel divides a word of so many characters by."""
    total = np.zeros(len(lengths))
    for _, b, weight in GAPS:
        total += weight**2 * np.maximum(0, lengths + 2 - b)
    return 1 / np.sqrt(np.maximum(total, 1.0))


def _triples(w: Words):
    """(middle place, feature number, weight) of every gapped triple within a word, gap by gap."""
    first = np.where(w.blank, BEGIN, w.classes)
    last = np.where(w.blank, END, w.classes)
    middle = np.where(w.blank, 0, w.classes)
    before = np.concatenate([[0], np.cumsum(w.blank)])
    n = len(w.classes)
    for a, b, weight in GAPS:
        if n <= b:
            continue
        feature = (first[: n - b] << 10) | (middle[a : n - b + a] << 5) | last[b:]
        inside = before[b:n] == before[1 : n - b + 1]
        used = inside & (first[: n - b] > 0) & (middle[a : n - b + a] > 0) & (last[b:] > 0)
        yield a, b, weight, feature, used


def word_scores(w: Words, table_of: np.ndarray) -> np.ndarray:
    """The sum of the features' weights of every word, by the kernel's scale."""
    at = np.zeros(len(w.classes), np.float32)
    n = len(w.classes)
    for a, b, weight, feature, used in _triples(w):
        at[a : n - b + a] += np.where(used, table_of[feature], 0) * np.float32(weight)
    if not len(w.starts):
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(at, dtype=np.float64)])
    return (total[w.ends] - total[w.starts]) * _scale(w.ends - w.starts)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of single words, scaled; the explicit side of the kernel."""
    offsets = np.cumsum([0, *map(len, words)])
    w = split_words(np.frombuffer(b"".join(words), np.uint8), offsets)
    owner = np.zeros(len(w.classes), np.int64)
    for s, e, t in zip(w.starts.tolist(), w.ends.tolist(), w.text.tolist(), strict=True):
        owner[s:e] = t
    n, parts = len(w.classes), []
    scale = np.ones(len(words))
    scale[w.text] = _scale(w.ends - w.starts)
    for a, b, weight, feature, used in _triples(w):
        who = owner[a : n - b + a][used]
        parts.append((who, feature[used], weight * scale[who]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _dense(words: list[bytes]) -> np.ndarray:
    who, feature, weight = word_features(words)
    out = np.zeros((len(words), CLASSES**3), np.float32)
    np.add.at(out, (who, feature), weight)
    return out


def nystroem(landmarks: list[bytes]) -> np.ndarray:
    """Features to Nyström coordinates: landmark features times the inverse root of the landmark kernel."""
    f = _dense(landmarks)
    values, vectors = np.linalg.eigh((f @ f.T).astype(float))
    keep = values > 1e-6 * values[-1]
    return f.T @ (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)


def coordinates(words: list[bytes], into: np.ndarray) -> np.ndarray:
    """Nyström coordinates of single words, a block of them at a time."""
    out = np.zeros((len(words), into.shape[1]), np.float32)
    for i in range(0, len(words), 200):
        who, feature, weight = word_features(words[i : i + 200])
        order = np.argsort(who, kind="stable")
        who, rows = who[order], into[feature[order]] * weight[order, None].astype(np.float32)
        if len(who):
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            out[i + who[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, penalty: float = PENALTY) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps; the last weight is the intercept."""
    d = x.shape[1] + 1
    ridge = np.full(d, penalty)
    ridge[-1] = penalty * 1e-2
    w = np.zeros(d) if start is None else start.copy()

    def scores(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1].astype(np.float32) + v[-1]

    def loss(v: np.ndarray, score: np.ndarray) -> float:
        return float(weight @ np.maximum(0, 1 - y * score) ** 2 + v @ (ridge * v))

    now = scores(w)
    before = loss(w, now)
    for _ in range(12):
        active = 1 - y * now > 0
        gram, target = np.diag(ridge), np.zeros(d)
        at = np.flatnonzero(active)
        for i in range(0, len(at), 8192):
            rows = at[i : i + 8192]
            root = np.sqrt(weight[rows]).astype(np.float32)
            xa = np.concatenate([x[rows] * root[:, None], root[:, None]], axis=1)
            gram += xa.T @ xa
            target += xa.T @ (y[rows] * root)
        step = np.linalg.solve(gram, target) - w
        size = 1.0
        while True:
            tried = w + size * step
            now = scores(tried)
            after = loss(tried, now)
            if after <= before or size < 1e-3:
                break
            size /= 2
        w, gain, before = tried, before - after, after
        if gain <= 1e-4 * after:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``x`` and the intercept, by Newton steps with a slight penalty."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    v = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 2e-5), 1e-7) * weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), (z * weight[:, None]).T @ (y - p) - ridge * v)
        v += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return v


@dataclass
class Model:
    """One weight for each subsequence, the machine's intercept, and the calibration of a text's two worst words."""

    weights: np.ndarray
    intercept: float
    calibration: np.ndarray

    @property
    def learned(self) -> bool:
        """Whether there was anything to learn from; if not, all texts score a half and none is predicted toxic."""
        return bool(self.weights.any())

    def worst(self, texts: pa.Array) -> np.ndarray:
        """The scores of the worst and the second worst word of every text; FAR where there is none."""
        data, offsets = text_buffer(texts)
        out = np.full((len(offsets) - 1, 2), FAR)
        start = 0
        while start < len(out):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _SLICE, "right")) - 1)
            w = split_words(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            top_two(out, start + w.text, np.clip(word_scores(w, self.weights) + self.intercept, FAR, -FAR))
            start = end
        return out

    def text_scores(self, texts: pa.Array) -> np.ndarray:
        """The probability that a text is toxic."""
        z = self.worst(texts) @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def top_two(out: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
    """Raises the two columns of ``out`` to the two highest scores of each row."""
    order = np.lexsort((-score, row))
    row, score = row[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out[row[first], 0] = score[first]
    second = first[first + 1 < len(row)] + 1
    second = second[row[second] == row[second - 1]]
    out[row[second], 1] = score[second]


class _Sample:
    """Distinct words of the training texts, which text holds which, and all places of words."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.y = np.array(labels)
        number: dict[bytes, int] = {}
        held = [np.zeros(0, np.int32)]
        for text in texts:
            data = np.frombuffer(text.encode().lower(), np.uint8)
            w = split_words(data, np.array([0, len(data)]))
            raw = b" " + data.tobytes() + b" "
            own = (raw[s:e] for s, e in zip(w.first_byte.tolist(), w.end_byte.tolist(), strict=True))
            held.append(np.fromiter((number.setdefault(word, len(number)) for word in own), np.int32))
        self.words = list(number)
        self.word_all = np.concatenate(held)
        self.text_all = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in held[1:]])
        pairs = np.unique(self.text_all.astype(np.int64) << 32 | self.word_all)
        self.text, self.word = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)


def train(texts: list[str], labels: list[int], ratio: float = 1.0) -> Model:
    """Fit on a bounded list of labelled texts; ``ratio`` is how many clean texts each clean one here stands for."""
    s = _Sample(texts, labels)
    worded = np.zeros(len(s.y), bool)
    worded[s.text] = True
    if min((worded & (s.y == c)).sum() for c in (0, 1)) < 2:  # none is left to calibrate by
        return Model(np.zeros(CLASSES**3, np.float32), 0.0, np.zeros(3))
    rng = np.random.default_rng(SEED)
    toxic_text = s.y[s.text] == 1

    def counts(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        own = use[s.text]
        by_word = [np.bincount(s.word[own & (toxic_text == c)], minlength=len(s.words)) for c in (True, False)]
        return *by_word, max(1, int((use & (s.y == 1)).sum())), max(1, int((use & (s.y == 0)).sum()))

    every = np.ones(len(s.y), bool)
    toxic, clean, n1, n0 = counts(every)
    excess = toxic / n1 - 3 * clean / n0
    marks = [np.argsort(-excess, kind="stable")[: LANDMARKS * 3 // 4], np.argsort(-clean, kind="stable")[: LANDMARKS // 8]]
    marks.append(rng.choice(len(s.words), min(len(s.words), LANDMARKS // 8), replace=False))
    into = nystroem([s.words[k] for k in np.unique(np.concatenate(marks))])
    x = coordinates(s.words, into)

    def solve(use: np.ndarray) -> np.ndarray:
        toxic, clean, n1, n0 = counts(use)
        excess = toxic / n1 - 3 * clean / n0
        positive = np.flatnonzero((excess > 0) & (toxic > min(2, n1 // 20)))
        amount = np.maximum(excess[positive], 0)
        negative = np.flatnonzero(clean)
        own = use[s.text] & toxic_text
        text1, word1 = s.text[own], s.word[own]
        w = None
        for _ in range(ROUNDS):
            rows = np.concatenate([positive, negative])
            y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
            weight = np.concatenate([amount / max(amount.sum(), 1e-9), np.full(len(negative), 20.0 / max(1, int((clean > 0).sum())))])
            w = svm(x[rows], y, weight, w)
            score = x @ w[:-1].astype(np.float32) + w[-1]
            order = np.lexsort((-score[word1], text1))
            first = order[np.concatenate([[True], text1[order][1:] != text1[order][:-1]])]
            positive, times = np.unique(word1[first], return_counts=True)
            fine = clean[positive] / n0 < 0.1 * toxic[positive] / n1
            if fine.any():
                positive, times = positive[fine], times[fine]
            amount = np.sqrt(times)  # rare kinds of witnesses count for more than their share
            negative = np.flatnonzero((clean > 0) & (score > -2))
            negative = negative if len(negative) else np.flatnonzero(clean)
        return w

    # One fit on few labels may be far off: the machine is the mean of all fits, and a text is calibrated by the mean of those that did not see it.
    fits, held = [], np.zeros(len(s.word_all))
    for _ in range(REPEATS):
        fold = np.full(len(s.y), -1)
        for c in (0, 1):
            own = np.flatnonzero(worded & (s.y == c))
            fold[own] = rng.permutation(len(own)) % FOLDS
        for f in range(FOLDS):
            w = solve(fold != f)
            fits.append(w)
            at = np.flatnonzero((fold == f)[s.text_all])
            held[at] += (x @ w[:-1].astype(np.float32) + w[-1])[s.word_all[at]] / REPEATS
    final = np.mean(fits, axis=0)
    unseen = np.full((len(s.y), 2), FAR)
    top_two(unseen, s.text_all, np.clip(held, FAR, -FAR))
    weight = np.where(s.y == 1, 1.0, ratio)
    calibration = _logistic(unseen, s.y.astype(float), weight / weight.mean())
    return Model((into @ final[:-1].astype(np.float32)).astype(np.float32), float(final[-1]), calibration)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, held: int = 0) -> Model:
    """Fit on at most MOST_TOXIC toxic and MOST_CLEAN clean labelled texts of up to MOST_BYTES bytes.

    Labels are read only from rows whose crc32(id as text) mod ``parts`` is not ``held``; the sample is the
    first by a hash of the id, of the ids that have a text of one word and of that length. Its size bounds what is broadcast as ids and what the one task of the fit holds.
    """
    known = labels.where((remainder(id_col, parts) != held) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where((F.octet_length("text") <= MOST_BYTES) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    known = keep(known.join(docs.select("id"), "id", "left_semi"), "usable-labels")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    ids = picked[0].unionByName(picked[1]).collect()
    if not ids:
        return train([], [])
    sample = df.sparkSession.createDataFrame([(r["id"], r["y"]) for r in ids], f"id {known.schema['id'].dataType.simpleString()}, y int")
    texts = docs.join(F.broadcast(sample), "id")
    row = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).coalesce(1).mapInArrow(_fit_task(total.get(0, 0), total.get(1, 0)), _MODEL).first()
    return Model(np.frombuffer(row["weights"], np.float32), row["intercept"], np.array(row["calibration"])) if row else train([], [])


_MODEL = "weights binary, intercept double, calibration array<double>"


def _fit_task(clean: int, toxic: int):
    """The bounded sample in one task, to one row; the driver sees the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "y")), strict=True))
        if not rows:
            return
        seen = sum(y for _, _, y in rows)
        model = train([t for _, t, _ in rows], [y for _, _, y in rows], clean / max(1, len(rows) - seen) * max(1, seen) / max(1, toxic))
        cols = [pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.intercept], pa.float64()), pa.array([model.calibration.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["weights", "intercept", "calibration"])

    return run


def scorer(model: Model):
    """A column function of texts: the probability that a text is toxic; null counts as empty."""

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array(model.text_scores(texts), pa.float64())

    return toxic


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, held: int = 0, predict_at: float = 0.5) -> DataFrame:
    """The probability that a whole text is toxic.

    Defined cases: null and empty texts score as texts without a toxic word; null ids are scored, not
    learned from; null labels are skipped, of several labels of an id the highest counts, of several
    texts of an id the least is learned from; without two labelled texts of both classes every score is
    0 and nothing is predicted toxic; an empty table stays empty; other columns are ignored.

    Returns the id column, held_out, score, predicted.
    """
    model = fit(df, labels, id_col, text_col, label_col, parts, held)
    score = scorer(model)(F.col(text_col)) if model.learned else F.lit(0.0)
    scored = df.select(F.col(id_col).alias("id"), score.alias("score"))
    return scored.select(F.col("id").alias(id_col), (remainder("id", parts) == held).alias("held_out"), "score", is_toxic(model, F.col("score"), predict_at).cast("int").alias("predicted"))


def is_toxic(model: Model, score: Column, predict_at: float = 0.5) -> Column:
    return score >= predict_at if model.learned else F.lit(False)


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", predict_at: float = 0.5) -> DataFrame:
    """``df`` without the rows whose text is predicted toxic; all columns pass through, a column test with no shuffle."""
    model = fit(df, labels, id_col, text_col)
    return df.where(~is_toxic(model, scorer(model)(F.col(text_col)), predict_at))


@query("op8_toxicity")
def toxicity(spark, sf_dir):
    """No SQL: tested by held-out accuracy."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
