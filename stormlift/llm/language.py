"""Language identification by bit-sliced Bloom filters of letter n-grams.

For every language the n-grams that are usual in it are learned: those found in a least share of its
texts and in no much smaller share than in the language that has them most. All languages share one
filter: a slot holds a bitmask, one bit a language, an n-gram sets its languages' bits at a few slots,
and the masks at an n-gram's slots, and-ed, name all languages that contain it. A text is judged by
counting for every language the n-grams whose mask has its bit, less the false positives that the
language's share of set bits implies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import query, row_slices, table
from stormlift.llm.quality import remainder

#: Letters of an n-gram; a word's edge counts as one.
SIZE = 3
#: An n-gram is usual in a language that has it in this share of its texts, and in this share of the share of the language that has it most.
LEAST_SHARE, LEAST_RATIO = 0.002, 0.2
#: Probes of an n-gram, slots for each learned n-gram, most slots (n-grams beyond fill them further; the correction counts that in).
PROBES, SLOTS_EACH, MOST_SLOTS = 3, 16, 1 << 25
#: Distinct n-grams that a learning task holds before it hands on its counts.
HELD = 1 << 19
_SLICE = 1 << 19
#: A learning task's rows at a time, and the low bits of a hash that they take; the rest is left for the n-gram.
_ROW_BITS, _MOST_ROWS = np.uint64(12), 1 << 12
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & (1 << 64) - 1) for k in range(SIZE)]


# --- n-grams -------------------------------------------------------------------------------


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram of all texts, rows ascending, and whether a row has a letter.

    Words are longest runs of letters, lower-cased, with one edge on either side; an n-gram lies in one
    word and its edges, and holds a letter.
    """
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = points * _letters()[points]
    inside = code > 0
    at = np.flatnonzero(inside[1:] | inside[:-1]) + 1  # one edge between words, one at the end
    ends = np.cumsum([len(t) + 1 for t in low])
    code = np.concatenate([[0], code[at]]).astype(np.uint64)
    row = np.repeat(np.arange(len(low)), np.diff(np.searchsorted(at, ends, "right"), prepend=0))
    some = np.bincount(row[code[1:] > 0], minlength=len(low)) > 0
    m = len(code) - SIZE + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), some
    whole = np.ones(m, bool)
    h = np.zeros(m, np.uint64)
    for k in range(SIZE):
        if 0 < k < SIZE - 1:
            whole &= code[k : m + k] > 0
        h += code[k : m + k] * _FACTORS[k]
    h = h[whole]
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    return row[:m][whole], (h ^ (h >> np.uint64(29))) >> _ROW_BITS << _ROW_BITS, some  # the letter after the first is the text's own


# --- the filter ----------------------------------------------------------------------------


@dataclass
class Filter:
    """``masks`` (slots, bytes): bit l % 8 of byte l // 8 belongs to language l; ``false`` is each language's false-positive share."""

    languages: list
    masks: np.ndarray
    false: np.ndarray
    common: int

    def places(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        h = hashes * np.uint64((0xD6E8FEB86659FD93 * (2 * probe + 1)) & (1 << 64) - 1)
        return (h >> np.uint64(65 - len(self.masks).bit_length())).astype(np.int64)  # slots are a power of two

    def add(self, hashes: np.ndarray, masks: np.ndarray) -> None:
        for p in range(PROBES):
            np.bitwise_or.at(self.masks, self.places(hashes, p), masks)

    def settled(self) -> Filter:
        fill = np.array([(self.masks[:, n // 8] >> (n % 8) & 1).mean() for n in range(len(self.languages))])
        self.false = fill**PROBES
        return self

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each n-gram."""
        found = self.masks[self.places(hashes, 0)]
        for p in range(1, PROBES):
            found = found & self.masks[self.places(hashes, p)]
        return found

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For every text and language the share of n-grams contained, corrected for false positives; and whether a text has a letter."""
        row, hashes, some = ngrams(texts)
        found = self.containing(hashes)
        n = len(texts)
        total = np.bincount(row, minlength=n).astype(float)[:, None]
        of_byte = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(float)
        each = [np.bincount(row * 256 + found[:, b], minlength=n * 256).reshape(n, 256) @ of_byte for b in range(found.shape[1])]
        counts = np.concatenate(each, axis=1)[:, : len(self.languages)]
        corrected = np.maximum(0, counts - total * self.false) / np.maximum(1 - self.false, 1e-9)
        return np.minimum(1, corrected / np.maximum(total, 1)), some


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, docs): in how many texts of a language an n-gram stands, summed up to HELD n-grams at a time."""
    held: dict = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lang, (grams, docs) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(docs)], names=["lang", "gram", "docs"])
        held.clear()

    for batch in batches:
        for part in (p for n in range(0, batch.num_rows, _MOST_ROWS) for p in row_slices(batch.slice(n, _MOST_ROWS), "text", _SLICE)):
            row, hashes, _ = ngrams(part.column("text").to_pylist())
            langs = part.column("lang").to_pylist()
            pairs = np.sort(hashes | row.astype(np.uint64))  # the high bits name the n-gram, the low ones the row
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
            row, hashes = (pairs & (np.uint64(1) << _ROW_BITS) - np.uint64(1)).astype(np.int64), pairs >> _ROW_BITS << _ROW_BITS
            names = np.array(langs, object)
            for lang in sorted(set(langs)):
                own = hashes[(names == lang)[row]]  # ascending
                if not len(own):
                    continue
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                grams, docs = own[first], np.diff(np.append(first, len(own)))
                if lang in held:
                    grams, where = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                    docs = np.bincount(where, weights=np.concatenate([held[lang][1], docs])).astype(np.int64)
                held[lang] = grams, docs.astype(np.int64)
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield from hand_on()
    yield from hand_on()


def learn(docs: DataFrame) -> Filter:
    """The filter of (text, lang), neither null.

    Counts are made in the tasks, added up by n-gram, and only usual n-grams, as (hash, mask), leave for the
    driver: at most as many for a language as its average text has n-grams divided by LEAST_SHARE, however
    many texts there are.
    """
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros((1, 1), np.uint8), np.zeros(0), 0)
    spark = docs.sparkSession
    named = spark.createDataFrame([(x, n, sizes[x]) for n, x in enumerate(languages)], "lang string, no int, n long")
    counted = docs.select("text", "lang").mapInArrow(_counts, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    shares = counted.join(named, "lang").select("gram", "no", (F.col("docs") / F.col("n")).alias("share"), "docs")
    most = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("no", "share")).alias("all"))
    usual = F.filter("all", lambda x: (x["share"] >= LEAST_SHARE) & (x["share"] >= LEAST_RATIO * F.col("most")))
    kept = most.where(F.col("most") >= LEAST_SHARE).select("gram", F.transform(usual, lambda x: x["no"]).alias("nos"))
    width = -(-len(languages) // 8)

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nos = batch.column("nos")
            at = np.repeat(np.arange(batch.num_rows), nos.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = nos.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((batch.num_rows, width), np.uint8)
            np.bitwise_or.at(out, (at, flat // 8), np.left_shift(1, flat % 8).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("gram").to_numpy().tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["grams", "masks"])

    packed = [(np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["masks"], np.uint8).reshape(-1, width)) for r in kept.mapInArrow(masks, "grams binary, masks binary").collect()]
    n = sum(len(g) for g, _ in packed)
    common = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    out = Filter(languages, np.zeros((min(MOST_SLOTS, 1 << max(6, (SLOTS_EACH * n - 1).bit_length())), width), np.uint8), np.zeros(len(languages)), common)
    for grams, bits in packed:
        out.add(grams, bits)
    return out.settled()


def language_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2, unknown: str = "und") -> DataFrame:
    """The language of every whole text.

    Learned from texts and languages of rows whose crc32(id as text) mod ``parts`` is not ``held``; only the
    text enters a prediction. The score is the winner's share of n-grams over its sum with the runner-up's.

    Defined cases: null texts, and those without a letter, are ``unknown`` with score 0, as all are if there
    is nothing to learn from; a text of which no language contains an n-gram gets the language of most learned
    texts and score 0; equal shares go to the language that sorts first; rows without an id are learned from
    and not held out; null languages and null texts are not learned from; ids that repeat keep a row each; an empty table stays
    empty; other columns are ignored.

    Returns the id column, held_out, lang_pred, score.
    """
    rest = remainder(id_col, parts)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (rest == held).alias("held_out"))
    model = learn(docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # MOST_SLOTS slots at most
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                names, scores = _judge(model, part.column("text").to_pylist(), unknown)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return docs.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _judge(model: Filter, texts: list[str | None], unknown: str) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [unknown] * len(texts), np.zeros(len(texts))
    shares, some = model.shares(texts)
    best = shares.argmax(axis=1)
    ranked = np.sort(shares, axis=1)
    top, second = ranked[:, -1], ranked[:, -2] if shares.shape[1] > 1 else np.zeros(len(texts))
    scores = np.where(some & (top > 0), top / np.maximum(top + second, 1e-300), 0.0)
    best = np.where(top > 0, best, model.common)
    return [model.languages[b] if s else unknown for b, s in zip(best.tolist(), some.tolist(), strict=True)], scores


@query("op11_language_id")
def language_id(spark, sf_dir):
    """No SQL: the filters' hashes have no counterpart; tested by held-out accuracy and against plain sets."""
    return language_scores(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
