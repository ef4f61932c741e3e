"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlift.llm.bloom import Bloom
from stormlift.llm.common import fresh, keep, query, row_slices, table, text_buffer, text_of
from stormlift.llm.words import runs, words

#: Words of the shortest tile, and of the seeds that find what may be tiled; least share of an item that tiles must cover; words of the shortest item.
TILE_WORDS, COVERAGE, ITEM_WORDS = 3, 0.8, 5
_SLICE = 1 << 19


def tiles(item: list, doc: list, shortest: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """(item start, doc start, length): the longest common run without a marked word, marked, again and again.

    Ties go to the earlier place in the item, then in the document. Windows of ``shortest`` words are
    found by a running Karp-Rabin hash and compared word by word; windows in a row along a diagonal
    make the longest matches. A match that meets marked words is cut to what is left and waits its turn.
    """
    if len(item) < shortest or len(doc) < shortest:
        return []
    number: dict = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    b = np.array([number.get(w, -1) for w in doc], np.int64)

    def windows(x: np.ndarray) -> np.ndarray:
        h = np.zeros(len(x) - shortest + 1, np.uint64)
        for k in range(shortest):
            h = h * np.uint64(0x100000001B3) + x[k : len(x) - shortest + 1 + k].astype(np.uint64)
        return h

    ha, hb = windows(a), windows(b)
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    count = high - low
    i = np.repeat(np.arange(len(ha)), count)
    d = order[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    same = np.ones(len(i), bool)
    for k in range(shortest):
        same &= a[i + k] == b[d + k]
    i, d = i[same], d[same]
    if not len(i):
        return []
    by = np.lexsort((i, d - i))
    i, d = i[by], d[by]
    new = np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(i) != 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + shortest - 1
    queue = [(-int(n), int(x), int(y)) for n, x, y in zip(length, i[first], d[first], strict=True)]
    heapq.heapify(queue)
    used_a, used_b, out = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    while queue:
        n, x, y = heapq.heappop(queue)
        n = -n
        free = ~(used_a[x : x + n] | used_b[y : y + n])
        if free.all():
            used_a[x : x + n] = used_b[y : y + n] = True
            out.append((x, y, n))
            continue
        step = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if e - s >= shortest:
                heapq.heappush(queue, (s - e, x + s, y + s))
    return out


def word_list(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    _, start, end, _ = words(data, np.array([0, len(data)]))
    raw = data.tobytes().lower()  # bytes: A-Z only
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _item_seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                row, _, _, hashed = words(*text_buffer(part.column("text")))
                first, seed = runs(row, hashed, TILE_WORDS)
                sizes = np.bincount(row, minlength=part.num_rows)
                begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                long = sizes[row[first]] >= least if len(first) else np.zeros(0, bool)
                first, seed = first[long], seed[long]
                at = row[first] if len(first) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(at)), pa.array(sizes[at], pa.int64()), pa.array(first - begins[at], pa.int32()), pa.array(seed.view(np.int64))],
                    names=["item", "words", "pos", "seed"],
                )

    return run


def _suspects(shared: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                data, offsets = text_buffer(part.column("text"))
                row, _, _, hashed = words(data, offsets)
                first, seed = runs(row, hashed, TILE_WORDS)
                hit = shared.holds(seed)
                hits: dict[int, set] = {}
                for r, s in zip(row[first[hit]].tolist(), seed[hit].view(np.int64).tolist(), strict=True):
                    hits.setdefault(r, set()).add(s)
                texts = [None] * part.num_rows
                digests = [None] * part.num_rows
                for r in hits:
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    texts[r], digests[r] = raw.decode(), hashlib.sha256(raw).digest()
                lists = pa.array([sorted(hits[r]) if r in hits else None for r in range(part.num_rows)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), pa.array(texts, pa.string()), lists], names=["id", "digest", "text", "seeds"])

    return run


def _coverable(coverage: float):
    """The pairs whose shared seeds cover enough of the item. Every run of a tile is a seed: tiles cover no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for n, (seeds, own, size) in enumerate(zip(batch.column("seeds").to_pylist(), batch.column("own").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                seeds, covered, last = set(seeds), 0, -TILE_WORDS
                for at, seed in enumerate(own):
                    if seed in seeds:
                        covered += min(TILE_WORDS, at - last)
                        last = at
                if covered / size >= coverage:
                    some.append(n)
            at = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(at), batch.column("item").take(at)], names=["digest", "item"])

    return run


def _tiled(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share = [], []
            texts: dict[str, list] = {}
            for n, (item, text) in enumerate(zip(batch.column("item_text").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if text not in texts:
                    texts = {text: word_list(text)}  # the pairs of a document mostly follow each other
                own = word_list(item)
                covered = sum(t[2] for t in tiles(own, texts[text])) / len(own)
                if covered >= coverage:
                    keep.append(n)
                    share.append(covered)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(at), batch.column("item").take(at), pa.array(share, pa.float64())], names=["digest", "item", "coverage"])

    return run


def _found(docs: DataFrame, items: DataFrame, coverage: float, item_words: int = ITEM_WORDS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (id, text) as scanned (id, digest), and (digest, item, coverage) of what is contaminated."""
    kind = items.schema["item"].dataType.simpleString()
    items = items.groupBy("text").agg(F.min("item").alias("item"))
    texts = keep(items.select(F.monotonically_increasing_id().alias("key"), "item", "text"), "items")
    seeds = texts.select(F.col("key").alias("item"), "text").mapInArrow(_item_seeds(item_words), "item long, words long, pos int, seed long")
    seeds = keep(seeds, "seeds")
    schema = f"id {docs.schema['id'].dataType.simpleString()}, digest binary, text string, seeds array<long>"
    scanned = keep(docs.mapInArrow(_suspects(Bloom.of(seeds, "seed")), schema), "suspects")
    suspects = scanned.where(F.col("seeds").isNotNull()).select("digest", "text", "seeds").dropDuplicates(["digest"])
    held = keep(suspects.select("digest", "seeds"), "suspect-seeds")
    asked = held.select("digest", F.explode("seeds").alias("seed"))
    common = asked.groupBy("seed").agg(F.count("*").alias("docs"))
    # Tiles of three words and more that cover an item enough hold a third as many of its seeds at least; of so many, all but one may be left out of the search.
    sure = F.ceil(F.ceil(F.col("words") * coverage - 1e-9) / TILE_WORDS)
    order = Window.partitionBy("item").orderBy(F.desc("docs"), "pos")
    rare = seeds.join(common, "seed").withColumn("place", F.row_number().over(order)).where(F.col("place") >= sure).select("seed", "item").distinct()
    met = asked.join(rare, "seed").select("digest", "item").distinct()
    own = seeds.groupBy("item", "words").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seed"))), lambda x: x["seed"]).alias("own"))
    pairs = met.join(held, "digest").join(own, "item").mapInArrow(_coverable(coverage), "digest binary, item long")
    named = pairs.join(texts.select(F.col("key").alias("item"), F.col("text").alias("item_text"), F.col("item").alias("name")), "item")
    work = named.join(suspects.select("digest", "text"), "digest").select("digest", F.col("name").alias("item"), "item_text", "text")
    return scanned.select("id", "digest"), work.mapInArrow(_tiled(coverage), f"digest binary, item {kind}, coverage double")


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, item_words: int = ITEM_WORDS
) -> DataFrame:
    """Which documents hold passages of the benchmark, in one piece or reordered.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Documents that
    share three-word seeds with an item are joined to it; if the seeds cover ``coverage`` of the
    item's words, greedy string tiling marks the longest common runs of three words or more, and a
    document is contaminated if the tiles cover ``coverage`` of the item. Seeds cover all that tiles do,
    so no pair is missed. Of the seeds an item must share, its most common ones but one are not searched
    for, which keeps seeds that stand everywhere out of the join. A filter of bounded size over the benchmark's seeds keeps all other seeds of the
    corpus out of the shuffle; its false hits fall to the join. Equal texts are tiled once, pair by pair, whatever the number of copies.

    Defined cases: null and empty texts are clean; items of fewer than ``item_words`` words (or
    of a seed's three), null or empty ones match nothing; items with equal texts count as one, under the smallest id; an item without an id
    counts but is not listed; ids that repeat or are
    null keep a row each; empty tables give clean or no rows; other columns are ignored.

    Returns the id column, contaminated, n_items, item_ids (ascending), coverage (the highest; 0 if clean).
    """
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), text_of(item_text_col).alias("text"))
    scanned, found = _found(docs, items, coverage, item_words)
    bad = found.groupBy("digest").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("item_ids"), F.max("coverage").alias("coverage"))
    suspect = scanned.where(F.col("digest").isNotNull()).join(bad, "digest", "left")
    none = F.array().cast(bad.schema["item_ids"].dataType)
    out = suspect.unionByName(scanned.where(F.col("digest").isNull()), allowMissingColumns=True)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def without_benchmark(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text ``contamination`` finds contaminated, whatever other rows share the id; all columns pass through."""
    items = benchmark.select(F.col("item_id").alias("item"), text_of("text").alias("text"))
    scanned, found = _found(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), items, COVERAGE)
    bad = found.select("digest").distinct().join(scanned.where(F.col("digest").isNotNull()), "digest").distinct()
    mark, digest = fresh(df, "bad_id"), fresh(df, "bad_digest")
    bad = bad.select(F.col("id").alias(mark), F.col("digest").alias(digest))
    return df.join(bad, df[id_col].eqNullSafe(bad[mark]) & (F.unhex(F.sha2(text_of(text_col), 256)) == bad[digest]), "left_anti")


@query("op10_decontamination")
def decontamination(spark, sf_dir):
    """No SQL for greedy tiling; tested against a naive tiling of all pairs."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
