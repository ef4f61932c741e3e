"""SimHash near-dedup, linked through Golay-code fuzzy hashes.

The binary Golay code is perfect: every 23-bit word lies within three bits of exactly one codeword.
The codewords that the 24 words within one bit of a word decode to, one to six of them, are its keys;
two words that differ in two bits or fewer have a word within one bit of both, and so share a key.

A 64-bit fingerprint is cut in three segments, A and B of 23 bits and C of 18. If at most four bits
differ, one of these families of keys agrees, whatever the way the errors fall on the segments:

- none in C: then A or B has two errors at most: (C, key of A), (C, key of B);
- some in C, A and B with two at most: (key of A, key of B);
- one in C, three in A or in B, none in the other: (B, key of C), (A, key of C).

Keys only gather candidates; every pair is verified by its real distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.llm.bloom import Bloom
from stormlift.llm.common import LOWER, UPPER, fresh, keep, query, table, text_of
from stormlift.llm.components import components

#: The generator polynomial of the [23, 12] Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR, LENGTH, CHECK_BITS = 0xAE3, 23, 11
SEED, MAX_BITS = 42, 4
#: Fingerprints of one key that are compared in one go; larger groups are compared block by block.
BLOCK = 2048

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(UPPER, LOWER)


def fingerprint(text: str, shingle: int = 4) -> int:
    """Bit is 1 if set in over half of the XXH64 hashes of the shingles; 0 without words."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    shingles = (" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        count += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, tag, fp) of every row; fp is the fingerprint as a signed long, tag a hash that tells texts of one id apart."""
    text = text_of(text_col)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(fp.view(np.int64))], names=["id", "tag", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tag long, fp long")


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of every byte position's bits, and the error pattern of every syndrome."""
    remainder = []
    for bit in range(LENGTH):
        r = 1 << bit
        for k in range(LENGTH - 1, CHECK_BITS - 1, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - CHECK_BITS)
        remainder.append(r)
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for bit in range(12):
        low[1 << bit : 2 << bit] = low[: 1 << bit] ^ remainder[bit]
    for bit in range(11):
        high[1 << bit : 2 << bit] = high[: 1 << bit] ^ remainder[12 + bit]
    pattern = np.zeros(1 << CHECK_BITS, np.int64)
    for a in range(LENGTH):
        for b in range(a, LENGTH):
            for c in range(b, LENGTH):
                e = (1 << a) | (1 << b) | (1 << c)
                s = 0
                for k in {a, b, c}:
                    s ^= remainder[k]
                pattern[s] = e
    return np.concatenate([low, high]), pattern


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit number of the nearest codeword of 23-bit words."""
    syndromes, pattern = _errors()
    s = syndromes[words & 0xFFF] ^ syndromes[(1 << 12) + (words >> 12)]
    return (words ^ pattern[s]) >> CHECK_BITS


def near_keys(words: np.ndarray) -> np.ndarray:
    """Six columns: the numbers of all codewords near each word, ascending, the last repeated where there are fewer."""
    ball = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(LENGTH))], axis=1)
    near = np.sort(decode(ball), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    rank = np.cumsum(new, axis=1) - 1
    out = np.repeat(near[:, -1:], 6, axis=1)
    row = np.broadcast_to(np.arange(len(words))[:, None], near.shape)
    out[row[new], rank[new]] = near[new]
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of 64-bit fingerprints; the top three bits of a key name its family."""
    fp = fp.view(np.uint64)
    a = (fp & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fp >> np.uint64(46)).astype(np.int64)
    ka, kb, kc = near_keys(a), near_keys(b), near_keys(c)
    families = [(c[:, None] << 12) | ka, (c[:, None] << 12) | kb, ((ka[:, :, None] << 12) | kb[:, None, :]).reshape(len(fp), -1), (b[:, None] << 12) | kc, (a[:, None] << 12) | kc]
    out = np.concatenate([(n << 60) | f for n, f in enumerate(families)], axis=1)
    out.sort(axis=1)
    new = np.concatenate([np.ones((len(fp), 1), bool), out[:, 1:] != out[:, :-1]], axis=1)
    return np.broadcast_to(np.arange(len(fp))[:, None], out.shape)[new], out[new]


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        if len(fp):
            row, key = keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def _forest(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join what lies within ``most`` bits between two blocks, or in one if they are the same; one per merge."""
    same = left is right
    nodes = left if same else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift, out = 0 if same else len(left), []
    for i0 in range(0, len(left), 256):
        near = np.bitwise_count(left[i0 : i0 + 256, None].view(np.uint64) ^ right[None, :].view(np.uint64)) <= most
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = find(int(i) + i0), find(int(j) + shift)
            if x != y:
                parent[x] = y
                out.append((int(left[i + i0]), int(right[j])))
    return out


def _links(most: int):
    """Links within groups of (key, i, j), which arrive sorted by group: a group is one block, or two."""

    def solve(side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        left = np.unique(fp[side != 2])
        return _forest(left, left if (side == 0).all() else np.unique(fp[side == 2]), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> list[tuple[int, int]]:
            """Links of whole groups: neighbours of pairs at once, larger groups one by one."""
            if len(rows) < 2:
                return []
            new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(rows)))
            two = starts[sizes == 2]
            x, y = rows[two, 4], rows[two + 1, 4]
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= most
            out = list(zip(x[near].tolist(), y[near].tolist(), strict=True))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += solve(rows[s : s + n, 3], np.ascontiguousarray(rows[s : s + n, 4]))
            return out

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            if not len(rows):
                continue
            last = rows[-1, :3]
            if held and (held[0][0, :3] == last).all():
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            cut = int(np.flatnonzero((rows[:, :3] != last).any(axis=1))[-1]) + 1 if (rows[:, :3] != last).any() else 0
            held = [rows[cut:]]
            yield batch_of(flush(rows[:cut]))
        if held:
            yield batch_of(flush(np.concatenate(held)))

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all that differ in ``max_bits`` or fewer.

    Within a group of one key only a spanning forest leaves the task. Groups of more than BLOCK
    fingerprints are dealt out as pairs of blocks, so no task holds more than two blocks of a group.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the key families cover distances up to {MAX_BITS}")
    keyed = distinct.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = keep(large, "large-keys")
    zero = F.lit(0)
    whole = keyed if large.isEmpty() else keyed.join(large, "key", "left_anti")
    groups = whole.select("key", zero.alias("i"), zero.alias("j"), zero.alias("side"), "fp")
    if not large.isEmpty():
        dealt = keyed.join(large, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        groups = groups.unionByName(
            dealt.select(
                "key",
                F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"),
                F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
                "fp",
            )
        )
    return groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(max_bits), "u long, v long")


def _placed(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` with the root fingerprint and the smallest id of every row's component."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and component of every row: rows link at ``max_bits`` or fewer differing bits, to any length of chain.

    Texts are lower-cased in A-Z only; words are runs without ASCII blanks; fewer words than a shingle
    make one shingle of all. Equal fingerprints are one node of the search, however many rows have them.

    Defined cases: null and empty texts, and texts of blanks, have fingerprint zero and link like any
    other; a component whose ids are all null has a null id; rows that share an id keep a row each; an
    empty table stays empty; other columns are ignored.

    Returns the id column, fingerprint (16 hex digits), component_id (smallest id reachable).
    """
    prints = keep(fingerprints(df, id_col, text_col, shingle).drop("tag"), "fingerprints")
    return _placed(prints, max_bits).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with one row of every component: one of its smallest id. All columns pass through.

    Decided on (id, hash of the text, fingerprint) alone. The rows to drop are marked by id and hash; a
    filter of bounded size over the marks lets all other rows pass where they are, and only what it
    admits is joined to the marks, so that texts without a near copy are not moved.

    Defined cases: rows without an id stay, and still link others; an id goes only with the text that has a near copy; of
    several texts of the smallest id in a component that with the least hash stays, of equal rows one;
    null and empty texts are near copies of each other; an empty table stays empty.
    """
    prints = keep(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    placed = _placed(prints, max_bits)
    own = F.col("id") == F.col("component_id")
    gone = placed.where(~own).select("id", "tag", F.lit(False).alias("stays"))
    heads = placed.where(own).groupBy("root", "id").agg(F.count("*").alias("n"), F.min("tag").alias("least"), F.max("tag").alias("most")).where(F.col("n") > 1)
    stay = heads.select("id", F.col("least").alias("tag"), F.lit(True).alias("stays"))
    several = heads.where(F.col("least") != F.col("most")).select("root", "least")  # several texts of one id: the others go
    lesser = placed.where(own).join(several, "root").where(F.col("tag") != F.col("least")).select("id", "tag", F.lit(False).alias("stays"))
    at, of, stays, key = (fresh(df, c) for c in ("near_id", "near_tag", "near_stays", "near_key"))
    marks = gone.unionByName(stay).unionByName(lesser).groupBy("id", "tag").agg(F.max("stays").alias(stays))
    marks = keep(marks.select(F.col("id").alias(at), F.col("tag").alias(of), stays, F.xxhash64("id", "tag").alias(key)), "near-marks")
    seen = Bloom.of(marks, key)

    @F.arrow_udf("boolean")
    def marked(keys: pa.Array) -> pa.Array:
        return pa.array(seen.holds(keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    tag = F.xxhash64(text_of(text_col))
    hit = F.col(id_col).isNotNull() & marked(F.xxhash64(F.col(id_col), tag))
    met = df.where(hit).join(marks, (df[id_col] == marks[at]) & (tag == marks[of]), "left")
    columns = [f"`{c}`" for c in df.columns]
    rest = met.where(F.col(stays).isNull())
    first = met.where(F.col(stays)).dropDuplicates([at, of])
    return df.where(~hit).unionByName(rest.unionByName(first).select(*columns))


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    """No SQL: engines lack XXH64 under this seed; tested against brute force over all pairs."""
    return near_duplicates(table(spark, sf_dir, "documents"))
