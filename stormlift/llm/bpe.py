"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters says so, so equal passages give equal
chunks wherever they stand. A chunk that several places share is encoded once, in the task its hash
deals it to; all others are encoded where they are. Token sequences of chunks do not simply add up
at the joins: a join is repaired by encoding the text around it anew, out to the nearest places on
both sides where any encoding must begin a new word (a blank after a non-blank), and putting that
in place of the tokens there. Up to those places the old and the new tokens agree exactly, and the
result equals the encoding of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.llm.bloom import Bloom
from stormlift.llm.common import keep, query, row_slices, table, text_buffer, text_of

#: Fixed values of the public vocabulary: its word pattern and its one special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

#: The pattern's blanks. Beyond this length a run of them overflows the pattern's look-ahead.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")

#: A chunk ends where the rolling hash of the last WINDOW bytes has CUT_BITS zero bits, or after MOST bytes.
WINDOW, CUT_BITS, MOST = 16, 9, 1 << 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Byte-level BPE of a ranks file; texts to ids (uint16) and back."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.sizes = np.zeros(SPECIAL_ID + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.sizes[SPECIAL_ID] = len(SPECIAL)
        self.names = [str(i) for i in range(SPECIAL_ID + 1)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text. Runs of blanks too long for the pattern's look-ahead are cut out and encoded as the one word they are."""
        out, at = [], 0
        for m in _LONG_BLANK.finditer(text):
            last = m.end() == len(text) or text.startswith(SPECIAL, m.end())
            out.append(self._encode(text[at : m.start()]))
            at = m.end() if last else m.end() - 1  # the last blank belongs to what follows
            out.append(np.array(self.encoding._core_bpe.encode_single_piece(text[m.start() : at].encode()), np.uint16))
        return np.concatenate([*out, self._encode(text[at:])]) if out else self._encode(text)

    def _encode(self, text: str) -> np.ndarray:
        allowed = {SPECIAL} if SPECIAL in text else set()
        return np.array(self.encoding.encode(text, allowed_special=allowed, disallowed_special=()), dtype=np.uint16)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of chunks in the buffer: content-defined cuts, at character starts, and the ends of all texts."""
    h = (data.astype(np.uint32) + 1) * np.uint32(2654435761)
    factor = np.uint32(0x01000193)
    for k in (1, 2, 4, 8):  # the hash of 2, 4, 8, 16 bytes from that of half as many
        rolled = h.copy()
        rolled[k:] += h[:-k] * factor
        h, factor = rolled, np.uint32(int(factor) ** 2 & 0xFFFFFFFF)
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    at = at[at - offsets[np.searchsorted(offsets, at, "right") - 1] >= WINDOW]  # the hash must not see the text before
    at = np.union1d(at, offsets[1:])
    gaps = np.diff(at, prepend=0)
    if (gaps > MOST).any():  # a long stretch without a cut is cut at a fixed length
        extra = [np.arange(at[i] - gaps[i] + MOST, at[i], MOST) for i in np.flatnonzero(gaps > MOST)]
        extra = np.concatenate(extra)
        for _ in range(3):
            extra = np.where((data[extra] & 0xC0) == 0x80, extra - 1, extra)
        at = np.union1d(at, extra)
    return at


def chunks(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of every chunk of every text, in order; empty texts have none."""
    ends = cut_points(data, offsets)
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    rows = np.searchsorted(offsets, starts, "right") - 1
    return list(zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True))


def chunk_hash(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_SAFE = re.compile(rb"(?<=[!-\x7f])[ \n]")


def _seam(raw: bytes, join: int) -> tuple[int, int]:
    """The nearest places around ``join`` where every encoding begins a new word: an ASCII non-blank, then a blank."""
    left = join
    while left > 0:
        low = max(0, left - 64)
        found = None
        for found in _SAFE.finditer(raw, low, left + 1):
            pass
        if found and found.start() <= join:
            left = found.start()
            break
        left = low
    m = _SAFE.search(raw, join)
    return left, m.start() if m else len(raw)


def encode_chunked(raw: bytes, cuts: list[tuple[int, int]], known: dict[int, np.ndarray], c: Codec) -> np.ndarray:
    """Ids of ``raw`` from its chunks ``cuts`` (start, end): those in ``known`` by number, others encoded here, joins repaired."""
    pieces: list[tuple[int, int, np.ndarray | None]] = []
    start = None
    for i, (a, b) in enumerate(cuts):  # neighbours that nobody shares are encoded in one go
        if i in known:
            if start is not None:
                pieces.append((start, a, None))
                start = None
            pieces.append((a, b, known[i]))
        elif start is None:
            start = a
    if start is not None:
        pieces.append((start, len(raw), None))
    seams: list[list[int]] = []
    for a, _, _ in pieces[1:]:
        left, right = _seam(raw, a)
        if seams and left <= seams[-1][1]:
            seams[-1][1] = max(right, seams[-1][1])
        else:
            seams.append([left, right])
    out, s = [], 0
    for a, b, ids in pieces:
        at = a
        while s < len(seams) and seams[s][1] <= a:
            s += 1
        ends, k = None, s
        spans = []
        while at < b:  # what of this piece lies outside the seams
            while k < len(seams) and seams[k][1] <= at:
                k += 1
            if k < len(seams) and seams[k][0] <= at:
                at = min(b, seams[k][1])
                continue
            end = min(b, seams[k][0]) if k < len(seams) else b
            spans.append((at, end))
            at = end
        for x, y in spans:
            if ids is None:
                out.append((x, c.encode(raw[x:y].decode())))
                continue
            if ends is None:
                ends = np.concatenate([[0], np.cumsum(c.sizes[ids])]) + a
            i, j = np.searchsorted(ends, [x, y])
            if ends[i] != x or ends[j] != y:
                raise ValueError("tokens of a chunk do not end at a safe place")
            out.append((x, ids[i:j]))
    out += [(a, c.encode(raw[a:b].decode())) for a, b in seams]
    out.sort(key=lambda x: x[0])
    return np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.uint16)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, copies): the chunks of a slice of texts, each once."""
    for batch in batches:
        for part in row_slices(batch, "text"):
            data, offsets = text_buffer(part.column("text"))
            raw = data.tobytes()
            copies = Counter(chunk_hash(raw[a:b]) for _, a, b in chunks(data, offsets))
            yield pa.RecordBatch.from_arrays([pa.array(list(copies), pa.binary()), pa.array(list(copies.values()), pa.int64())], names=["hash", "copies"])


_FIELDS = pa.struct([("hash", pa.binary()), ("bytes", pa.binary())])
_RESULT = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32())}
_RESULT_DDL = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _finish(ids: np.ndarray, c: Codec, with_ids: bool) -> tuple:
    numbers = ids.tolist()
    joined = ",".join(map(c.names.__getitem__, numbers))
    decoded = c.decode(ids).decode("utf-8", "replace").encode()
    return len(numbers), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), numbers if with_ids else None


def _route(path: str, shared: Bloom, with_ids: bool):
    """Texts without a shared chunk are encoded here; of all others the chunks go on, runs of unshared ones as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in row_slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                raw, found = data.tobytes(), chunks(data, offsets)
                hashes = [chunk_hash(raw[a:b]) for _, a, b in found]
                hit = shared.holds(hashes)
                pieces: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for (row, a, b), h, is_hit in zip(found, hashes, hit, strict=True):
                    own = pieces[row]
                    if is_hit or not own or own[-1]["hash"] is not None:
                        own.append({"hash": h if is_hit else None, "bytes": raw[a:b]})
                    else:
                        own[-1]["bytes"] += raw[a:b]
                whole = [all(p["hash"] is None for p in own) for own in pieces]
                done = [_finish(c.encode(raw[offsets[r] : offsets[r + 1]].decode()), c, with_ids) if w else (None,) * 4 for r, w in enumerate(whole)]
                cols = [part.column("id"), pa.array([None if w else chunk_hash(raw[offsets[r] : offsets[r + 1]]) for r, w in enumerate(whole)], pa.binary())]
                cols.append(pa.array([None if w else own for w, own in zip(whole, pieces, strict=True)], pa.list_(_FIELDS)))
                cols += [pa.array([d[k] for d in done], t) for k, t in enumerate(_RESULT.values())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "digest", "pieces", *_RESULT])

    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode(x.decode()).tobytes() for x in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(ids, pa.binary())], names=["hash", "chunk_ids"])

    return run


def _assemble(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            done = []
            for pieces, known in zip(batch.column("pieces").to_pylist(), batch.column("known").to_pylist(), strict=True):
                ends = np.cumsum([len(p["bytes"]) for p in pieces]).tolist()
                cuts = list(zip([0, *ends[:-1]], ends, strict=True))
                numbered = {k["pos"]: np.frombuffer(k["chunk_ids"], np.uint16) for k in known or ()}
                done.append(_finish(encode_chunked(b"".join(p["bytes"] for p in pieces), cuts, numbered, c), c, with_ids))
            cols = [batch.column("digest"), *(pa.array([d[k] for d in done], t) for k, t in enumerate(_RESULT.values()))]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", *_RESULT])

    return run


def bpe_encode(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and digests of the ids and of the text decoded from them.

    One pass counts the chunks of all texts; a second encodes texts without a shared chunk at once,
    writes the others as chunks to the shared folder, and a filter of bounded size over the shared hashes
    tells the two apart (a false hit only sends a chunk the longer way). Shared chunks are grouped by
    hash, encoded once each and joined to the texts that hold them; equal texts are put together once,
    and only the results go back to their rows.

    Defined cases: null and empty texts have no tokens; the string of the special token becomes its
    id; ids that repeat or are null keep a row each; an empty table stays empty; other columns are ignored.

    Returns the id column, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256
    and, with ``with_ids``, ids.
    """
    path = vocabulary or default_vocabulary()
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    counted = docs.select("text").mapInArrow(_hashes, "hash binary, copies long").groupBy("hash").agg(F.sum("copies").alias("copies"))
    shared = Bloom.of(keep(counted.where(F.col("copies") > 1).select("hash"), "shared"), "hash")
    schema = f"id {docs.schema['id'].dataType.simpleString()}, digest binary, pieces array<struct<hash: binary, bytes: binary>>, {_RESULT_DDL}"
    routed = keep(docs.mapInArrow(_route(path, shared, with_ids), schema), "bpe")
    waiting = routed.where(F.col("pieces").isNotNull()).select("id", "digest", "pieces")
    parts = waiting.select("id", "digest", F.posexplode("pieces").alias("pos", "piece")).where(F.col("piece.hash").isNotNull())
    once = parts.select("piece.*").groupBy("hash").agg(F.first("bytes").alias("bytes")).mapInArrow(_encode_chunks(path), "hash binary, chunk_ids binary")
    places = parts.select("digest", "pos", "piece.hash").dropDuplicates(["digest", "pos"])
    known = places.join(once, "hash").groupBy("digest").agg(F.collect_list(F.struct("pos", "chunk_ids")).alias("known"))
    texts = waiting.groupBy("digest").agg(F.first("pieces").alias("pieces")).join(known, "digest", "left").select("digest", "pieces", "known")
    assembled = texts.mapInArrow(_assemble(path, with_ids), f"digest binary, {_RESULT_DDL}")
    done = waiting.select("id", "digest").join(assembled, "digest").drop("digest").unionByName(routed.where(F.col("pieces").isNull()).drop("digest", "pieces"))
    return done.select(F.col("id").alias(id_col), *(x for x in _RESULT if with_ids or x != "ids"))


def bpe_decode(df: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids, special tokens included; null ids give null, broken UTF-8 is replaced."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if x is None else c.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return df.withColumn(into, decoded(F.col(ids_col)))


@query("op9_bpe")
def bpe(spark, sf_dir):
    """No SQL: tested against the tokenizers library on whole texts."""
    return bpe_encode(table(spark, sf_dir, "documents"), with_ids=False)
