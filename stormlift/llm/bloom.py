"""A set filter of bounded size: what it denies is not in the set, what it admits must be checked by a join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits for each key, least and most bits of a filter (32 MB: it is sent to every task), probes of a key.
EACH, LEAST, MOST, PROBES = 12, 20, 28, 4
#: Bytes of the pieces in which filters are put together.
PIECE = 1 << 16


def _probe(keys: np.ndarray, k: int, size: int) -> np.ndarray:
    """Bit numbers of 64-bit keys for probe ``k`` of a filter of 2^size bits."""
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed * np.uint64(2 * k + 1) + np.uint64(k) * (keys >> np.uint64(7))) >> np.uint64(64 - size)).astype(np.int64)


def as_numbers(keys: Sequence[bytes] | np.ndarray) -> np.ndarray:
    """64 bits of each key: of byte strings the first eight."""
    if isinstance(keys, np.ndarray):
        return keys.astype(np.uint64, copy=False)
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of equal number or-ed."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            bits = np.frombuffer(raw, np.uint8)
            held[piece] = held[piece] | bits if piece in held else bits
    for piece, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["piece", "bits"])


class Bloom:
    """A filter of 2^size bits. Beyond MOST bits / EACH keys it admits more than it should, which costs time, not results."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.size = (len(bits) * 8).bit_length() - 1

    def holds(self, keys: Sequence[bytes] | np.ndarray) -> np.ndarray:
        keys = as_numbers(keys)
        left = np.arange(len(keys))
        for k in range(PROBES):  # most keys fail the first probe
            at = _probe(keys[left], k, self.size)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    @staticmethod
    def of(df: DataFrame, column: str) -> Bloom:
        """The filter of a binary or long column, sized by the number of rows; ``df`` should be a written table.

        Every task marks its keys and hands on the pieces that hold a mark; pieces are or-ed where their
        number deals them to, so that as many bytes as the filter has reach the driver.
        """
        keys = df.select(column).dropna()
        size = min(MOST, max(LEAST, (EACH * keys.count()).bit_length()))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << size - 3, np.uint8)
            for batch in batches:
                keys = batch.column(0)
                keys = keys.to_pylist() if pa.types.is_binary(keys.type) else keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for k in range(PROBES):
                    at = _probe(as_numbers(keys), k, size)
                    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            for n in range(0, len(bits), PIECE):
                piece = bits[n : n + PIECE]
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([n // PIECE], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["piece", "bits"])

        kinds = "piece int, bits binary"
        bits = np.zeros(1 << size - 3, np.uint8)
        for row in keys.mapInArrow(build, kinds).repartition("piece").mapInArrow(_union, kinds).collect():
            bits[row["piece"] * PIECE : row["piece"] * PIECE + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
        return Bloom(bits)
