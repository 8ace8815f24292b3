"""Arrow and numpy helpers of the vectorised text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rotativa.functions.arrow import ragged, slices

__all__ = ["polynomial", "ragged", "slices", "utf8"]

#: Odd multiplier of the polynomial hashes, and the two of the finaliser (fixed values).
BASE, MIX_1, MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. Offsets start at 0."""
    plain = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], np.uint8) if plain.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def polynomial(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit polynomial hash of every window of ``size`` codes, by doubling (O(log size) passes)."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    count = len(codes) - size + 1
    power, h, width = BASE, (codes.astype(np.uint64) + np.uint64(1)) * MIX_1, 1
    result, done, rest = None, 0, size
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                # windows already hashed lie to the left; the next ``width`` codes follow at ``done``
                piece = h[done : done + count]
                result = piece.copy() if result is None else result * power + piece
                done += width
            rest >>= 1
            if rest:
                h = h[:-width] * power + h[width:]
                power, width = power * power, width * 2
        result ^= result >> np.uint64(29)
        result *= MIX_2
        result ^= result >> np.uint64(32)
    return result
