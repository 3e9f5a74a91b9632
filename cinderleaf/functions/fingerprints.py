"""Rolling fingerprints of byte pieces, for substring lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Piece lengths in bytes; a needle is found by a piece of the largest that fits.
SIZES = (1, 2, 3, 4, 6, 8, 16, 32)
# Leading bits of a fingerprint that the filter looks at, and bytes of text worked on together.
FILTER_BITS, SLICE = 21, 1 << 20
BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _steps(n: int, factor: int) -> np.ndarray:
    """factor ** i modulo 2**64 for i below n."""
    steps = np.full(n, factor, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def pieces(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of every piece of `size` bytes of many texts."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _steps(len(data), BASE), out=sums[1:])
    found = _mix((sums[size:] - sums[:n]) * _steps(n, pow(BASE, -1, 1 << 64)) + np.uint64(size))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[:n] == owner[size - 1 :]
    return owner[:n][whole], found[whole]


def _distinct(owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def fingerprints(text: Column, sizes: list[int] | None = None, passing: bytes | None = None) -> Column:
    """Distinct fingerprints (array of long) of the pieces of a text; none for null.

    With `sizes`, of all those lengths, else of the largest length in SIZES that fits. With `passing`, a bit for
    every value of the leading FILTER_BITS bits, only those whose bit is set.
    """

    def run(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        held = np.unpackbits(np.frombuffer(passing, np.uint8)).astype(bool) if passing is not None else None
        owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        a = 0
        while a < len(raw):
            b = max(a + 1, min(len(raw), int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1))
            part, offsets = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            own = np.array(SIZES)[np.maximum(np.searchsorted(SIZES, np.diff(offsets), "right") - 1, 0)]
            for size in sizes or np.unique(own):
                owner, found = pieces(part, offsets, int(size))
                if sizes is None:
                    fits = own[owner] == size
                    owner, found = owner[fits], found[fits]
                if held is not None:
                    fits = held[found >> np.uint64(64 - FILTER_BITS)]
                    owner, found = owner[fits], found[fits]
                owner, found = _distinct(owner, found)
                owners.append(owner + a)
                keys.append(found)
            a = b
        owner, key = np.concatenate(owners), np.concatenate(keys)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(raw) + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key[order].view(np.int64)))

    return F.arrow_udf(run, "array<bigint>")(text)


def size_of(text: Column) -> Column:
    """The piece length of a needle."""
    out = F.lit(SIZES[0])
    for size in SIZES[1:]:
        out = F.when(F.octet_length(text) >= size, size).otherwise(out)
    return out


def filter_bits(leading: list[int]) -> bytes:
    """The filter in which the leading bits of all needles' fingerprints are set."""
    held = np.zeros(1 << FILTER_BITS, bool)
    held[leading] = True
    return np.packbits(held).tobytes()
