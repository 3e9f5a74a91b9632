"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs without ASCII white space, A-Z in lower case unless asked for as they are. A word's hash
is a polynomial over its bytes modulo 2**64 read off a running sum, then mixed; equal words have equal
hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cinderleaf.llm.common import per_worker

SHINGLE = 5
# Bytes of text that are hashed together; a longer text is a slice of its own.
SLICE = 2 << 20
# Odd multipliers: of the polynomial, of the places in a shingle, of the mixing steps.
BASE = 0x9E3779B97F4A7C15
PLACES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(PLACES[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(PLACES[1])
    x ^= x >> np.uint64(31)
    return x


def _tables() -> dict:
    code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    folded = code.copy()
    folded[65:91] = code[97:123]  # A-Z as a-z
    return {"exact": code, "code": folded, "white": white, "powers": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _powers(tables: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64 for i below n."""
    if len(tables["powers"]) < n:
        for name, factor in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            steps = np.full(n + n // 4, factor, np.uint64)
            steps[0] = 1
            tables[name] = np.multiply.accumulate(steps)
    return tables["powers"], tables["inverse"]


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each."""
    sizes = np.diff(np.asarray(texts.cast(pa.large_binary()).buffers()[1]).view(np.int64)[: len(texts) + 1])
    start, n = 0, 0
    for i, size in enumerate(sizes):
        if n and n + size > most:
            yield start, i
            start, n = i, 0
        n += int(size)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each). Nulls must have been replaced."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of every word; a word never crosses the end of a text."""
    tables = per_worker("wordhash", _tables)
    inside = ~tables["white"][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])[: len(data)]
    after = np.concatenate([inside[1:], [False]])[: len(data)]
    starts = np.flatnonzero(inside & (~before | edge[: len(data)]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, folded: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text, start and stop byte of every word)."""
    tables = per_worker("wordhash", _tables)
    starts, stops = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, stops
    powers, inverse = _powers(tables, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tables["code" if folded else "exact"][data] * powers[: len(data)], out=sums[1:])
    found = (sums[stops] - sums[starts]) * inverse[starts]
    return mix(found + (stops - starts).astype(np.uint64) * np.uint64(PLACES[2])), first, starts, stops


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, first of every text); sorted within a text.

    A shingle is five words, all words of a shorter text, and nothing for a text without words.
    """
    words, first, _, _ = word_hashes(data, offsets)
    counts = np.diff(first)
    docs = np.repeat(np.arange(len(counts)), counts)
    runs = max(0, len(words) - SHINGLE + 1)
    mixed = np.zeros(runs, np.uint64)
    for k, place in enumerate(PLACES):
        mixed += words[k : k + runs] * np.uint64(place)
    whole = docs[:runs] == docs[SHINGLE - 1 :] if runs else np.zeros(0, bool)
    hashes, owners = mix(mixed[whole]), docs[:runs][whole]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        few = []
        for d in short:
            own = words[first[d] : first[d + 1]]
            places = np.array(PLACES[: len(own)], np.uint64)
            few.append((int((own * places).sum()) + len(own)) & MASK)
        hashes = np.concatenate([hashes, mix(np.array(few, np.uint64))])
        owners = np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(counts) + 1))


def spell(
    data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts made of the words data[starts:stops], joined by one space.

    `first` bounds the words of every text; a text without words is empty.
    """
    sizes = stops - starts + 1  # with the space after the word
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    places = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
    spaces = ends - 1
    places[spaces] = 0
    out = data[places] if total else np.zeros(0, np.uint8)
    out[spaces] = 32
    bounds = np.concatenate([[0], ends])[first]
    some = np.diff(first) > 0
    last = np.ones(total, bool)
    last[bounds[1:][some] - 1] = False  # no space after a text's last word
    return out[last], bounds - np.concatenate([[0], np.cumsum(some)])


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of `spell` as an Arrow array."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())
    ).cast(pa.string())
