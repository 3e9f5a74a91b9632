"""Upper bounds of the similarity of many pairs of texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Counters that characters are hashed into, and cells of a table held at a time.
SLOTS, CELLS = 64, 1 << 22


def _points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, first one of each text)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def common_characters(left: Sequence[str], right: Sequence[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least the characters, in any order, that left[a] and right[b] share."""

    def counts(texts: Sequence[str]) -> np.ndarray:
        points, first = _points(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        return np.bincount(owner * SLOTS + points % SLOTS, minlength=len(texts) * SLOTS).reshape(-1, SLOTS)

    own, other = counts(left), counts(right)
    out = np.zeros(len(a), np.int64)
    step = CELLS // SLOTS
    for i in range(0, len(a), step):
        out[i : i + step] = np.minimum(own[a[i : i + step]], other[b[i : i + step]]).sum(axis=1)
    return out


def common_subsequences(left: Sequence[str], right: Sequence[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of left[a] and right[b].

    A row of the usual table is a word of bits per 64 characters of the left text (Hyyro 2004); the rows of
    many pairs are worked out side by side.
    """
    out = np.zeros(len(a), np.int64)
    points, first = _points(left)
    others, other_first = _points(right)
    alphabet, points = np.unique(points, return_inverse=True)
    width = len(alphabet) + 1  # the last one stands for characters that no left text has
    place = np.minimum(np.searchsorted(alphabet, others), max(len(alphabet) - 1, 0))
    symbols = np.where(alphabet[place] == others, place, width - 1) if len(alphabet) else np.zeros(len(others), np.int64)
    length, other_length = np.diff(first), np.diff(other_first)
    order = np.lexsort((a, other_length[b], length[a]))
    begin = 0
    while begin < len(order):
        # pairs are ordered by the left length, so the last one is the longest
        end, kinds, longest = begin, set(), 0
        while end < len(order):
            i = order[end]
            kinds.add(a[i])
            longest = max(longest, other_length[b[i]])
            words = -(-length[a[i]] // 64)
            if end > begin and (len(kinds) * width * words > CELLS or (end - begin + 1) * max(longest, words) > CELLS):
                break
            end += 1
        some = order[begin:end]
        begin = end
        some = some[np.argsort(-other_length[b[some]], kind="stable")]
        words = -(-int(length[a[some]].max()) // 64)
        texts, row = np.unique(a[some], return_inverse=True)
        # masks[word, text, symbol]: where a text has the symbol
        masks = np.zeros((words, len(texts) * width), np.uint64)
        for j, t in enumerate(texts):
            at = np.arange(length[t])
            np.bitwise_or.at(
                masks, (at >> 6, j * width + points[first[t] : first[t + 1]]), np.uint64(1) << (at & 63).astype(np.uint64)
            )
        sizes = other_length[b[some]]
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))))  # pairs with a character at a place
        state = np.full((words, len(some)), ~np.uint64(0))
        base, start = row * width, other_first[b[some]]
        for t, n in enumerate(live):
            at = base[:n] + symbols[start[:n] + t]
            carry = np.zeros(n, np.uint64)
            for w in range(words):
                mask, now = masks[w].take(at), state[w, :n]
                added = now + (now & mask)
                over = added < now
                added += carry
                over |= added < carry
                state[w, :n] = added | (now & ~mask)
                carry = over.astype(np.uint64)
        out[some] = words * 64 - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return out
