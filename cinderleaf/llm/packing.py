"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs `linear * n + quadratic * n * n`, the work of the feed-forward layers and of
attention within the piece. Long documents fill whole sequences; what remains of them and the short
documents are dealt out in descending length, each to the sequence of least cost so far that has room
for it, and cut over the cheapest sequences with room where none can take it whole. The sequences of a
deal hold exactly its tokens: as many of full length as fit, then lengths that are powers of two, so
nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import whole
from cinderleaf.llm.tokens import SLICE, encoder

CAPACITY = 1024
# Pieces dealt out together: bounds the memory of a task and the search for room.
DEAL = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, sequence_cost double"
)


def room_for(total: int, capacity: int) -> np.ndarray:
    """Lengths of the sequences that hold exactly `total` tokens: full ones, then powers of two."""
    rest = total % capacity
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * (total // capacity) + powers, dtype=np.int64)


def deal(
    lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """((piece, start in it, length, sequence, offset) ..., sequence lengths, sequence costs)."""
    sizes = room_for(int(lengths.sum()), capacity)
    room, cost = sizes.copy(), np.zeros(len(sizes))
    placed = []
    for i in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[i])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:  # nowhere whole: fill the cheapest with room
                at = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[at]))
            placed.append((int(i), start, n, at, int(sizes[at] - room[at])))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return placed, sizes, cost


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    spaced: bool = True,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document in sequences of at most `capacity` tokens; each id lies in one piece.

    A document is the ids of its whole text (null: empty) and `end_id`. Returns doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, sequence_length, sequence_cost and, on request, `ids`.
    Rows that repeat an id are documents of their own; a null id stays null; an empty table gives no
    pieces. Other columns are not read. Every task packs its own rows, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []

        def told(pieces: list[tuple]) -> pa.RecordBatch:
            # (doc_id, start, ids, doc_tokens, sequence, offset, sequence length, sequence cost)
            ids = [p[2] for p in pieces]
            columns = [
                pa.array([p[0] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                *(pa.array([p[c] for p in pieces], pa.int64()) for c in (3, 4, 5, 6)),
                pa.array([p[7] for p in pieces], pa.float64()),
            ]
            names = [c.split()[0] for c in PIECE.split(", ")]
            if with_ids:
                columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def dealt() -> pa.RecordBatch:
            nonlocal count
            placed, sizes, cost = deal(
                np.array([len(w[2]) for w in waiting], dtype=np.int64), capacity, linear, quadratic
            )
            out = []
            for i, start, n, at, offset in placed:
                doc, first, ids, total = waiting[i]
                part = ids[start : start + n]
                out.append((doc, first + start, part, total, base + count + at, offset, sizes[at], cost[at]))
            count += len(sizes)
            waiting.clear()
            return told(out)

        full_cost = linear * capacity + quadratic * capacity * capacity
        end = np.array([end_id], "<u4")
        for batch in batches:
            for a, b in wordhash.slices(batch.column(1), SLICE):
                full = []
                found, first = encoder(tokenizer, spaced).encode_array(batch.column(1).slice(a, b - a))
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    ids = np.append(found[first[k] : first[k + 1]], end)
                    whole_ones = len(ids) // capacity * capacity
                    for start in range(0, whole_ones, capacity):
                        part = ids[start : start + capacity]
                        full.append((doc, start, part, len(ids), base + count, 0, capacity, full_cost))
                        count += 1
                    if whole_ones < len(ids):
                        waiting.append((doc, whole_ones, ids[whole_ones:].copy(), len(ids)))
                    if len(waiting) >= DEAL:
                        yield dealt()
                if full:
                    yield told(full)
        if waiting:
            yield dealt()
        encoder(tokenizer, spaced).rest()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(run, PIECE + ", ids array<long>" * with_ids)
