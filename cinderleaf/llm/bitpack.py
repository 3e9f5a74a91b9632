"""Token ids in fixed-width bits, with block offsets for random access.

A shard is one binary value, little-endian throughout:

    magic 4s | width u8 | pad 3s | block u32 | docs u32 | ids u64 | payload offset u64
    doc starts   u64[docs + 1]    first id of every document within the shard
    block offsets u64[blocks + 1] first payload byte of every block
    payload                       `block` ids a block, `width` bits an id, lowest bit first

`width` is the smallest number of bits that holds every id of the vocabulary. Blocks start on a byte,
so any id is read by unpacking one block. Shards are rows of a Parquet table (part, shard, before, docs,
ids, data; `before` is the ids of its part's earlier shards): every file system that Spark writes to can hold it, and a lost task is written again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderleaf.llm import wordhash
from cinderleaf.llm.common import whole
from cinderleaf.llm.tokens import SLICE, encoder
from cinderleaf.session import ensure_checkpoint_dir

MAGIC = b"CLBP"
HEAD = "<4sB3xIIQQ"
BLOCK = 4096
# A shard is closed once it holds this many ids.
SHARD_IDS = 1 << 20
STORED = "part long, shard long, before long, doc_ids array<long>, ids long, data binary"


def bits_needed(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """The ids as one run of `width`-bit fields, padded to a whole byte."""
    fields = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(fields[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    """The first `n` ids of a run of `width`-bit fields."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{width // 8}", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_shard(documents: Sequence[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    """The documents' ids as one shard."""
    starts = np.zeros(len(documents) + 1, "<u8")
    starts[1:] = np.cumsum([len(d) for d in documents])
    ids = np.concatenate([*documents, np.zeros(0, "<u4")])
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    payload = [pack_bits(ids[at : at + block], width) for at in range(0, len(ids), block)]
    offsets = np.zeros(len(payload) + 1, "<u8")
    offsets[1:] = np.cumsum([len(p) for p in payload])
    at = struct.calcsize(HEAD) + starts.nbytes + offsets.nbytes
    head = struct.pack(HEAD, MAGIC, width, block, len(documents), len(ids), at)
    return b"".join([head, starts.tobytes(), offsets.tobytes(), *payload])


class Shard:
    """Reads a shard; `ids` unpacks only the blocks it needs."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.docs, self.n, self.payload = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.data = memoryview(data)
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, struct.calcsize(HEAD)).astype(np.int64)
        blocks = -(-self.n // self.block)
        at = struct.calcsize(HEAD) + 8 * (self.docs + 1)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids `start` to `stop`, end exclusive."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError(f"{start}:{stop} of {self.n} ids")
        if start == stop:
            return np.zeros(0, "<u4")
        found = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            n = min(self.block, self.n - b * self.block)
            raw = self.data[self.payload + self.offsets[b] : self.payload + self.offsets[b + 1]]
            first = max(0, start - b * self.block)
            found.append(unpack_bits(raw, n, self.width)[first : stop - b * self.block])
        return found[0] if len(found) == 1 else np.concatenate(found)

    def document(self, i: int) -> np.ndarray:
        """The ids of document `i` of the shard."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_packed(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    vocabulary: int,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    spaced: bool = False,
) -> None:
    """Encodes every whole text, appends `end_id`, and writes shards in ascending id order to `path`.

    A null text is empty and leaves the end id alone; a null id comes after all others; rows that
    repeat an id are ordered by their text. An empty table writes no shard. Other columns are not read.
    """
    width = bits_needed(max(vocabulary, end_id + 1))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        found: list[np.ndarray] = []
        n = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([n], pa.int64()),
                    pa.array([pack_shard(found, width)], pa.binary()),
                ],
                names=["part", "shard", "before", "doc_ids", "ids", "data"],
            )

        end = np.array([end_id], "<u4")
        for batch in batches:
            for a, b in wordhash.slices(batch.column(1), SLICE):
                all_ids, first = encoder(tokenizer, spaced).encode_array(batch.column(1).slice(a, b - a))
                for k, name in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    ids = np.append(all_ids[first[k] : first[k + 1]], end)
                    names.append(name)
                    found.append(ids)
                    n += len(ids)
                    if n >= SHARD_IDS:
                        yield closed()
                        names, found, n, number, before = [], [], 0, number + 1, before + n
        if found:
            yield closed()
        encoder(tokenizer, spaced).rest()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(
        F.col("id").asc_nulls_last(), "text"
    )
    ordered.mapInArrow(shards, STORED).write.mode("overwrite").parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, first): ids in all parts before. Parts are tasks of the writing job, a row each."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("ids").alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))


def read_packed(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The stored documents: doc_id, start, n_tokens, ids_crc32, and `ids` unless switched off.

    A document without words has its end id alone; null and repeated ids come back as they were written, in
    the order of writing; a table without shards gives an empty result.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["data"])
                every = shard.ids(0, shard.n)
                cut = [every[a:b] for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(shard.starts[:-1] + row["start"]),
                    "n_tokens": pa.array(np.diff(shard.starts)),
                    "ids_crc32": pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    # as many rows as the writing job had tasks, so the shards themselves are not moved
    stored = spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part")
    stored = stored.withColumn("start", F.col("first") + F.col("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return stored.select("doc_ids", "start", "data").mapInArrow(documents, schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
