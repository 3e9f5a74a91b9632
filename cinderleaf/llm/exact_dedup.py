"""Exact duplicates by a tree merge of sorted digest runs.

Every scan partition is a run. The digest space is cut into `fan ** rounds` cells. In round r a run
exchanges slices with the `fan - 1` runs whose number differs from its own in digit r only, so that
afterwards digit r of a run's number equals digit r of all its digests; each receiver merges the
sorted slices and keeps one entry per text: smallest id, number of rows. After the last round a cell
holds every entry of its digests and nothing else, and no task ever held more than a cell. Copies
collapse before the first exchange and again at every level, so a text that fills a third of the
table costs one entry per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.llm.common import WHITE, attach, free_name, shuffle_partitions, whole
from cinderleaf.session import checkpoint

FAN = 4
# Stands for a missing id while runs are merged: it sorts after every id.
NO_ID = 2**63 - 1
ENTRY = "cell long, digest binary, width int, check long, keep_id long, group_size long"
ORDER = ["cell", "digest", "width", "check", "keep_id"]


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, width, check): SHA-256, length and a second hash of the normalised text.

    The entries of two texts merge only where all three agree.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.regexp_replace(whole(text), WHITE, " ").alias("plain")
    )
    return plain.select(
        "id",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.length("plain").alias("width"),
        F.xxhash64("plain").alias("check"),
    )


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds adjacent entries of one text in a sorted run; the last entry waits for the next batch."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = pa.table(batch.columns, names=batch.schema.names)  # without the nullability of the plan
        if waiting is not None:
            joined = pa.concat_tables([waiting, joined])
        joined = joined.combine_chunks()
        column = {name: joined.column(name).combine_chunks() for name in joined.column_names}
        numbers = {n: column[n].to_numpy() for n in ("cell", "width", "check", "keep_id", "group_size")}
        raw = np.frombuffer(b"".join(column["digest"].to_pylist()), dtype="<u8").reshape(-1, 4)
        new = np.ones(len(raw), bool)
        new[1:] = (raw[1:] != raw[:-1]).any(axis=1)
        for name in ("cell", "width", "check"):
            new[1:] |= numbers[name][1:] != numbers[name][:-1]
        first = np.flatnonzero(new)
        merged = joined.take(pa.array(first))
        sizes = np.add.reduceat(numbers["group_size"], first)
        least = np.minimum.reduceat(numbers["keep_id"], first)
        merged = merged.set_column(4, "keep_id", pa.array(least)).set_column(5, "group_size", pa.array(sizes))
        waiting = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if waiting is not None:
        yield from waiting.to_batches()


def merge_tree(tagged: DataFrame, fan: int = FAN) -> DataFrame:
    """(digest, width, check, keep_id, group_size): one row per text of `digests` rows."""
    parts = shuffle_partitions(tagged.sparkSession)
    rounds = 1
    while fan**rounds < parts:
        rounds += 1
    cells = fan**rounds
    leading = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    runs = (
        tagged.withColumn("cell", F.spark_partition_id().cast("long") % cells)
        .groupBy("cell", "digest", "width", "check")
        .agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("keep_id"), F.count("*").alias("group_size"))
    )
    for r in range(rounds):
        step = fan**r
        digit = (F.col("cell") / step).cast("long") % fan
        wanted = (leading / step).cast("long") % fan
        moved = runs.withColumn("cell", F.col("cell") + (wanted - digit) * step)
        runs = (
            moved.select("cell", "digest", "width", "check", "keep_id", "group_size")
            .repartition(cells, "cell")
            .sortWithinPartitions(*ORDER)
            .mapInArrow(merge_runs, ENTRY)
        )
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return runs.select("digest", "width", "check", keep.alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """Per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one space; a null text is
    the empty one. The smallest id stays; a null id counts as larger than any other and stays only in
    a group of null ids. Rows that repeat both id and text all carry the same verdict. An empty table
    gives an empty result. Other columns are not read.
    """
    tagged = checkpoint(digests(docs, id_col, text))
    groups = checkpoint(merge_tree(tagged, fan))
    total = tagged.count()
    named = attach(tagged, groups, ["digest", "width", "check"], "group_size", total)
    return named.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """The rows of `docs` that stay, one per text, all columns unchanged.

    Of rows that repeat both id and text one stays. A null text counts as empty, a null id as larger than any
    other. Columns of any name are allowed; an empty table gives an empty result.
    """
    tagged = checkpoint(digests(docs, id_col, text))
    digest, own = free_name(docs, "digest"), free_name(docs, "own")
    keepers = merge_tree(tagged, fan).select(
        F.hex("digest").alias(digest), F.coalesce("keep_id", F.lit(NO_ID)).alias(own)
    )
    plain = F.regexp_replace(whole(text), WHITE, " ")
    keyed = docs.withColumns(
        {digest: F.upper(F.sha2(plain, 256)), own: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))}
    )
    kept = keyed.join(keepers, [digest, own], "left_semi")
    return kept.dropDuplicates([digest, own]).select(*docs.columns)
