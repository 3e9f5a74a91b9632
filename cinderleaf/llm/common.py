"""Shared pieces of the training-data operators: tables, row keys and joins that survive a hot key."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Sequence
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows; so at most this many keys are hot.
HOT_KEYS = 1024
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str | Column) -> Column:
    """The text, the empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, name: str = "key") -> str:
    """A column name that `df` has not, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, groups: DataFrame, key: Sequence[str], weight: str, total: int) -> DataFrame:
    """`rows` joined with the one row of `groups` of their key; no key's rows meet in one task.

    `weight` is the number of rows of a group among `total`. Groups above total / HOT_KEYS, of which
    there are fewer than HOT_KEYS whatever the size of the input, are broadcast; the others take the
    shuffle join, where none can fill a partition. Rows without a group are dropped.
    """
    hot = groups.where(F.col(weight) * HOT_KEYS > total)
    names = list(key)
    mild = rows.join(F.broadcast(hot.select(*names)), names, "left_anti")
    return rows.join(F.broadcast(hot), names).unionByName(
        mild.join(groups.where(F.col(weight) * HOT_KEYS <= total), names)
    )


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` returned when a Python worker first asked for `key`; kept from task to task.

    Functions travel by value and bring fresh globals with every task, so it lives in a module entry.
    """
    store = sys.modules.setdefault("_cinderleaf_worker", ModuleType("_cinderleaf_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
