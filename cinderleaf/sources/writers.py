"""Writers: JSON lines, the catalog CSV and appended pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import place_rules as rules
from cinderleaf.operators.generators import chat


def with_messages(pairs: DataFrame) -> DataFrame:
    """Adds the two-turn message array of instruction and output."""
    return pairs.withColumn(
        "messages", chat(("user", F.col("instruction")), ("assistant", F.col("output")))
    )


def write_jsonl(pairs: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Training pairs with their messages, optionally in one folder per value of `by`."""
    rows = with_messages(pairs) if "instruction" in pairs.columns else pairs
    writer = rows.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def catalog_rows(places: DataFrame) -> DataFrame:
    """All catalog columns in their fixed order, missing ones and nulls empty."""
    present = set(places.columns)
    return places.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in present else F.lit("").alias(c)
            for c in rules.CATALOG_COLUMNS
        ]
    )


def write_catalog_csv(places: DataFrame, path: str) -> None:
    catalog_rows(places).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_records(records: DataFrame, path: str) -> None:
    """Adds preference pairs or chat records to a JSON table."""
    records.write.mode("append").json(path)
