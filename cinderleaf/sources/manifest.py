"""File digests checked against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.operators.catalog import upsert_rows


def digests(files: DataFrame, filename: str = "filename", content: str = "content") -> DataFrame:
    """(filename, sha256) of every file."""
    return files.select(F.col(filename).alias("filename"), F.sha2(F.col(content), 256).alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, status): ok, mismatch, registered for a new file, missing for an absent one."""
    now = digests(files).withColumnRenamed("sha256", "_now")
    joined = now.join(manifest.select("filename", "sha256"), "filename", "full")
    status = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("sha256").isNull(), "registered")
        .when(F.col("_now") == F.col("sha256"), "ok")
        .otherwise("mismatch")
    )
    return joined.select("filename", status.alias("status"))


def update_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest with the digests of the given files."""
    return upsert_rows(manifest, digests(files), "filename")
