"""Corpus preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.functions.redact import redact_pii
from cinderleaf.functions.text import passes_quality, passes_toxicity
from cinderleaf.operators.dedup import near_dedup


def prepare_corpus(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Near-duplicates removed, then quality gate, toxicity gate and redaction.

    Deduplication sees every row, also rows the gates drop later: a low-quality row still removes
    its later copies.
    """
    kept = near_dedup(docs, order, text)
    clean = kept.where(passes_quality(F.col(text)) & passes_toxicity(F.col(text)))
    return clean.withColumn(text, redact_pii(F.col(text)))


def quality_report(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Per group: documents, documents passing each gate, and characters after redaction."""
    col = F.col(text)
    judged = docs.select(
        by, passes_quality(col).alias("_q"), passes_toxicity(col).alias("_s"), F.length(redact_pii(col)).alias("_n")
    )
    good = F.col("_q") & F.col("_s")
    return judged.groupBy(by).agg(
        F.count("*").alias("docs"),
        F.count_if("_q").alias("quality_ok"),
        F.count_if("_s").alias("safe"),
        F.count_if(good).alias("kept"),
        F.sum(F.when(good, F.col("_n")).otherwise(0)).alias("kept_chars"),
    )
