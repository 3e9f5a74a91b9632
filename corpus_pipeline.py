"""From raw documents to packed training sequences, in five stages.

Every stage reads what its predecessor kept, as Parquet, and its decisions take effect: documents
without a language go, then all but one of every exact and every near copy, then documents
that hold benchmark items; the rest is packed into sequences. All stages but the last return the columns
of documents.

In every stage a null text counts as empty and a null id as an id of its own: null and empty texts have no
language and go in the first stage; rows that repeat id and text become one in the second; ties are decided
for the smallest id. Extra columns of any name pass all stages but the last unchanged, and an empty table
gives an empty one. SQL can express neither the language model nor the tokenizer, so there is no SQL for the
whole; tests hold it against plain restatements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderleaf.llm import bitpack, crf_language, decontaminate, exact_dedup, near_dedup, packing
from cinderleaf.llm.common import table
from cinderleaf.llm.tokens import public_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whose words the model finds to be of a language that labels name; the others go."""
    return crf_language.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dedup.drop_near(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens; an empty document is its end id."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", clean),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = bitpack.scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
