"""Mixtures, shuffles, previews and unions of training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderleaf.functions.text import md5_fraction, strip
from cinderleaf.operators.ordered import dense_index
from cinderleaf.session import checkpoint


def blend(spark: SparkSession, configs: list[tuple[str, str, float, str]], n: int, seed: int = 42) -> DataFrame:
    """(pos, source, modality, path): `n` draws of (name, path, weight, modality) by weight.

    Every position is drawn on its own from its number and the seed, so the work splits freely.
    """
    total = sum(weight for _, _, weight, _ in configs)
    draws = spark.range(n).select(F.col("id").alias("pos"), md5_fraction(seed, F.col("id")).alias("_u"))
    chosen, reached = None, 0.0
    for place, (name, path, weight, modality) in enumerate(configs):
        reached += weight / total
        value = F.struct(
            F.lit(name).alias("source"), F.lit(modality).alias("modality"), F.lit(path).alias("path")
        )
        if place == len(configs) - 1:
            chosen = value if chosen is None else chosen.otherwise(value)
        elif chosen is None:
            chosen = F.when(F.col("_u") < reached, value)
        else:
            chosen = chosen.when(F.col("_u") < reached, value)
    return draws.select("pos", chosen.alias("_c")).select("pos", "_c.*")


def blend_rows(
    spark: SparkSession,
    configs: list[tuple[str, str, float, str]],
    sources: dict[str, DataFrame],
    order: str,
    n: int,
    seed: int = 42,
) -> DataFrame:
    """The draws of `blend` with a row each: the i-th draw of a source gets its i-th row by `order`.

    A source that is drawn more often than it has rows starts over; one without rows gives none.
    """
    draws = checkpoint(dense_index(blend(spark, configs, n, seed), ["source", "pos"], "_i"))
    firsts = draws.groupBy("source").agg(F.min("_i").alias("_first"))  # one row per source
    placed = draws.join(F.broadcast(firsts), "source").withColumn("_at", F.col("_i") - F.col("_first"))
    out = None
    for name, rows in sources.items():
        numbered = dense_index(rows, [order], "_row")
        size = numbered.agg(F.count("*").alias("_size")).where("_size > 0")
        own = placed.where(F.col("source") == name).join(F.broadcast(size.withColumn("source", F.lit(name))), "source")
        own = own.withColumn("_row", F.col("_at") % F.col("_size"))
        joined = own.select("pos", "source", "modality", "path", "_row").join(numbered, "_row").drop("_row")
        out = joined if out is None else out.unionByName(joined, allowMissingColumns=True)
    return out


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order fixed by the key and the seed."""
    return df.withColumn("_u", md5_fraction(seed, F.col(key).cast("string"))).orderBy("_u", key).drop("_u")


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First `n` rows in order."""
    return df.orderBy(*order).limit(n)


def union_training_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """All sets under one `lang` column; missing columns become null."""
    out = None
    for lang, df in sets.items():
        tagged = df.withColumn("lang", F.lit(lang))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def ingest_text(df: DataFrame, max_samples: int, order: list[str], text: str = "text") -> DataFrame:
    """First `max_samples` rows with non-blank text, trimmed."""
    clean = df.withColumn(text, strip(F.col(text))).where(F.col(text) != "")
    return clean.orderBy(*order).limit(max_samples)


def resume(todo: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name has no usable earlier result."""
    return todo.join(usable_results(done, name).select(name), name, "left_anti")


def usable_results(done: DataFrame, name: str = "name") -> DataFrame:
    """Earlier rows with a name, a real description, an id and opening hours."""
    described = F.lower(strip(F.coalesce("description", F.lit(""))))
    good = (
        (F.coalesce(F.col(name), F.lit("")) != "")
        & (described != "no")
        & (F.length(described) > 10)
        & F.col("id").isNotNull()
        & F.col("opening_hours").isNotNull()
    )
    return done.where(good)
