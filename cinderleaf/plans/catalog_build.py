"""Catalog building from map features, and its question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.functions.place import place_defaults, place_id
from cinderleaf.operators.catalog import category_recommendations, district_recommendations, free_places
from cinderleaf.operators.generators import aggregate_pairs, disambiguation_pairs, qa_pairs
from cinderleaf.sources.readers import osm_places


def complete_places(candidates: DataFrame, order: str, done: DataFrame | None = None) -> DataFrame:
    """Rule-based records of new names; the first candidate of a name wins."""
    firsts = candidates.groupBy("name").agg(F.min(order).alias(order)).select(order)
    fresh = candidates.join(firsts, order, "left_semi")
    if done is not None:
        fresh = fresh.join(done.select("name"), "name", "left_anti")
    heights = [c for c in ("Height_m", "Length_km", "toilets", "mobile_signal") if c in fresh.columns]
    filled = place_defaults(fresh.drop(*heights))
    surfing = F.col("Surfing") if "Surfing" in fresh.columns else F.lit("no")
    return filled.withColumns(
        {
            "id": place_id(F.col("name")),
            "district_id": F.col("district"),
            "province_id": F.col("province"),
            "category_id": F.col("category"),
            "family_friendly": F.lit("yes"),
            "Surfing": F.coalesce(surfing, F.lit("no")),
        }
    )


def build_catalog(
    nodes: DataFrame, ways: DataFrame, done: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Map nodes and ways to complete place records; `done` holds records of earlier runs."""
    found = osm_places(nodes, ways, limit).withColumn("_ord", F.struct("kind", "id"))
    return complete_places(found.drop("kind", "id"), "_ord", done).drop("_ord")


def training_pairs(places: DataFrame, order: str, assistant: str = "Assistant") -> DataFrame:
    """Place questions and group questions under one `lang` column ('agg' for groups)."""
    pairs = qa_pairs(places, [order]).select("lang", "instruction", "input", "output")
    groups = aggregate_pairs(
        district_recommendations(places, order),
        category_recommendations(places, order),
        free_places(places, order),
        assistant,
    )
    return pairs.unionByName(
        groups.select(F.lit("agg").alias("lang"), "instruction", "input", "output")
    )


def note_pairs(places: DataFrame, order: str) -> DataFrame:
    """Disambiguation questions of the catalog."""
    return disambiguation_pairs(places, [order]).select("instruction", "input", "output")
