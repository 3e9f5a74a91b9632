"""Document index: build, list, delete and query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.functions.food import knowledge_text
from cinderleaf.functions.place import field, place_document
from cinderleaf.operators.catalog import upsert_rows
from cinderleaf.operators.retrieval import context_prompt, vector_topk
from cinderleaf.session import fixed_table


def place_rows(places: DataFrame) -> DataFrame:
    """(id, content, metadata) rows of places, ready to be joined with their embeddings."""
    meta = F.create_map(
        F.lit("id"), field(places, ["id"], "Unknown"),
        F.lit("name"), field(places, ["name"], "Unknown"),
        F.lit("category"), field(places, ["category_id", "category"], "Place"),
    )
    return places.select("id", place_document(places).alias("content"), meta.alias("metadata"))


def index_documents(index: DataFrame, rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index with new rows added or replaced by id; `vectors(id, embedding)` are supplied."""
    return upsert_rows(index, rows.join(vectors, "id"), "id")


def answer_prompts(
    queries: DataFrame, index: DataFrame, k: int = 2, fallback: str = "", joiner: str = "\n"
) -> DataFrame:
    """Queries with the context of their best `k` rows; expects query_id, question, embedding."""
    hits = vector_topk(queries, index, k, doc_id="id")
    return context_prompt(
        queries, "query_id", "question", hits, index, "id", "content", fallback, joiner
    )


def food_knowledge(spark) -> DataFrame:
    """The fixed knowledge rows; their embeddings are an input."""
    return fixed_table(
        spark,
        food.FOOD_KNOWLEDGE,
        "id string, name string, content string, calories int, type string, spiciness string",
    )


def dish_context(queries: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(query_id, context): knowledge sentence of the nearest row, the fixed sentence when none."""
    hits = vector_topk(queries, knowledge, 1, doc_id="id")
    found = hits.join(knowledge, hits["doc_id"] == knowledge["id"]).select(
        "query_id", "content", "type", "spiciness"
    )
    joined = queries.select("query_id").join(found, "query_id", "left")
    text = knowledge_text(F.col("content"), F.col("type"), F.col("spiciness"))
    return joined.select("query_id", text.alias("context"))
