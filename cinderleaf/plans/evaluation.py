"""Scoring of prediction tables and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.functions.scores import cosine, overlap_scores
from cinderleaf.operators.aggregates import score_answers, text_metric_summary
from cinderleaf.operators.audit import keep_last_n


def score_predictions(
    predictions: DataFrame, reference: str = "reference", generated: str = "generated",
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Adds bleu, rouge_l and similarity; rows without a reference score 0."""
    known = F.coalesce(F.col(reference) != "", F.lit(False))
    scored = predictions.withColumn("_o", overlap_scores(F.col(reference), F.col(generated)))
    similarity = F.lit(0.0)
    if vectors:
        similarity = F.coalesce(cosine(F.col(vectors[0]), F.col(vectors[1])), F.lit(0.0))
    return scored.withColumns(
        {
            "bleu": F.when(known, F.col("_o.bleu")).otherwise(0.0),
            "rouge_l": F.when(known, F.col("_o.rouge_l")).otherwise(0.0),
            "similarity": F.when(known, similarity).otherwise(0.0),
        }
    ).drop("_o")


def evaluate_predictions(predictions: DataFrame, by: list[str] | None = None, **columns) -> DataFrame:
    """Summary of the scores, overall or per group."""
    return text_metric_summary(score_predictions(predictions, **columns), by)


STATES = ("bleu", "rouge_l", "similarity")


def run_states(predictions: DataFrame, answers: DataFrame, run: str, **columns) -> DataFrame:
    """One mergeable row a run: sums and counts of the text scores, hits and answers of every benchmark.

    `answers` are what `score_answers` expects, with the same `run` column. States of parts of a run add up.
    """
    scored = score_predictions(predictions, **columns)
    texts = scored.groupBy(run).agg(*[F.sum(c).alias(f"{c}_sum") for c in STATES], F.count("*").alias("texts"))
    hits = score_answers(answers).where(F.col("hit").isNotNull()).groupBy(run, "benchmark")
    hits = hits.agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    listed = F.map_from_entries(F.collect_list(F.struct("benchmark", F.struct("hits", "n"))))
    return texts.join(hits.groupBy(run).agg(listed.alias("benchmarks")), run, "full")


def merge_states(states: DataFrame, run: str) -> DataFrame:
    """The states of equal runs added up."""
    sums = [F.coalesce(F.sum(f"{c}_sum"), F.lit(0.0)).alias(f"{c}_sum") for c in STATES]
    texts = states.groupBy(run).agg(*sums, F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"))
    each = states.select(run, F.explode("benchmarks").alias("benchmark", "s"))
    each = each.groupBy(run, "benchmark").agg(F.sum("s.hits").alias("hits"), F.sum("s.n").alias("n"))
    listed = F.map_from_entries(F.collect_list(F.struct("benchmark", F.struct("hits", "n"))))
    return texts.join(each.groupBy(run).agg(listed.alias("benchmarks")), run, "left")


def add_run(history: DataFrame, run: DataFrame, order: str, keep: int = 10) -> DataFrame:
    """Run history with the new run, cut to the newest `keep`."""
    return keep_last_n(history.unionByName(run, allowMissingColumns=True), keep, [order])


def add_states(history: DataFrame, states: DataFrame, run: str, keep: int = 10) -> DataFrame:
    """The history with new states, parts of a run added up, compacted to the newest `keep` runs."""
    return keep_last_n(merge_states(history.unionByName(states), run), keep, [run])


def history_report(history: DataFrame, run: str) -> DataFrame:
    """Per run: mean text scores to four places, count, and whether a safety benchmark failed."""
    means = [F.coalesce(F.round(F.try_divide(f"{c}_sum", "texts"), 4), F.lit(0.0)).alias(n) for c, n in zip(STATES, ("avg_bleu", "avg_rouge", "avg_similarity"))]
    targets = F.create_map(*[F.lit(x) for row in food.BENCHMARK_TARGETS for x in row])
    reports = F.transform(
        F.map_entries("benchmarks"),
        lambda e: F.struct(e["key"].alias("name"), (e["value"]["hits"] / e["value"]["n"]).alias("score"), targets[e["key"]].alias("target")),
    )

    def failed(e):
        passed = F.when(e["name"] == "toxigen", e["score"] <= e["target"]).otherwise(e["score"] >= e["target"])
        return e["name"].isin(food.SAFETY_BENCHMARKS) & ~passed

    rows = history.withColumn("_r", reports)
    scores = F.map_from_entries(F.transform("_r", lambda e: F.struct(e["name"], F.round(e["score"], 4))))
    triggered = F.coalesce(F.exists("_r", failed), F.lit(False)).alias("triggered")
    return rows.select(run, *means, F.col("texts").alias("count"), scores.alias("benchmarks"), triggered)
