"""Profiles, diagnostics, nutrition totals and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.functions import scores
from cinderleaf.functions.text import strip, word_count
from cinderleaf.operators.audit import keep_last_n
from cinderleaf.operators.generators import csv_to_sft
from cinderleaf.operators.lookup import prompt_category, resolve_foods
from cinderleaf.session import checkpoint

SINHALA = r"[඀-෿]"
SHOWN_WARNINGS = 50


def _csv_measures(rows: DataFrame, instruction: str, response: str, extra: str | None) -> DataFrame:
    """Adds the text measures of each instruction row."""
    ask, answer = strip(F.col(instruction)), strip(F.col(response))
    more = strip(F.col(extra)) if extra else F.lit("")
    user = F.when(more != "", strip(F.concat(ask, F.lit("\n"), more))).otherwise(ask)
    measured = rows.withColumns({"_ask": ask, "_answer": answer, "_user": user})
    both = F.concat(F.col("_user"), F.lit(" "), F.col("_answer"))
    return measured.withColumns(
        {
            "_user_words": word_count(F.col("_user")),
            "_answer_words": word_count(F.col("_answer")),
            "_chars": F.length(both),
            "_sinhala": F.regexp_count(both, F.lit(SINHALA)),
        }
    )


def csv_profile(rows: DataFrame, instruction: str, response: str, extra: str | None = None) -> DataFrame:
    """One row: totals, empty fields, short texts, word statistics, Sinhala share and status."""
    m = _csv_measures(rows, instruction, response, extra)
    words = F.col("_user_words") + F.col("_answer_words")
    agg = m.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("_ask") == "").alias("empty_instructions"),
        F.count_if(F.col("_answer") == "").alias("empty_responses"),
        (
            F.count_if(F.col("_user_words").between(1, 2))
            + F.count_if(F.col("_answer_words").between(1, 2))
        ).alias("short_warnings"),
        F.coalesce(F.sum(words), F.lit(0)).alias("_words"),
        F.coalesce(F.round(F.avg(words), 1), F.lit(0.0)).alias("avg_words"),
        F.coalesce(F.min(words), F.lit(0)).alias("min_words"),
        F.coalesce(F.max(words), F.lit(0)).alias("max_words"),
        F.sum("_chars").alias("_chars"),
        F.sum("_sinhala").alias("_sinhala"),
    )
    empty = F.col("empty_instructions") + F.col("empty_responses")
    share = F.when(F.col("_chars") > 0, F.round(F.col("_sinhala") / F.col("_chars") * 100, 1)).otherwise(0.0)
    status = F.when(empty > 0, "invalid").when(F.col("short_warnings") > 0, "warnings").otherwise("valid")
    return agg.withColumn("sinhala_pct", share).select(
        "total_rows",
        (F.col("total_rows") - empty).alias("passed_rows"),
        empty.alias("failed_rows"),
        "empty_instructions", "empty_responses", "short_warnings",
        "avg_words", "min_words", "max_words",
        F.floor(F.col("_words") * 1.3).cast("long").alias("est_tokens"),
        "sinhala_pct",
        F.round(F.lit(100.0) - F.col("sinhala_pct"), 1).alias("english_pct"),
        status.alias("status"),
    )


def csv_warnings(
    rows: DataFrame, row_num: str, instruction: str, response: str, extra: str | None = None
) -> DataFrame:
    """(stage, row, part, warning): empty fields, then the first fifty short texts and their rest count."""
    m = _csv_measures(rows, instruction, response, extra)
    row = F.col(row_num)
    label = F.concat(F.lit("Row "), row.cast("string"), F.lit(": "))

    def entry(when: Column, stage: int, part: int, text: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(stage).alias("stage"), row.cast("long").alias("row"), F.lit(part).alias("part"),
                F.concat(label, text).alias("warning"),
            ),
        )

    def short(size: Column, what: str) -> Column:
        return F.concat(F.lit(f"{what} has only "), size.cast("string"), F.lit(" words."))

    entries = F.array_compact(
        F.array(
            entry(F.col("_ask") == "", 0, 0, F.lit("Empty instruction (CRITICAL error).")),
            entry(F.col("_answer") == "", 1, 0, F.lit("Empty response (CRITICAL error).")),
            entry(F.col("_user_words").between(1, 2), 2, 0, short(F.col("_user_words"), "Instruction")),
            entry(F.col("_answer_words").between(1, 2), 2, 1, short(F.col("_answer_words"), "Response")),
        )
    )
    # the rows are read once: their warnings are written, and counted on the way
    seen = Observation()
    found = checkpoint(m.select(F.inline(entries)).observe(seen, F.count_if(F.col("stage") == 2).alias("shorts")))
    shown = found.where("stage = 2").orderBy("row", "part").limit(SHOWN_WARNINGS)
    listed = found.where("stage < 2").unionByName(shown)
    rest = (seen.get["shorts"] or 0) - SHOWN_WARNINGS
    if rest <= 0:
        return listed
    more = F.struct(
        F.lit(3).alias("stage"), F.lit(None).cast("long").alias("row"), F.lit(0).alias("part"),
        F.lit(f"... and {rest} more length warnings.").alias("warning"),
    )
    return listed.unionByName(rows.sparkSession.range(1).select(more.alias("w")).select("w.*"))


def csv_preview(
    rows: DataFrame, row_num: str, instruction: str, response: str, extra: str | None, system: str, n: int = 3
) -> DataFrame:
    """First complete rows as chat messages."""
    chats = csv_to_sft(rows, instruction, response, extra, system, [row_num])
    return chats.orderBy(row_num).limit(n)


def preference_diagnostics(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of word statistics, counts per prompt category)."""
    stats = pairs.agg(
        F.count("*").alias("total_pairs"),
        F.coalesce(F.round(F.avg(word_count(F.col("chosen"))), 1), F.lit(0.0)).alias("avg_chosen_words"),
        F.coalesce(F.round(F.avg(word_count(F.col("rejected"))), 1), F.lit(0.0)).alias("avg_rejected_words"),
    )
    chosen, rejected = F.col("avg_chosen_words"), F.col("avg_rejected_words")
    ratio = F.when(rejected > 0, F.round(chosen / rejected, 2)).otherwise(1.0)
    stats = stats.withColumn("length_ratio", ratio)
    stats = stats.withColumn("verbosity_warning", F.col("length_ratio") > 1.5)
    by_category = pairs.groupBy(prompt_category(F.col("prompt")).alias("category"))
    return stats, by_category.agg(F.count("*").alias("n"))


def nutrition_totals(
    components: DataFrame, dish: str, item: str, foods: DataFrame, variant: str = "current"
) -> DataFrame:
    """Per dish: calories to the nearest ten (half to even), macros and match confidence."""
    resolved = resolve_foods(components, item, foods)
    return total_nutrition(resolved, dish, variant)


def total_nutrition(resolved: DataFrame, dish: str, variant: str = "current") -> DataFrame:
    """Totals of components that already carry `matched` and nutrients."""
    sure, unsure = food.MATCH_CONFIDENCE[variant]
    places = 1 if variant == "current" else 0
    sums = [F.bround(F.sum(c), places).alias(f"{c}_g") for c in ("protein", "carbs", "fat")]
    return resolved.groupBy(dish).agg(
        (F.bround(F.sum("calories") / 10.0) * 10).cast("int").alias("calories"),
        *sums,
        F.when(F.bool_and("matched"), sure).otherwise(unsure).alias("nutrition_confidence"),
        F.count("*").alias("components"),
    )


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds `hit` (1 or 0) by benchmark; for toxigen a hit is a toxic answer.

    Expects benchmark, answer, gold_index, gold_number and gold_text.
    """
    name, answer = F.col("benchmark"), F.col("answer")
    hit = (
        F.when(name == "mmlu", scores.score_choice(answer, F.col("gold_index")))
        .when(name == "gsm8k", scores.score_numeric(answer, F.col("gold_number")))
        .when(name == "toxigen", scores.is_toxic(answer))
        .when(name.isin("truthfulqa", "mmmu", "air_bench"), scores.score_contains(answer, F.col("gold_text")))
    )
    return answers.withColumn("hit", hit.cast("int"))


def benchmark_report(scored: DataFrame) -> DataFrame:
    """(name, score, target, passed, n) per benchmark; the toxic rate must stay at or below its target."""
    target = F.lit(None).cast("double")
    for name, value in food.BENCHMARK_TARGETS:
        target = F.when(F.col("name") == name, value).otherwise(target)
    report = scored.groupBy(F.col("benchmark").alias("name")).agg(
        F.avg("hit").alias("score"), F.count("*").alias("n")
    )
    report = report.withColumn("target", target)
    passed = F.when(F.col("name") == "toxigen", F.col("score") <= F.col("target")).otherwise(
        F.col("score") >= F.col("target")
    )
    return report.select("name", "score", "target", passed.alias("passed"), "n")


def safety_gate(report: DataFrame) -> DataFrame:
    """One row: whether a safety benchmark failed."""
    safety = F.col("name").isin(food.SAFETY_BENCHMARKS)
    return report.agg(F.coalesce(F.bool_or(safety & ~F.col("passed")), F.lit(False)).alias("triggered"))


def text_metric_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean BLEU, ROUGE-L and similarity to four places, and the count."""
    means = [
        F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(f"avg_{n}")
        for c, n in [("bleu", "bleu"), ("rouge_l", "rouge"), ("similarity", "similarity")]
    ]
    return scored.groupBy(*(by or [])).agg(*means, F.count("*").alias("count"))


def decoding_diagnostics(runs: DataFrame, order: list[str], last: int = 20, bins: int = 7) -> DataFrame:
    """One row over the newest runs: count, mean speed-up, mean acceptance and summed histogram."""
    recent = keep_last_n(runs, last, order)
    sums = [F.coalesce(F.sum(F.get("histogram", F.lit(i))), F.lit(0)) for i in range(bins)]
    return recent.agg(
        F.count("*").alias("total_runs"),
        F.coalesce(F.round(F.avg("speedup"), 2), F.lit(1.0)).alias("avg_speedup"),
        F.coalesce(F.round(F.avg("acceptance_rate"), 1), F.lit(0.0)).alias("avg_acceptance_rate"),
        F.array(*sums).alias("histogram"),
    )


def training_progress(log: DataFrame, run: str | None = None) -> DataFrame:
    """Latest step with its loss, rate, epoch and percent done, overall or per run."""
    loss = F.coalesce(F.nullif("loss", F.lit(0.0)), "train_loss") if "train_loss" in log.columns else F.col("loss")
    percent = F.least(F.lit(100), F.floor(F.col("step") / F.col("max_steps") * 100 + 0.5)).cast("int")
    shown = F.struct(
        "step", "max_steps", loss.alias("loss"), "learning_rate", "epoch", percent.alias("percent")
    )
    keys = [run] if run else []
    return log.groupBy(*keys).agg(F.max_by(shown, "step").alias("_l")).select(*keys, "_l.*")


def loss_series(log: DataFrame) -> DataFrame:
    """(step, loss) in step order, 0 where no loss was logged."""
    return log.select("step", F.coalesce("loss", F.lit(0.0)).alias("loss")).orderBy("step")


def validation_perplexity(batches: DataFrame, loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """Mean loss and its exponential."""
    mean = F.coalesce(F.avg(loss), F.lit(0.0))
    return batches.groupBy(*(by or [])).agg(mean.alias("val_loss"), F.exp(mean).alias("perplexity"))
