"""Layered safety checks before and after inference, with audit rows per evaluated layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.functions import guard
from cinderleaf.functions.redact import contains_pii, redact_output
from cinderleaf.functions.text import passes_toxicity


def _event(reached: Column, kind: str, layer: str, passed: Column) -> Column:
    return F.when(
        reached,
        F.struct(F.lit(kind).alias("event_type"), F.lit(layer).alias("layer"), passed.alias("passed")),
    )


def _outcome(df: DataFrame, keep: list[str], reason: Column, refusal: Column, response: Column, events: list) -> DataFrame:
    judged = df.withColumns({"refusal_reason": reason, "_refusal": refusal})
    refused = F.col("refusal_reason").isNotNull()
    return judged.select(
        *keep,
        (~refused).alias("allowed"),
        F.when(refused, guard.refusal_text(F.col("_refusal"))).otherwise(response).alias("response"),
        "refusal_reason",
        F.array_compact(F.array(*events)).alias("events"),
    )


def safety_pre(
    requests: DataFrame, keep: list[str], messages: str = "messages", image: str | None = None,
    transcript: str | None = None, blocked_images: list[str] | None = None,
) -> DataFrame:
    """First failing input layer of each request: allowed, response, refusal_reason, events."""
    combined = F.array_join(F.transform(guard.enforce_schema(F.col(messages)), lambda m: m["content"]), " ")
    staged = requests.withColumn("_text", combined)
    text = F.col("_text")
    staged = staged.withColumns(
        {
            "_jail": guard.jailbreak_detected(text),
            "_clean": passes_toxicity(text) & ~contains_pii(text),
        }
    )
    image_ok = F.lit(True)
    if image and blocked_images:
        image_ok = F.coalesce(~F.sha2(F.col(image), 256).isin(blocked_images), F.lit(True))
    heard, audio_ok = F.lit(False), F.lit(True)
    if transcript:
        spoken = F.col(transcript)
        heard = F.coalesce(spoken != "", F.lit(False))
        audio_ok = ~heard | (passes_toxicity(spoken) & ~contains_pii(spoken))
    staged = staged.withColumns({"_image": image_ok, "_heard": heard, "_audio": audio_ok})
    jail, clean = F.col("_jail"), F.col("_clean")
    open_text = ~jail & clean
    reason = (
        F.when(jail, "jailbreak")
        .when(~clean, "input_toxic")
        .when(~F.col("_image"), "blocked_image")
        .when(~F.col("_audio"), "input_audio_toxic")
    )
    refusal = F.when(jail, "jailbreak").otherwise("harmful")
    events = [
        _event(F.lit(True), "prompt_process", "L1", ~jail),
        _event(~jail, "input_text", "L2", clean),
        _event(open_text & ~F.col("_image"), "input_image", "L2", F.lit(False)),
        _event(open_text & F.col("_image") & F.col("_heard"), "input_audio", "L2", F.col("_audio")),
    ]
    return _outcome(staged, keep, reason, refusal, F.lit(""), events)


def safety_post(
    responses: DataFrame, keep: list[str], response: str = "response", logits: str | None = None
) -> DataFrame:
    """First failing output layer of each response: allowed, response, refusal_reason, events."""
    head = guard.safety_head_decision(F.col(logits)) if logits else F.lit(None).cast("string")
    scored = F.col(logits).isNotNull() if logits else F.lit(False)
    staged = responses.withColumns(
        {"_head": head, "_scored": scored, "_out": redact_output(F.col(response))}
    )
    staged = staged.withColumn("_aligned", guard.alignment_check(F.col("_out.text"))["passed"])
    calm, out_ok, aligned = F.col("_head").isNull(), F.col("_out.ok"), F.col("_aligned")
    reason = (
        F.when(~calm, F.concat(F.lit("safety_head_"), "_head"))
        .when(~out_ok, "output_blocked")
        .when(~aligned, "alignment_failed")
    )
    refusal = F.when(~calm, F.col("_head")).when(~out_ok, "harmful").otherwise("default")
    events = [
        _event(F.col("_scored"), "safety_head", "L3", calm),
        _event(calm, "output_filter", "L4", out_ok),
        _event(calm & out_ok, "alignment", "L5", aligned),
    ]
    return _outcome(staged, keep, reason, refusal, F.col("_out.text"), events)


def safety_events(checked: DataFrame, keep: list[str]) -> DataFrame:
    """One audit row per evaluated layer."""
    return checked.select(*keep, F.posexplode("events").alias("pos", "_e")).select(*keep, "pos", "_e.*")
