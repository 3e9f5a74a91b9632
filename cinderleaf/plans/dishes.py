"""Dish scans: admission, intent, throttling, nutrition, advice, alerts and overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.functions import food as dish_rules
from cinderleaf.functions.guard import payload_intent_ok
from cinderleaf.functions.redact import scrub_guest_text
from cinderleaf.operators.aggregates import total_nutrition
from cinderleaf.operators.folds import rate_limit_admitted, throttle_frames
from cinderleaf.operators.lookup import resolve_foods
from cinderleaf.session import dealt, tasks_for


def admit_scans(scans: DataFrame, scan: str, client: str, t: str, payload: str, mode: str) -> DataFrame:
    """Adds `outcome`: rate_limited, injection, skipped or accepted.

    Only admitted calls reach the intent check and only those it passes reach the frame throttle.
    """
    tasks = tasks_for(scans)
    limited = rate_limit_admitted(scans, client, t, scan, tasks=tasks)
    safe = limited.withColumn("_safe", payload_intent_ok(F.col(mode)))
    frames = safe.where(F.col("allowed") & F.col("_safe")).select(scan, client, t, payload)
    taken = throttle_frames(frames, client, t, scan, payload, tasks=tasks).select(scan, "accepted")
    outcome = (
        F.when(~F.col("allowed"), "rate_limited")
        .when(~F.col("_safe"), "injection")
        .when(F.col("accepted"), "accepted")
        .otherwise("skipped")
    )
    joined = safe.join(taken, scan, "left")
    return joined.select(*scans.columns, outcome.alias("outcome"))


def clean_component_rows(components: DataFrame, name: str = "name") -> DataFrame:
    """Component rows with cleaned names; unusable names are dropped."""
    return components.withColumn(name, dish_rules.clean_component(F.col(name))).where(F.col(name).isNotNull())


def component_breakdown(resolved: DataFrame, pos: str = "pos", name: str = "name") -> DataFrame:
    """Adds the plate box and styling of every resolved component."""
    return resolved.withColumns(
        {"box": dish_rules.plate_box(F.col(pos)), "styling": dish_rules.macro_tag(F.col(name))}
    )


def scan_dishes(
    scans: DataFrame, components: DataFrame, foods: DataFrame, scan: str = "scan_id",
    client: str = "client_id", t: str = "t_ms", payload: str = "payload", mode: str = "mode",
    lang: str = "lang", context: str | None = None,
) -> DataFrame:
    """One row per scan with its outcome and, when accepted, the full dish answer.

    `scans` carries dish_name and confidence; `components(scan_id, pos, name)` are the recognised
    parts. `context` names a column with the retrieved knowledge sentence.
    """
    admitted = admit_scans(scans, scan, client, t, payload, mode)
    return answer_scans(admitted, components, foods, scan, mode, lang, context)


def answer_scans(
    admitted: DataFrame, components: DataFrame, foods: DataFrame, scan: str = "scan_id", mode: str = "mode",
    lang: str = "lang", context: str | None = None,
) -> DataFrame:
    """The answers of scans whose `outcome` is known; null for all that are not accepted.

    The tasks grow with the components, so none sorts more of them on larger tables.
    """
    tasks = tasks_for(components)
    admitted = dealt(admitted, scan, tasks)
    accepted = admitted.where("outcome = 'accepted'").select(scan)
    parts = clean_component_rows(dealt(components, scan, tasks).join(accepted, scan, "left_semi"))
    resolved = resolve_foods(parts, "name", foods)
    totals = total_nutrition(resolved, scan)
    names = parts.groupBy(scan).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"]).alias("_names")
    )
    rows = admitted.join(totals, scan, "left").join(names, scan, "left")
    rows = rows.withColumns(
        {
            "_names": F.coalesce("_names", F.array().cast("array<string>")),
            "calories": F.coalesce("calories", F.lit(0)),
            "protein_g": F.coalesce("protein_g", F.lit(0.0)),
            "carbs_g": F.coalesce("carbs_g", F.lit(0.0)),
            "fat_g": F.coalesce("fat_g", F.lit(0.0)),
            "nutrition_confidence": F.coalesce("nutrition_confidence", F.lit(food.MATCH_CONFIDENCE["current"][1])),
        }
    )
    knowledge = F.col(context) if context else F.lit(food.KNOWLEDGE_NONE)
    dish = F.col("dish_name")
    rows = rows.withColumns(
        {
            "recommendation": scrub_guest_text(
                dish_rules.advice(knowledge, F.col(mode), F.col("calories"), F.col("protein_g"))
            ),
            "spice": dish_rules.spice_alert(dish, F.col("_names")),
            "price": dish_rules.fair_price(dish),
            "voice": dish_rules.guide_text(dish, F.col(lang)),
            "confidence_state": dish_rules.confidence_state(F.col("confidence")),
            "label": F.concat(dish, F.lit(" (~"), F.col("calories").cast("string"), F.lit(" kcal)")),
        }
    )
    badge = dish_rules.badge_color(F.col("confidence"), F.col("spice.is_emergency"))
    rows = rows.withColumn("badge_color", badge).drop("_names", "components")
    answer = [c for c in rows.columns if c not in admitted.columns]
    shown = [F.when(F.col("outcome") == "accepted", F.col(c)).alias(c) for c in answer]
    return rows.select(*admitted.columns, *shown)
