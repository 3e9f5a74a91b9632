"""Prompt, response and request guards as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions.text import count_hits, normalize_security, squeeze, strip


def _named(patterns: list[str], assistant: str) -> list[str]:
    return [p.replace("{assistant}", assistant) for p in patterns]


def _any_of(patterns: list[str], flags: str) -> str:
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns)


def prompt_length_ok(text: Column, max_tokens: int = rules.MAX_PROMPT_TOKENS) -> Column:
    return F.length(text) <= max_tokens * rules.CHARS_PER_TOKEN


def detect_injection(text: Column, assistant: str = "assistant", normalize: bool = True) -> Column:
    """True when any injection phrase occurs in the normalised text."""
    clean = normalize_security(text) if normalize else text
    return clean.rlike(_any_of(_named(rules.INJECTION_PATTERNS, assistant), "Uis"))


def is_hijack(text: Column, assistant: str = "assistant", normalize: bool = True) -> Column:
    clean = normalize_security(text) if normalize else text
    return clean.rlike(_any_of(_named(rules.HIJACK_PATTERNS, assistant), "Uis"))


def persona_hijack(
    text: Column, assistant: str = "assistant", display: str = "Assistant", normalize: bool = True
) -> Column:
    """Struct (hijack, text): hijacked prompts get the reinforcement line in front."""
    hijack = is_hijack(text, assistant, normalize)
    prefix = rules.REINFORCEMENT.replace("{assistant}", display)
    return F.struct(
        hijack.alias("hijack"),
        F.when(hijack, F.concat(F.lit(prefix), text)).otherwise(text).alias("text"),
    )


def jailbreak_score(text: Column) -> Column:
    hits = count_hits(text, rules.JAILBREAK_PATTERNS, "Ui")
    return F.least(F.lit(1.0), hits * F.lit(rules.JAILBREAK_HIT))


def jailbreak_detected(text: Column) -> Column:
    return text.rlike(_any_of(rules.JAILBREAK_PATTERNS, "Ui"))


def intent_score(text: Column, assistant: str = "assistant") -> Column:
    """100 for harmful content, else the hijack weight plus the weights of matched threats."""
    low = F.lower(text)
    score = F.when(is_hijack(low, assistant, normalize=False), rules.HIJACK_WEIGHT).otherwise(0)
    for pattern, weight in rules.THREAT_WEIGHTS:
        score = score + F.when(low.rlike(f"(?Ud){pattern}"), weight).otherwise(0)
    harmful = low.rlike(_any_of(rules.HARMFUL_PATTERNS, "Uid"))
    return F.when(harmful, rules.HARMFUL_SCORE).otherwise(score)


def intent_status(text: Column, score: Column) -> Column:
    """Class of a prompt from its score; harmful content is a class of its own."""
    harmful = F.lower(text).rlike(_any_of(rules.HARMFUL_PATTERNS, "Uid"))
    status = F.when(harmful, "HARMFUL_CONTENT")
    for least, name in rules.INTENT_TIERS:
        status = status.when(score >= least, name)
    return status.otherwise("SAFE")


def severity(status: Column) -> Column:
    rank = F.lit(0)
    for level, name in enumerate(rules.SEVERITY):
        rank = F.when(status == name, level).otherwise(rank)
    return rank


def final_intent(status: Column, multi_turn: Column) -> Column:
    """The more severe of the single-turn and the multi-turn class."""
    return F.when(severity(multi_turn) > severity(status), multi_turn).otherwise(status)


def payload_intent_ok(mode: Column) -> Column:
    found = F.lower(mode).rlike("|".join(rules.MODE_PATTERNS))
    return ~F.coalesce(found, F.lit(False))


def alignment_check(response: Column) -> Column:
    """Struct (helpful, honest, harmless, passed, issues) of a response."""
    low = F.lower(response)
    empty = F.length(strip(response)) < 2
    refusal = low.contains("i cannot") & ~low.contains("because") & ~low.contains("sorry")
    harmful = F.lit(False)
    for phrase in rules.HARMFUL_PHRASES:
        harmful = harmful | low.contains(phrase)
    helpful = ~empty & ~refusal
    return F.struct(
        helpful.alias("helpful"),
        F.lit(True).alias("honest"),
        (~harmful).alias("harmless"),
        (helpful & ~harmful).alias("passed"),
        F.array_compact(
            F.array(
                F.when(empty, F.lit("empty_response")),
                F.when(refusal, F.lit("unhelpful_refusal")),
                F.when(harmful, F.lit("harmful_content")),
            )
        ).alias("issues"),
    )


def safety_head_decision(logits: Column, threshold: float = rules.SAFETY_THRESHOLD) -> Column:
    """Refusal category of the strongest logit when its sigmoid exceeds the threshold."""
    top = F.array_max(logits)
    place = F.least(F.array_position(logits, top), F.lit(len(rules.SAFETY_CATEGORIES)))
    names = F.array(*[F.lit(c) for c in rules.SAFETY_CATEGORIES])
    chance = 1.0 / (1.0 + F.exp(-top.cast("double")))
    return F.when(chance > threshold, F.element_at(names, place.cast("int")))


def refusal_text(reason: Column, alternatives: Column | None = None) -> Column:
    text = F.lit(rules.REFUSALS["default"])
    for name, template in rules.REFUSALS.items():
        text = F.when(reason == name, template).otherwise(text)
    if alternatives is None:
        return text
    bullets = F.array_join(F.transform(alternatives, lambda a: F.concat(F.lit("- "), a)), "\n")
    listed = F.concat(text, F.lit("\n\nI can help with:\n"), bullets)
    return F.when(F.size(alternatives) > 0, listed).otherwise(text)


def image_allowed(content: Column, nsfw_score: Column, blocked: list[str]) -> Column:
    """SHA-256 not in a short block list and NSFW score below one half."""
    return ~F.sha2(content, 256).isin(blocked) & (F.coalesce(nsfw_score, F.lit(0.0)) < 0.5)


def clean_message(content: Column, cap: int = rules.MAX_MESSAGE_CHARS) -> Column:
    return F.substring(squeeze(F.coalesce(content, F.lit(""))), 1, cap)


def clean_role(role: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant", "tool"), role).otherwise("user")


def enforce_schema(messages: Column) -> Column:
    """Message array with known roles and squeezed, non-empty content."""
    fixed = F.transform(
        messages,
        lambda m: F.struct(
            clean_role(m["role"]).alias("role"), clean_message(m["content"]).alias("content")
        ),
    )
    return F.filter(fixed, lambda m: m["content"] != "")


def fingerprint(ip: Column, agent: Column) -> Column:
    joined = F.concat_ws(":", ip, F.coalesce(agent, F.lit("unknown")))
    return F.substring(F.sha2(joined, 256), 1, 16)
