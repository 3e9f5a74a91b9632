"""Request guard: rate limit, normalisation, length, hijack, intent and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions import guard
from cinderleaf.functions.redact import scrub_pii
from cinderleaf.functions.text import normalize_security
from cinderleaf.operators.folds import rate_limit
from cinderleaf.operators.sequence import multi_turn_escalation, with_intent
from cinderleaf.session import checkpoint

ALL_LAYERS = frozenset({1, 2, 8})


def rate_message(verdict: Column, retry_s: Column) -> Column:
    """User-facing text of a denied call."""
    return (
        F.when(
            verdict == "blocked",
            F.concat(
                F.lit("Abuse Detected: IP temporarily blocked. Try again in "),
                retry_s.cast("string"),
                F.lit(" seconds."),
            ),
        )
        .when(
            verdict == "burst",
            "Abuse Detected: Request burst threshold exceeded. "
            f"IP blocked for {rules.BLOCK_MS // 60_000} minutes.",
        )
        .when(verdict == "limited", f"Too many requests. Limit is {rules.RATE_LIMIT} requests per minute.")
    )


def screen_prompts(
    prompts: DataFrame, prompt: str, assistant: str, display: str, layers: frozenset[int]
) -> DataFrame:
    """Stateless part, for tables and streams: `clean`, `too_long`, `hijack`, `score`, `status`."""
    rows = prompts.withColumn("clean", normalize_security(F.col(prompt)))
    long = ~guard.prompt_length_ok(F.col("clean")) if 1 in layers else F.lit(False)
    rows = rows.withColumn("too_long", long)
    hijack = guard.persona_hijack(F.col("clean"), assistant, display, normalize=False)
    if 8 not in layers:
        hijack = F.struct(F.lit(False).alias("hijack"), F.col("clean").alias("text"))
    rows = rows.withColumn("_h", hijack)
    rows = rows.withColumns({"hijack": F.col("_h.hijack"), "clean": F.col("_h.text")}).drop("_h")
    if 8 in layers:
        return with_intent(rows, "clean", assistant)
    return rows.withColumns({"score": F.lit(0), "status": F.lit("SAFE")})


def guard_requests(
    requests: DataFrame,
    request_id: str,
    ip: str,
    session: str,
    t: str,
    prompt: str,
    assistant: str = "assistant",
    display: str = "Assistant",
    layers: frozenset[int] = ALL_LAYERS,
) -> DataFrame:
    """Adds `outcome` (rate_limited, too_long, blocked, allowed), `final_status` and the cleaned prompt.

    Each stage sees only what the stages before it let through; the turn history of a session holds
    the prompts that reached the intent stage.
    """
    if 2 in layers:
        limited = rate_limit(requests, ip, t, request_id)
    else:
        limited = requests.withColumns({"verdict": F.lit("ok"), "retry_s": F.lit(None).cast("long")})
    # written once: the text rules feed both the turn history and the outcome
    screened = checkpoint(screen_prompts(limited, prompt, assistant, display, layers))
    admitted = screened.where((F.col("verdict") == "ok") & ~F.col("too_long"))
    if 8 in layers:
        history = admitted.where(F.col(session).isNotNull())
        scored = history.select(request_id, session, t, "score", "status")
        turns = multi_turn_escalation(scored, session, t, request_id).select(request_id, "multi_turn")
    else:
        turns = admitted.select(request_id, F.lit("SAFE").alias("multi_turn"))
    joined = screened.join(turns, request_id, "left")
    joined = joined.withColumn("multi_turn", F.coalesce("multi_turn", F.lit("SAFE")))
    return with_outcome(joined, F.col("multi_turn"))


def with_outcome(rows: DataFrame, multi_turn: Column) -> DataFrame:
    """Adds `outcome` and `final_status` of screened requests. For tables and streams."""
    final = guard.final_intent(F.col("status"), multi_turn)
    outcome = (
        F.when(F.col("verdict") != "ok", "rate_limited")
        .when(F.col("too_long"), "too_long")
        .when(final.isin(rules.BLOCKING_INTENTS), "blocked")
        .otherwise("allowed")
    )
    reached = outcome.isin("blocked", "allowed")
    return rows.withColumns({"outcome": outcome, "final_status": F.when(reached, final)})


def scrub_responses(guarded: DataFrame, response: str = "response") -> DataFrame:
    """Responses of allowed requests without personal data; null for all others. For tables and streams."""
    return guarded.withColumn(response, F.when(F.col("outcome") == "allowed", scrub_pii(F.col(response))))


def guard_audit(guarded: DataFrame, request_id: str, ip: str, t: str, endpoint: str) -> DataFrame:
    """Audit rows of guarded requests, in order: (request, pos, ip, t, endpoint, level, message)."""
    outcome = F.col("outcome")

    def row(when: Column, level: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("threat_level"), message.alias("message")))

    rate = F.concat(F.lit("Rate Limit Blocked: "), rate_message(F.col("verdict"), F.col("retry_s")))
    entries = F.array_compact(
        F.array(
            row(outcome == "rate_limited", "HIGH", rate),
            row(
                outcome == "too_long",
                "WARNING",
                F.lit("Block: Prompt exceeds length threshold of 2000 tokens."),
            ),
            row(
                outcome.isin("blocked", "allowed") & F.col("hijack"),
                "WARNING",
                F.lit("Persona hijack attempt detected and neutralized."),
            ),
            row(
                outcome == "blocked",
                "CRITICAL",
                F.concat(F.lit("Block: Prompt injection attempt. Intent: "), F.col("final_status")),
            ),
            row(
                outcome == "allowed",
                "INFO",
                F.concat(F.lit("Inference prompt: "), F.substring("clean", 1, 40), F.lit("...")),
            ),
        )
    )
    return guarded.select(request_id, ip, t, F.lit(endpoint).alias("endpoint"), F.posexplode(entries).alias("pos", "_e")).select(
        request_id, "pos", ip, t, "endpoint", "_e.*"
    )
