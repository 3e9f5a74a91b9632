"""Multi-turn, session, sampling and batching operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules
from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions.guard import intent_score, intent_status
from cinderleaf.operators.ordered import (
    CHUNK_ROWS,
    cut_segments,
    dense_index,
    lag_in,
    over_chunks,
)
from cinderleaf.session import checkpoint, fits_broadcast

# Clips whose sizes are sent to all executors, two numbers each; the samples of more clips are shuffled.
CLIPS = 1 << 22


def with_intent(prompts: DataFrame, text: str, assistant: str = "assistant") -> DataFrame:
    """Adds `score` and `status` of every prompt."""
    scored = prompts.withColumn("score", intent_score(F.col(text), assistant))
    return scored.withColumn("status", intent_status(F.col(text), F.col("score")))


def multi_turn_escalation(
    turns: DataFrame,
    session: str,
    t: str,
    tie: str,
    score: str = "score",
    status: str = "status",
    gap: int = rules.SESSION_IDLE_MS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `multi_turn` from the scores of the last five turns; a long gap starts a new history.

    `tie` is a unique row id.
    """
    reach = rules.TURN_WINDOW - 1
    narrow = turns.select(session, t, tie, score, status)
    rows = dense_index(narrow, [session, t, tie], "_i")

    def look_back(w) -> dict[str, Column]:
        out = {}
        for n in range(1, reach + 1):
            out[f"_t{n}"] = lag_in([session], t, n, w)
            out[f"_s{n}"] = lag_in([session], score, n, w)
            out[f"_c{n}"] = lag_in([session], status, n, w)
        return out

    rows = over_chunks(rows, "_i", reach, look_back, chunk_rows)
    total, hits = F.col(score), (F.col(score) > 0).cast("int")
    harmful = F.col(status) == "HARMFUL_CONTENT"
    linked, later = F.lit(True), F.col(t)
    for n in range(1, reach + 1):
        linked = linked & F.coalesce(later - F.col(f"_t{n}") <= gap, F.lit(False))
        past = F.when(linked, F.col(f"_s{n}")).otherwise(0)
        total, hits = total + past, hits + (past > 0).cast("int")
        harmful = harmful | (linked & (F.col(f"_c{n}") == "HARMFUL_CONTENT"))
        later = F.col(f"_t{n}")
    verdict = (
        F.when((hits >= 3) | (total >= 50), "INJECTION_ATTEMPT")
        .when((hits >= 2) | (total >= 30), "SUSPICIOUS")
        .when(harmful, "HARMFUL_CONTENT")
        .otherwise("SAFE")
    )
    # score and status come back from the narrow rows, so they are computed once
    judged = rows.select(tie, score, status, verdict.alias("multi_turn"))
    return turns.drop(score, status).join(judged, tie).select(*turns.columns, "multi_turn")


def session_validity(
    events: DataFrame,
    session: str,
    t: str,
    tie: str,
    timeout: int = rules.SESSION_IDLE_MS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `valid`: no idle gap above the timeout so far; an expired session stays invalid.

    `tie` is a unique row id.
    """
    rows = dense_index(events.select(session, t, tie), [session, t, tie], "_i")
    rows = over_chunks(rows, "_i", 1, lambda w: {"_before": lag_in([session], t, 1, w)}, chunk_rows)
    late = rows.where(F.col(t) - F.col("_before") > timeout)
    expired = late.groupBy(session).agg(F.min("_i").alias("_end"))
    valid = F.col("_end").isNull() | (F.col("_i") < F.col("_end"))
    judged = rows.join(expired, session, "left").select(tie, valid.alias("valid"))
    return events.join(judged, tie).select(*events.columns, "valid")


def session_segments(
    events: DataFrame,
    session: str,
    t: str,
    tie: str,
    timeout: int = rules.SESSION_IDLE_MS,
) -> DataFrame:
    """One row per run of activity: session, start, end and number of events."""
    runs = cut_segments(
        events.select(session, t, tie),
        [session],
        [t, tie],
        [t],
        lambda before: F.col(t) - before(t) > timeout,
    )
    return runs.groupBy(session, "segment").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("events")
    ).drop("segment")


def stale_keys(events: DataFrame, key: str, t: str, now: Column, horizon: int) -> DataFrame:
    """Keys whose last activity lies more than `horizon` before `now`."""
    last = events.groupBy(key).agg(F.max(t).alias("last_seen"))
    return last.where(now - F.col("last_seen") > horizon)


def uniform_sample(frames: DataFrame, video: str, frame: str, k: int) -> DataFrame:
    """Up to `k` frames per video, evenly spaced in the order of their numbers, which may have gaps."""
    placed = dense_index(frames.select(video, frame).distinct(), [video, frame], "_i")
    sizes = placed.groupBy(video).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    take = F.least(F.lit(k), F.col("_n"))
    step = (F.col("_n") - 1).cast("double") / (take - 1)
    last = F.col("_n") - 1
    spots = F.transform(
        F.sequence(F.lit(0), (take - 1).cast("int")),
        lambda j: F.when(j == 0, F.lit(0))
        .when(j == take - 1, last)
        .otherwise(F.floor(j * step))
        .cast("long"),
    )
    wanted = sizes.select("_first", F.explode(F.array_distinct(spots)).alias("_spot"))
    chosen = placed.join(wanted.select((F.col("_first") + F.col("_spot")).alias("_i")), "_i", "left_semi")
    return frames.join(chosen.select(video, frame), [video, frame], "left_semi")


def pad_batches(
    tokens: DataFrame, order: list[str], ids: str, size: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adds `batch`, `input_ids` and `labels`, right-padded to the longest row of the batch."""
    rows = dense_index(tokens, order, "_i").withColumn("batch", F.floor(F.col("_i") / size))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))  # `size` rows per window
    padded = rows.withColumn("_pad", longest - F.size(ids))
    labels = F.array_repeat(F.lit(food_rules.PAD_LABEL), F.col("_pad"))
    return padded.select(
        *tokens.columns,
        "batch",
        F.concat(F.col(ids), F.array_repeat(F.lit(0), F.col("_pad"))).alias("input_ids"),
        F.concat(F.col(ids), labels).alias("labels"),
    )


def amplitude_points(
    samples: DataFrame, clip: str, index: str, value: str, points: int = 40, mode: str = "point", clips: int = CLIPS
) -> DataFrame:
    """(clip, pos, amplitude): `points` samples per clip, or boosted bin means in mean mode.

    The sizes of up to `clips` clips are broadcast, so that no sample leaves its task unless it is shown or summed;
    with more clips all samples are shuffled to their clip's size. Neither way sorts them.
    """
    sizes = samples.groupBy(clip).agg(F.count("*").alias("_n"))
    width = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    steps = checkpoint(sizes.select(clip, width.alias("_step")))
    held = steps.hint("broadcast" if fits_broadcast(steps, clips) else "shuffle_hash")
    joined = samples.join(held, clip).withColumn("pos", F.floor(F.col(index) / F.col("_step")))
    near = joined.where(F.col("pos") < points)
    if mode == "mean":
        kept = near.groupBy(clip, "pos").agg(F.avg(F.abs(F.col(value))).alias("_a"))
        shown = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.col("_a") * 6.0)), 3)
        empty = 0.01
    else:
        first = near.where(F.col(index) % F.col("_step") == 0)
        kept = first.select(clip, "pos", F.abs(F.col(value)).alias("_a"))
        shown = F.round("_a", 3)
        empty = 0.0
    grid = steps.select(clip, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("pos"))
    filled = grid.join(kept.withColumn("pos", F.col("pos").cast("int")), [clip, "pos"], "left")
    return filled.select(clip, "pos", F.coalesce(shown, F.lit(empty)).alias("amplitude"))
