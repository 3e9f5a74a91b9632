"""Rate, throttle and replay rules over request tables.

The sequential part of each rule is cut down first: windows over bounded chunks find the rows whose
verdict depends on earlier verdicts, and quiet gaps split them into independent segments. Only those
segments are folded, as a stream of sorted rows. All of it runs on key, time and row id alone; the
verdicts are joined back to the full rows by the row id `tie`, which must be unique.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.operators.ordered import (
    CHUNK_ROWS,
    cut_segments,
    dense_index,
    fold_segments,
    lag_in,
    over_chunks,
)
from cinderleaf.session import checkpoint, dealt


@dataclass
class Block:
    """End of the block a key is under."""

    until: float = float("-inf")


def burst_step(state: Block, t: int, first: int, block: int) -> bool:
    """A burst counts when all its calls were recorded; it then blocks the key."""
    if first < state.until:
        return False
    state.until = t + block
    return True


@dataclass
class Admitted:
    """Times of the calls admitted within the window."""

    times: deque = field(default_factory=deque)


def admit_step(state: Admitted, t: int, limit: int, window: int) -> bool:
    while state.times and t - state.times[0] >= window:
        state.times.popleft()
    if len(state.times) >= limit:
        return False
    state.times.append(t)
    return True


@dataclass
class LastFrame:
    t: int | None = None
    signature: str | None = None


def frame_step(state: LastFrame, t: int, signature: str, throttle: int) -> bool:
    if state.t is not None and (t - state.t < throttle or signature == state.signature):
        return False
    state.t, state.signature = t, signature
    return True


@dataclass
class LastUse:
    t: int | None = None


def nonce_step(state: LastUse, t: int, horizon: int) -> bool:
    if state.t is not None and t - state.t <= horizon:
        return False
    state.t = t
    return True


def _judge(rows: DataFrame, verdicts: DataFrame, tie: str, *names: str, tasks: int | None = None) -> DataFrame:
    """The full rows with their verdict."""
    told = dealt(verdicts.select(tie, *names), tie, tasks)
    return dealt(rows, tie, tasks).join(told, tie).select(*rows.columns, *names)


def _open_segments(rows: DataFrame, open_row: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of segments with at least one open row, and the rows of all other segments."""
    rows = checkpoint(rows)
    segments = rows.where(open_row).select("segment").distinct()
    return rows.join(segments, "segment", "left_semi"), rows.join(segments, "segment", "left_anti")


def rate_limit(
    requests: DataFrame,
    key: str,
    t: str,
    tie: str,
    limit: int = rules.RATE_LIMIT,
    window: int = rules.RATE_WINDOW_MS,
    burst: int = rules.BURST_LIMIT,
    burst_window: int = rules.BURST_WINDOW_MS,
    block: int = rules.BLOCK_MS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `verdict` (ok, limited, burst or blocked) and `retry_s`. Times are whole milliseconds.

    Limited calls are recorded and count towards the window, calls during a block are not. A block
    outlasts the window, so after it a key starts afresh: only the chain of bursts is sequential.
    """
    if block < window:
        raise ValueError("a block must last at least one window")
    rows = dense_index(requests.select(key, t, tie), [key, t, tie], "_i")
    rows = checkpoint(
        over_chunks(
            rows,
            "_i",
            max(limit, burst - 1),
            lambda w: {
                "_t_limit": lag_in([key], t, limit, w),
                "_t_burst": lag_in([key], t, burst - 1, w),
            },
            chunk_rows,
        )
    )
    dense = rows.where(F.col(t) - F.col("_t_burst") < burst_window)
    dense = dense.select(key, F.col(t).alias("_t"), F.col("_i").alias("_row"), "_t_burst")
    # a burst that begins after any earlier block has ended does not depend on earlier bursts
    chains = cut_segments(
        dense,
        [key],
        ["_row"],
        ["_t"],
        lambda before: F.col("_t_burst") >= before("_t") + block,
        chunk_rows,
    )
    marked = fold_segments(
        chains, Block, lambda s, now, first: burst_step(s, now, first, block), ["_t", "_t_burst"],
        "_starts", "boolean", chunk_rows,
    )
    # a block matters for rows up to block + window later: its own time slot and the next one
    slot = block + window
    blocks = marked.where("_starts").select(
        key,
        F.explode(F.array(F.floor(F.col("_t") / slot), F.floor(F.col("_t") / slot) + 1)).alias("_slot"),
        F.struct(F.col("_row").alias("row"), (F.col("_t") + block).alias("until")).alias("_b"),
    )
    # blocks are at least `block` apart, so a slot holds a handful of them
    blocks = checkpoint(blocks.groupBy(key, "_slot").agg(F.collect_list("_b").alias("_blocks")))
    seen = rows.withColumn("_slot", F.floor(F.col(t) / slot)).join(blocks, [key, "_slot"], "left")
    last = F.array_max(F.filter("_blocks", lambda b: b["row"] <= F.col("_i")))
    seen = seen.withColumn("_last", last)
    until = F.col("_last.until")
    full = (F.col(t) - F.col("_t_limit") < window) & (until.isNull() | (F.col("_t_limit") >= until))
    verdict = (
        F.when(F.col("_last.row") == F.col("_i"), "burst")
        .when(F.col(t) < until, "blocked")
        .when(full, "limited")
        .otherwise("ok")
    )
    seconds = F.floor((until - F.col(t)) / 1000)
    judged = seen.withColumn("verdict", verdict).withColumn(
        "retry_s", F.when(F.col("verdict") == "blocked", seconds)
    )
    return _judge(requests, judged, tie, "verdict", "retry_s")


def rate_limit_admitted(
    requests: DataFrame,
    key: str,
    t: str,
    tie: str,
    limit: int = rules.ADMIT_LIMIT,
    window: int = rules.RATE_WINDOW_MS,
    chunk_rows: int = CHUNK_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Adds `allowed`: fewer than `limit` admitted calls in the window; rejected ones do not count.

    `tasks` is the number of tasks that join the full rows, the session's if there is none.
    """
    rows = cut_segments(
        requests.select(key, t, tie),
        [key],
        [t, tie],
        [t],
        lambda before: F.col(t) - before(t) >= window,
        chunk_rows,
    )
    rows = over_chunks(
        rows, "idx", limit, lambda w: {"_t_limit": lag_in([key], t, limit, w)}, chunk_rows
    )
    crowded, calm = _open_segments(rows, F.col(t) - F.col("_t_limit") < window)
    folded = fold_segments(
        crowded, Admitted, lambda s, now: admit_step(s, now, limit, window), [t], "allowed", "boolean",
        chunk_rows,
    )
    both = folded.unionByName(calm.withColumn("allowed", F.lit(True)))
    return _judge(requests, both, tie, "allowed", tasks=tasks)


def frame_signature(payload: Column) -> Column:
    """First and last hundred characters of a long payload, else the payload itself."""
    ends = F.concat(F.substring(payload, 1, 100), F.right(payload, F.lit(100)))
    return F.when(F.length(payload) > 200, ends).otherwise(payload)


def throttle_frames(
    frames: DataFrame,
    key: str,
    t: str,
    tie: str,
    payload: str,
    throttle: int = rules.THROTTLE_MS,
    chunk_rows: int = CHUNK_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Adds `accepted`: far enough from the last accepted frame and unlike it.

    `tasks` is the number of tasks that join the full rows, the session's if there is none.

    After a pause of one throttle interval a signature the client has not sent before is accepted
    whatever came earlier, so segments start there.
    """
    signed = frames.select(key, t, tie, frame_signature(F.col(payload)).alias("_sig"))
    firsts = signed.groupBy(key, "_sig").agg(F.min(F.struct(t, tie)).alias("_first"))
    signed = signed.join(firsts, [key, "_sig"]).withColumn(
        "_new", F.struct(t, tie).eqNullSafe(F.col("_first"))
    )
    rows = cut_segments(
        signed.drop("_first"),
        [key],
        [t, tie],
        [t],
        lambda before: F.col("_new") & (F.col(t) - before(t) >= throttle),
        chunk_rows,
    )
    several, single = _open_segments(rows, ~F.col("fresh"))
    folded = fold_segments(
        several, LastFrame, lambda s, now, sig: frame_step(s, now, sig, throttle), [t, "_sig"],
        "accepted", "boolean", chunk_rows,
    )
    both = folded.unionByName(single.withColumn("accepted", F.lit(True)))
    return _judge(frames, both, tie, "accepted", tasks=tasks)


def replay_detection(
    requests: DataFrame,
    nonce: str,
    sent: str,
    received: str,
    tie: str,
    horizon: int = rules.NONCE_MS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `verdict`: ok, missing, stale or replay. A nonce is free again after the horizon."""
    missing = F.coalesce(F.col(nonce) == "", F.lit(True))
    stale = F.abs(F.col(received) - F.col(sent)) > horizon
    narrow = requests.select(nonce, sent, received, tie)
    early = narrow.where(missing | stale).select(
        tie, F.when(missing, "missing").otherwise("stale").alias("verdict")
    )
    rows = cut_segments(
        narrow.where(~missing & ~stale).drop(sent),
        [nonce],
        [received, tie],
        [received],
        lambda before: F.col(received) - before(received) > horizon,
        chunk_rows,
    )
    several, single = _open_segments(rows, ~F.col("fresh"))
    folded = fold_segments(
        several, LastUse, lambda s, now: nonce_step(s, now, horizon), [received], "_ok", "boolean",
        chunk_rows,
    )
    both = folded.unionByName(single.withColumn("_ok", F.lit(True)))
    judged = both.select(tie, F.when(F.col("_ok"), "ok").otherwise("replay").alias("verdict"))
    return _judge(requests, early.unionByName(judged), tie, "verdict")
