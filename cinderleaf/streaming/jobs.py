"""Streaming forms of the request, prompt, frame, session and alert operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions.guard import payload_intent_ok
from cinderleaf.operators.audit import alert_stream
from cinderleaf.operators.folds import frame_signature
from cinderleaf.plans.dishes import answer_scans
from cinderleaf.plans.requests import guard_audit, screen_prompts, scrub_responses, with_outcome
from cinderleaf.streaming import processors

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state outgrows the heap on long-running streams, so it is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def by_event_time(stream: DataFrame, t: str, late: str) -> DataFrame:
    """Adds `event_time` from whole milliseconds, with a watermark; Spark drops rows behind it and counts them."""
    return stream.withColumn("event_time", F.timestamp_millis(t)).withWatermark("event_time", late)


def _keyed(
    stream: DataFrame,
    processor: type,
    key: str,
    t: str,
    tie: str,
    extra: list[Column],
    keep_ms: int | None,
    late: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, tie, carried columns, verdict) of a processor whose state lives `keep_ms` of event time, or for ever."""
    use_rocksdb(stream.sparkSession)
    timed = stream if "event_time" in stream.columns else by_event_time(stream, t, late)
    names = [key, tie, *carry]
    rows = timed.select(*dict.fromkeys([*names, t, "event_time"]), *extra)
    kinds = dict(rows.dtypes)
    shown = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    chained = "event_time" in carry
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor(key, t, tie, keep_ms, carry),
        outputStructType=f"{shown}, verdict string",
        outputMode="append",
        timeMode="EventTime" if keep_ms is not None or chained else "None",
        eventTimeColumnName="event_time" if chained else "",
    )


LATE = "10 minutes"


def rate_limit_stream(requests: DataFrame, key: str, t: str, tie: str, late: str = LATE, carry: Sequence[str] = ()) -> DataFrame:
    """(key, tie, verdict) with verdict ok, limited, burst, blocked or late.

    A client is forgotten once a block and a window have passed since its newest call.
    """
    keep = rules.BLOCK_MS + rules.RATE_WINDOW_MS
    return _keyed(requests, processors.RateLimit, key, t, tie, [], keep, late, carry)


def admission_stream(requests: DataFrame, key: str, t: str, tie: str, late: str = LATE, carry: Sequence[str] = ()) -> DataFrame:
    return _keyed(requests, processors.Admission, key, t, tie, [], rules.RATE_WINDOW_MS, late, carry)


def throttle_stream(
    frames: DataFrame, key: str, t: str, tie: str, payload: str, keep_ms: int | None = None, late: str = LATE
) -> DataFrame:
    """Verdicts ok, skipped or late. The rule compares with the last frame however old, so state stays by default."""
    signature = frame_signature(F.col(payload)).alias("signature")
    return _keyed(frames, processors.FrameThrottle, key, t, tie, [signature], keep_ms, late)


def replay_stream(requests: DataFrame, nonce: str, sent: str, received: str, tie: str, late: str = LATE) -> DataFrame:
    """Verdicts of requests with a nonce and a fresh time stamp; see `refused_early` for the others.

    Every nonce is a key of its own, so its state goes once no request could still repeat it.
    """
    usable = requests.where(~_refused(nonce, sent, received))
    return _keyed(usable, processors.NonceGuard, nonce, received, tie, [], rules.NONCE_MS + 1, late)


def refused_early(requests: DataFrame, nonce: str, sent: str, received: str) -> DataFrame:
    """Requests without a nonce or with a stale time stamp; no state is needed for them."""
    missing = F.coalesce(F.col(nonce) == "", F.lit(True))
    verdict = F.when(missing, "missing").otherwise("stale")
    return requests.where(_refused(nonce, sent, received)).withColumn("verdict", verdict)


def _refused(nonce: str, sent: str, received: str) -> Column:
    missing = F.coalesce(F.col(nonce) == "", F.lit(True))
    return missing | (F.abs(F.col(received) - F.col(sent)) > rules.NONCE_MS)


def fresh_nonces(requests: DataFrame, nonce: str, ts: str) -> DataFrame:
    """First use of each nonce within the horizon, by event time; later uses are dropped."""
    delay = f"{rules.NONCE_MS // 1000} seconds"
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark([nonce])


def multi_turn_stream(
    prompts: DataFrame, session: str, t: str, tie: str, text: str, assistant: str = "assistant", late: str = LATE
) -> DataFrame:
    """(session, tie, verdict) of screened prompts; a session is forgotten after its idle time."""
    screened = screen_prompts(prompts, text, assistant, assistant, frozenset({1, 8}))
    extra = [F.col("score"), F.col("status")]
    keep = rules.SESSION_IDLE_MS + 1
    return _keyed(screened.where("NOT too_long"), processors.MultiTurn, session, t, tie, extra, keep, late)


def guard_stream(
    requests: DataFrame, request_id: str, ip: str, session: str, t: str, prompt: str, response: str,
    assistant: str = "assistant", display: str = "Assistant", late: str = LATE,
) -> DataFrame:
    """The request guard as one query: rate limit by client, screening, turns by session, response scrub.

    Two stateful steps in a row, both on the watermark of `t`. Returns the columns of `guard_requests` that
    `guard_audit` reads (retry_s is null) and `response` without personal data for allowed requests only. A call
    older than the newest of its client is `late` in `verdict` and counts as rate limited; a prompt older than the
    newest of its session is `late` in `multi_turn` and judged alone.
    """
    timed = by_event_time(requests, t, late)
    carried = [session, t, prompt, response, "event_time"]
    limited = rate_limit_stream(timed, ip, t, request_id, late, carried).withColumnRenamed("verdict", "limit")
    screened = screen_prompts(limited, prompt, assistant, display, frozenset({1, 8}))
    counted = (F.col("limit") == "ok") & ~F.col("too_long") & F.col(session).isNotNull()
    # rows outside a history are dealt by their own id, so that no key gathers them
    own = F.concat(F.lit("-"), F.col(request_id).cast("string"))
    keyed = screened.withColumns(
        {"counted": counted, "turn_key": F.when(counted, F.concat(F.lit("+"), F.col(session).cast("string"))).otherwise(own)}
    )
    carried = [ip, session, t, "clean", response, "event_time", "limit", "too_long", "hijack", "score", "status", "counted"]
    turns = _keyed(
        keyed, processors.MultiTurn, "turn_key", t, request_id, [], rules.SESSION_IDLE_MS + 1, late, carried
    ).withColumnsRenamed({"verdict": "multi_turn", "limit": "verdict"})
    settled = F.when(F.col("multi_turn") == "late", "SAFE").otherwise(F.col("multi_turn"))
    judged = with_outcome(turns.withColumn("retry_s", F.lit(None).cast("long")), settled)
    return scrub_responses(judged, response).drop("turn_key", "counted", "event_time")


def sessions_stream(events: DataFrame, session: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Closed activity runs per session: start, end of the idle time-out, events."""
    gap = f"{rules.SESSION_IDLE_MS // 60_000} minutes"
    runs = events.withWatermark(ts, late).groupBy(session, F.session_window(ts, gap).alias("w"))
    return runs.agg(F.count("*").alias("events")).select(
        session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"
    )


def alerts(log: DataFrame) -> DataFrame:
    """HIGH and CRITICAL audit rows of a stream."""
    return alert_stream(log)


def notify(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a query that hands every micro-batch to `sink`."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that appends JSON records to a folder."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


def scan_stream(
    scans: DataFrame, scan: str, client: str, t: str, payload: str, mode: str, late: str = LATE
) -> DataFrame:
    """`scans` with `outcome` as `admit_scans` gives it: two stateful steps by client with the intent check between.

    A call older than the newest of its client is `rate_limited`, a frame older than the newest one is `skipped`.
    """
    rest = [c for c in scans.columns if c not in (client, scan)]
    timed = by_event_time(scans, t, late)
    admitted = admission_stream(timed, client, t, scan, late, [*rest, "event_time"])
    admitted = admitted.withColumnRenamed("verdict", "admission").withColumns(
        {"safe": payload_intent_ok(F.col(mode)), "signature": frame_signature(F.col(payload))}
    )
    admitted = admitted.withColumn("counted", (F.col("admission") == "ok") & F.col("safe"))
    carried = [*rest, "admission", "safe", "counted", "signature", "event_time"]
    frames = _keyed(admitted, processors.FrameThrottle, client, t, scan, [], None, late, carried)
    outcome = (
        F.when(F.col("admission") != "ok", "rate_limited")
        .when(~F.col("safe"), "injection")
        .when(F.col("verdict") == "ok", "accepted")
        .otherwise("skipped")
    )
    return frames.select(*scans.columns, outcome.alias("outcome"))


def upsert_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """Writes a batch under its id; the same batch again overwrites itself."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def read_upserts(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last version of every key over all batches that were written."""
    rows = spark.read.parquet(target)
    names = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("last"))
    return last.select("last.*").select(*names)


def write_dishes(
    scans: DataFrame, components: DataFrame, foods: DataFrame, scan: str, mode: str, target: str, checkpoint: str,
    once: bool = False,
):
    """Starts a query that answers the accepted scans of `scan_stream` from static tables and upserts them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(answer_scans(batch, components, foods, scan, mode), batch_id, target)

    return notify(scans, store, checkpoint, once)


def write_guarded(guarded: DataFrame, request_id: str, ip: str, t: str, endpoint: str, target: str, checkpoint: str, once: bool = False):
    """Starts a query that writes what the guard decided and its audit rows, one folder per batch id each.

    A batch that is run again after a failure overwrites its own folders, so nothing is written twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{target}/requests/batch={batch_id}")
        rows = guard_audit(batch, request_id, ip, t, endpoint)
        rows.write.mode("overwrite").parquet(f"{target}/audit/batch={batch_id}")
        batch.unpersist()

    return notify(guarded, store, checkpoint, once)
