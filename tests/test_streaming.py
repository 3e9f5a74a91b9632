import random
import tempfile

from pyspark.sql import functions as F

from cinderleaf.operators import folds, sequence
from cinderleaf.plans import dishes
from cinderleaf.plans.requests import guard_audit, guard_requests, screen_prompts, scrub_responses
from cinderleaf.streaming import jobs


def rows(seed, n=250):
    rng = random.Random(seed)
    clock, out = 0, []
    for i in range(n):
        clock += rng.choice([1, 30, 200, 900, 4_000, 70_000 if i % 50 == 0 else 100])
        out.append((i, f"k{rng.randrange(3)}", clock, f"f{rng.randrange(5)}"))
    return out


def replay(spark, df, parts, build):
    """Writes the rows in time order as files and runs the stream over them, stopping once in between."""
    source, target, state = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    n = df.count()
    step = -(-n // parts)
    for p in range(parts):
        df.where((F.col("id") >= p * step) & (F.col("id") < (p + 1) * step)).coalesce(1).write.mode("append").parquet(source)
        if p in (0, parts - 1):
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
            jobs.append_stream(build(stream), target, state, once=True).awaitTermination()
    return {r["id"]: r["verdict"] for r in spark.read.json(target).collect()}


def test_rate_limit_stream_equals_table(spark):
    df = spark.createDataFrame(rows(1), "id long, k string, t long, payload string")
    table = {r["id"]: r["verdict"] for r in folds.rate_limit(df, "k", "t", "id").collect()}
    assert replay(spark, df, 3, lambda s: jobs.rate_limit_stream(s, "k", "t", "id")) == table


def test_admission_and_throttle_streams_equal_tables(spark):
    df = spark.createDataFrame(rows(2), "id long, k string, t long, payload string")
    allowed = {r["id"]: "ok" if r["allowed"] else "limited" for r in folds.rate_limit_admitted(df, "k", "t", "id").collect()}
    assert replay(spark, df, 2, lambda s: jobs.admission_stream(s, "k", "t", "id")) == allowed
    taken = folds.throttle_frames(df, "k", "t", "id", "payload")
    expected = {r["id"]: "ok" if r["accepted"] else "skipped" for r in taken.collect()}
    assert replay(spark, df, 2, lambda s: jobs.throttle_stream(s, "k", "t", "id", "payload")) == expected


def test_replay_stream_equals_table(spark):
    df = spark.createDataFrame(rows(3), "id long, k string, t long, payload string").withColumn("sent", F.col("t") - 5)
    expected = {r["id"]: r["verdict"] for r in folds.replay_detection(df, "payload", "sent", "t", "id").collect()}
    assert replay(spark, df, 2, lambda s: jobs.replay_stream(s, "payload", "sent", "t", "id")) == expected


def test_state_goes_by_event_time(spark):
    """Every client calls once; their states go when the watermark has passed, and the query ends."""
    df = spark.createDataFrame([(i, f"k{i}", (i + 1) * 60_000) for i in range(120)], "id long, k string, t long")
    source, target, state = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for p in range(4):
        df.where((F.col("id") >= 30 * p) & (F.col("id") < 30 * p + 30)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = jobs.append_stream(jobs.rate_limit_stream(stream, "k", "t", "id", "1 minute"), target, state, once=True)
    assert query.awaitTermination(120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < 20 and spark.read.json(target).where("verdict = 'ok'").count() == 120


def guard_rows(seed, n=160):
    rng = random.Random(seed)
    texts = ["hello there", "system prompt", "please act as my guide", "how to make a bomb", "x" * 9000]
    clock, out = 0, []
    for i in range(n):
        clock += rng.choice([5, 40, 300, 2_000, 30_000])
        session = None if rng.random() < 0.1 else f"s{rng.randrange(4)}"
        out.append((i, f"ip{rng.randrange(3)}", session, clock, rng.choice(texts), rng.choice(["ok", "mail me at a.b@example.com", None])))
    return out


GUARDED = ["id", "verdict", "too_long", "multi_turn", "outcome", "final_status", "response"]


def test_guard_stream_equals_table_over_restarts(spark):
    df = spark.createDataFrame(guard_rows(6), "id long, ip string, s string, t long, text string, response string")
    table = scrub_responses(guard_requests(df, "id", "ip", "s", "t", "text"), "response")
    expected = sorted(map(tuple, table.select(GUARDED).collect()))
    audited = sorted((r["id"], r["pos"], r["threat_level"]) for r in guard_audit(table, "id", "ip", "t", "/api").collect())
    source, target, state = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for p in range(3):
        df.where(F.floor(F.col("id") / 54) == p).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        guarded = jobs.guard_stream(stream, "id", "ip", "s", "t", "text", "response")
        jobs.write_guarded(guarded, "id", "ip", "t", "/api", target, state, once=True).awaitTermination()
    got = spark.read.parquet(f"{target}/requests").select(GUARDED).collect()
    assert sorted(map(tuple, got)) == expected
    rows = spark.read.parquet(f"{target}/audit").collect()
    assert sorted((r["id"], r["pos"], r["threat_level"]) for r in rows) == audited


def scan_rows(seed, n=120):
    rng = random.Random(seed)
    clock, out = 0, []
    for i in range(n):
        clock += rng.choice([20, 100, 400, 1_600])
        mode = rng.choice(["normal", "normal", "health_tourist", "please bypass it"])
        out.append((i, rng.randrange(2), clock, f"img{rng.randrange(6)}", mode, "en", rng.choice(["Kottu", "Rice"]), rng.random()))
    return out


SCAN = "scan_id long, client_id int, t_ms long, payload string, mode string, lang string, dish_name string, confidence double"


def test_dish_stream_equals_table_and_replays_alike(spark):
    df = spark.createDataFrame(scan_rows(9), SCAN)
    parts = [(i, k, rng) for i in range(120) for k, rng in enumerate(["white rice", "dhal curry"][: 1 + i % 2])]
    components = spark.createDataFrame(parts, "scan_id long, pos int, name string")
    foods = spark.createDataFrame([(0, "rice", 130, 2.7, 28.0, 0.3)], "prio int, name string, calories int, protein double, carbs double, fat double")
    shown = ["scan_id", "outcome", "calories", "protein_g", "recommendation", "badge_color", "label"]
    table = dishes.scan_dishes(df, components, foods).select(shown)
    expected = sorted(map(str, table.collect()))
    assert {r["outcome"] for r in table.collect()} == {"rate_limited", "injection", "accepted", "skipped"}
    source, target, state = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    for p in range(2):
        df.where(F.floor(F.col("scan_id") / 60) == p).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        answered = jobs.scan_stream(stream, "scan_id", "client_id", "t_ms", "payload", "mode")
        jobs.write_dishes(answered, components, foods, "scan_id", "mode", target, state, once=True).awaitTermination()
    stored = jobs.read_upserts(spark, target, "scan_id").select(shown)
    assert sorted(map(str, stored.collect())) == expected
    # a batch that is run again, and one with a changed scan
    first = spark.read.parquet(f"{target}/batch=0")
    again = spark.createDataFrame(first.collect(), first.schema)
    jobs.upsert_batch(again, 0, target)
    jobs.upsert_batch(again, 0, target)
    assert sorted(map(str, jobs.read_upserts(spark, target, "scan_id").select(shown).collect())) == expected
    changed = spark.createDataFrame(again.limit(1).collect(), first.schema).withColumn("label", F.lit("new"))
    jobs.upsert_batch(changed, 999, target)
    rows = jobs.read_upserts(spark, target, "scan_id").collect()
    assert len(rows) == 120 and sum(r["label"] == "new" for r in rows) == 1


def test_multi_turn_stream_equals_table(spark):
    rng = random.Random(4)
    texts = ["system prompt", "hello", "please act as my guide", "how to make a bomb"]
    data = [(i, k, t * 20, rng.choice(texts)) for i, k, t, _ in rows(4, 120)]
    df = spark.createDataFrame(data, "id long, k string, t long, text string")
    scored = screen_prompts(df, "text", "assistant", "Assistant", frozenset({1, 8}))
    table = sequence.multi_turn_escalation(scored, "k", "t", "id")
    expected = {r["id"]: r["multi_turn"] for r in table.collect()}
    assert replay(spark, df, 2, lambda s: jobs.multi_turn_stream(s, "k", "t", "id", "text")) == expected


def test_late_rows_are_reported(spark):
    df = spark.createDataFrame([(0, "a", 5_000), (1, "a", 9_000)], "id long, k string, t long")
    late = spark.createDataFrame([(2, "a", 1_000), (3, "a", 9_500)], "id long, k string, t long")
    both = df.unionByName(late)
    got = replay(spark, both, 2, lambda s: jobs.rate_limit_stream(s, "k", "t", "id"))
    assert got == {0: "ok", 1: "ok", 2: "late", 3: "ok"}


def test_sessions_nonces_and_alerts(spark):
    source, out, state = (tempfile.mkdtemp(prefix="run-") for _ in range(3))
    data = [(i, "u", f"2024-01-01 0{i}:00:00", f"n{i % 2}", "HIGH" if i % 2 else "INFO") for i in range(6)]
    df = spark.createDataFrame(data, "id long, k string, ts string, nonce string, threat_level string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    seen = []
    jobs.notify(jobs.alerts(stream), lambda batch, _: seen.extend(r["id"] for r in batch.collect()), state, once=True).awaitTermination()
    assert sorted(seen) == [1, 3, 5]
    jobs.append_stream(jobs.sessions_stream(stream, "k", "ts"), out, tempfile.mkdtemp(prefix="run-"), once=True).awaitTermination()
    closed = spark.read.json(out).collect()
    assert closed and all(r["events"] == 1 for r in closed)
    unique = tempfile.mkdtemp(prefix="run-")
    jobs.append_stream(jobs.fresh_nonces(stream, "nonce", "ts"), unique, tempfile.mkdtemp(prefix="run-"), once=True).awaitTermination()
    assert spark.read.json(unique).count() >= 2
