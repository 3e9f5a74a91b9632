import random
from collections import deque

from pyspark.sql import functions as F

from cinderleaf.operators import folds, sequence
from cinderleaf.operators.ordered import dense_index, running_max


STEPS = [0, 10, 50, 200, 400, 2_000, 9_000, 61_000, 310_000, 1_900_000]


def calls(seed, n=600, keys=3):
    """One key holds most calls, with bursts, pauses and equal times."""
    rng = random.Random(seed)
    clock = {k: 0 for k in range(keys)}
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.7 else rng.randrange(keys)
        clock[k] += rng.choices(STEPS, weights=[20, 20, 20, 20, 20, 6, 3, 3, 3, 1])[0]
        rows.append((i, f"k{k}", clock[k]))
    return rows


def by_key(rows):
    out = {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(k, []).append((i, t))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t long")


def collect(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_rate_limit(spark):
    rows = calls(1)
    expected = {}
    for events in by_key(rows).values():
        times, until = [], None
        for i, t in events:
            if until is not None and t < until:
                expected[i] = "blocked"
                continue
            times = [x for x in times if t - x < 60_000] + [t]
            if sum(t - x < 5_000 for x in times) >= 20:
                until = t + 300_000
                expected[i] = "burst"
            else:
                expected[i] = "limited" if len(times) > 10 else "ok"
    assert {"burst", "blocked", "limited", "ok"} == set(expected.values())
    got = folds.rate_limit(frame(spark, rows), "k", "t", "id", chunk_rows=50)
    assert collect(got, "verdict") == expected


def test_rate_limit_admitted(spark):
    rows = calls(2)
    expected = {}
    for events in by_key(rows).values():
        times = deque()
        for i, t in events:
            while times and t - times[0] >= 60_000:
                times.popleft()
            expected[i] = len(times) < 30
            if expected[i]:
                times.append(t)
    assert False in expected.values()
    got = folds.rate_limit_admitted(frame(spark, rows), "k", "t", "id", chunk_rows=64)
    assert collect(got, "allowed") == expected


def test_throttle_frames(spark):
    rng = random.Random(3)
    rows = [(i, k, t, f"f{rng.randrange(6)}") for i, k, t in calls(3, 400)]
    expected = {}
    signature = {i: s for i, _, _, s in rows}
    for events in by_key([r[:3] for r in rows]).values():
        last, seen = None, None
        for i, t in events:
            expected[i] = last is None or (t - last >= 1_500 and signature[i] != seen)
            if expected[i]:
                last, seen = t, signature[i]
    df = spark.createDataFrame(rows, "id long, k string, t long, payload string")
    got = folds.throttle_frames(df, "k", "t", "id", "payload", chunk_rows=40)
    assert collect(got, "accepted") == expected


def test_replay_detection(spark):
    rng = random.Random(4)
    rows = []
    for i, k, t in calls(4, 400):
        nonce = rng.choice(["", None, f"{k}n{rng.randrange(9)}", f"{k}n1"])
        rows.append((i, nonce, t - rng.choice([0, 1_000, 400_000]), t))
    expected, last = {}, {}
    for i, nonce, sent, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if not nonce:
            expected[i] = "missing"
        elif abs(t - sent) > 300_000:
            expected[i] = "stale"
        elif nonce in last and t - last[nonce] <= 300_000:
            expected[i] = "replay"
        else:
            expected[i] = "ok"
            last[nonce] = t
    df = spark.createDataFrame(rows, "id long, nonce string, sent long, t long")
    got = folds.replay_detection(df, "nonce", "sent", "t", "id", chunk_rows=33)
    assert collect(got, "verdict") == expected


def test_multi_turn_and_sessions(spark):
    rng = random.Random(5)
    rows = [(i, k, t, rng.choice([0, 0, 20, 30, 100])) for i, k, t in calls(5, 300)]
    score = {r[0]: r[3] for r in rows}
    turns, valid, runs = {}, {}, 0
    for events in by_key([r[:3] for r in rows]).values():
        history, last, alive = deque(maxlen=5), None, True
        for i, t in events:
            if last is not None and t - last > 1_800_000:
                history.clear()
                alive = False
                runs += 1
            last = t
            history.append(i)
            marks = [score[j] for j in history]
            hits, total = sum(m > 0 for m in marks), sum(marks)
            if hits >= 3 or total >= 50:
                turns[i] = "INJECTION_ATTEMPT"
            elif hits >= 2 or total >= 30:
                turns[i] = "SUSPICIOUS"
            else:
                turns[i] = "SAFE"
            valid[i] = alive
        runs += 1
    df = spark.createDataFrame(rows, "id long, k string, t long, score int")
    df = df.withColumn("status", F.when(F.col("score") == 100, "HARMFUL_CONTENT").otherwise("SAFE"))
    got = sequence.multi_turn_escalation(df, "k", "t", "id", chunk_rows=20)
    assert collect(got, "multi_turn") == turns
    assert collect(sequence.session_validity(df, "k", "t", "id", chunk_rows=20), "valid") == valid
    assert sequence.session_segments(df, "k", "t", "id").count() == runs


def test_dense_index_and_running_max(spark):
    rng = random.Random(6)
    values = [rng.randrange(1000) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    indexed = dense_index(df, ["v", "i"])
    got = [(r["v"], r["i"]) for r in sorted(indexed.collect(), key=lambda r: r["idx"])]
    assert got == sorted((v, i) for i, v in enumerate(values))
    marks = F.when(F.col("i") % 37 == 0, F.col("idx"))
    out = running_max(indexed, "idx", marks, "m", chunk_rows=16).collect()
    best = None
    for row in sorted(out, key=lambda r: r["idx"]):
        best = row["idx"] if row["i"] % 37 == 0 else best
        assert row["m"] == best


def test_folds_have_no_single_partition_window(spark):
    from cinderleaf.operators.ordered import over_chunks

    df = dense_index(frame(spark, calls(9, 50)), ["k", "t", "id"])
    plan = over_chunks(df, "idx", 1, lambda w: {"p": F.lag("t").over(w)}, 10)._jdf.queryExecution().toString()
    assert "hashpartitioning(_chunk" in plan and "SinglePartition" not in plan.split("Physical Plan")[1].split("_chunk")[0]
