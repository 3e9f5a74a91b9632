import math
import random

import pytest

from cinderleaf.operators.sequence import amplitude_points

ROWS = "clip string, i int, value double"


def samples(seed=5):
    """Clips of many sizes in any order, with a null clip, null values, gaps and a sample that comes twice."""
    rng = random.Random(seed)
    rows = [(f"c{n}", i, rng.uniform(-1, 1)) for n in (1, 39, 40, 41, 79, 80, 173) for i in range(n)]
    rows += [("gaps", 3 * i, 0.25) for i in range(90)] + [("none", 0, None), (None, 0, 0.5)]
    rng.shuffle(rows)
    return rows


def plainly(rows, mode):
    clips = {}
    for clip, i, value in rows:
        clips.setdefault(clip, []).append((i, value))
    out = []
    for clip, own in clips.items():
        step = max(1, len(own) // 40)
        for pos in range(40):
            if mode == "mean":
                near = [abs(v) for i, v in own if i // step == pos and v is not None]
                shown = min(1.0, max(0.01, sum(near) / len(near) * 6)) if near else 0.01
            else:
                near = [abs(v) for i, v in own if i == pos * step and v is not None]
                shown = near[0] if near else 0.0
            lost = 0.01 if mode == "mean" else 0.0
            out.append((clip, pos, lost if clip is None else shown))
    return sorted(out, key=str)


@pytest.mark.parametrize("mode", ["point", "mean"])
@pytest.mark.parametrize("clips", [1, 1000])
def test_amplitudes_equal_a_plain_restatement(spark, mode, clips):
    rows = samples()
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = sorted(map(tuple, amplitude_points(df, "clip", "i", "value", mode=mode, clips=clips).collect()), key=str)
    want = plainly(rows, mode)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(math.isclose(g[2], w[2], abs_tol=5.1e-4) for g, w in zip(got, want, strict=True))


def test_a_sample_that_comes_twice_is_shown_twice(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 0, 0.25)], ROWS)
    got = amplitude_points(df, "clip", "i", "value").where("pos = 0").collect()
    assert sorted(r["amplitude"] for r in got) == [0.25, 0.5]


def test_samples_are_neither_sorted_nor_shuffled_for_their_size(spark):
    df = spark.createDataFrame(samples(), ROWS)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(kept, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        for clips, join in ((1000, "BroadcastHashJoin"), (1, "ShuffledHashJoin")):
            found = amplitude_points(df, "clip", "i", "value", mode="mean", clips=clips)
            text = found._jdf.queryExecution().executedPlan().toString()
            # the samples' join is the one by the clip alone
            by_clip = [line for line in text.splitlines() if "Join [clip" in line and ", pos" not in line]
            assert [join in line for line in by_clip] == [True]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
