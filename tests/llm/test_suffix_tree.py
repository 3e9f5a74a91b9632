"""Word counts and chances against plain sums."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cinderleaf.llm import suffix_tree, wordhash
from cinderleaf.llm.suffix_tree import score_texts
from cinderleaf.session import ensure_checkpoint_dir
from tests.llm.helpers import words

SCHEMA = "doc_id long, text string, row string, key string, rare string, n string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in data], SCHEMA)


def corpus():
    chance = random.Random(3)
    names = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(250):
        out = chance.choices(names, weights, k=chance.randrange(0, 60))
        if i % 3 == 0:  # a phrase that its first words give away
            out += ["Once", "upon", "a", "TIME"] * 3
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("frequent", [1 << 19, 20, 0])
def test_baseline_and_chances(spark, frequent):
    rows = corpus() + [(1000, None), (1001, ""), (None, "w1 w2"), (1002, "never seen before " * 9), (5, "w1 w1")]
    got = score_texts(frame(spark, rows), frequent=frequent).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    counts: Counter = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in rows:
        tokens = [*words(t), "\n"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        expected[i, held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    seen = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got
    )
    assert seen == expected
    own = [r for r in got if r["held_out"]]
    phrase = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 250 and r["doc_id"] % 3 == 0 and r["n_tokens"] < 25]
    if frequent >= 300:  # with no frequent word there is no context either
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
        assert all(r["score"] > r["base_score"] for r in phrase)


def test_chances_of_all_continuations_add_up_to_one(spark):
    """The texts "x", one for every known word x, for the unknown word and for none, share all chance.

    P(x, end) = P(x after the begin) * P(end after x), so only the first factor is summed: two texts
    that differ in their second word give it.
    """
    train = [(i, "a b a c" if i % 2 else "a b b") for i in range(700)]
    known = ["a", "b", "c", "zzz"]
    held = [i for i in range(2000, 4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = [(held[j], f"a {w}") for j, w in enumerate([*known])] + [(held[9], "a")]
    more = [(held[20 + j * 5 + k], f"a {w} {x}") for j, w in enumerate(known) for k, x in enumerate(known)]
    got = {r["doc_id"]: r["score"] for r in score_texts(frame(spark, train + asked + more)).collect() if r["held_out"]}
    # P(begin a ...) = sum of all texts that go on after a: end, or w and then end or x ...
    first = 10 ** got[held[9]]
    total = first
    for j, _ in enumerate(known):
        total += 10 ** got[held[j]]
    assert 0 < total < 1


def test_nothing_to_learn_from(spark):
    assert score_texts(frame(spark, [])).collect() == []
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_texts(frame(spark, [(lone, "some words")])).collect()[0]
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)


def plain_scores(rows, held, depth, least):
    """Scores by a suffix tree of plain dictionaries."""
    streams = {i: ["\n", *words(t), "\n"] for i, t in rows}
    single, after = Counter(), {}
    for i, _ in rows:
        if held[i]:
            continue
        s = streams[i]
        single.update(s[1:])
        for at in range(1, len(s)):
            for d in range(1, min(depth, at) + 1):
                after.setdefault(tuple(s[at - d : at]), Counter())[s[at]] += 1
    tokens = sum(single.values())
    once, twice = (sum(n == k for n in single.values()) for k in (1, 2))
    discount = min(0.9, max(0.1, once / (once + 2 * twice)))
    alone = {w: (n - discount) / tokens for w, n in single.items()}
    unknown = discount * len(single) / tokens
    chances, left, states = {}, {}, set()
    for c in sorted((c for c in after if sum(after[c].values()) >= least), key=len):
        total, kept = sum(after[c].values()), {w: n for w, n in after[c].items() if n > 1}
        left[c] = max(1 - sum(n - 0.75 for n in kept.values()) / total, 1e-12)
        before = {w: alone[w] if len(c) == 1 else chances[c[1:]][w] for w in kept}
        chances[c] = {w: (n - 0.75) / total + left[c] * before[w] for w, n in kept.items()}
        gain = sum(p * math.log(p / before[w]) for w, p in chances[c].items())
        rest, rest_before = max(1 - sum(chances[c].values()), 1e-12), max(1 - sum(before.values()), 1e-12)
        if kept and gain + rest * math.log(rest / rest_before) >= 0.01:
            states |= {c[k:] for k in range(len(c))}

    def chance(c, w):
        if not c:
            return alone.get(w, unknown)
        return chances[c][w] if w in chances[c] else left[c] * chance(c[1:], w)

    out = {}
    for i, s in streams.items():
        out[i] = 0.0
        for at in range(1, len(s)):
            state = max((c for d in range(depth + 1) if d <= at and ((c := tuple(s[at - d : at])) in states or not c)), key=len)
            out[i] += math.log10(chance(state, s[at]))
    return out, states


@pytest.mark.parametrize("frequent", [1 << 19, 20])
def test_rare_contexts_count_like_a_plain_tree(spark, frequent):
    """Words and passages far below a ten thousandth of the tokens are states, by whatever way they are found."""
    chance = random.Random(5)
    rows = [(i, " ".join(chance.choices([f"w{j}" for j in range(40)], k=150))) for i in range(400)]
    passage = "seldom heard words that follow one another here"
    rows += [(1000 + i, f"{passage} w{i}" if i % 2 else f"{passage} {passage}") for i in range(6)]
    rows += [(2000 + i, "the very same line of text") for i in range(30)] + [(3000, None), (3001, "nowhere else seldom")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    expected, states = plain_scores(rows, held, 3, 3)
    assert ("seldom", "heard") in states and {len(c) for c in states} == {1, 2, 3}
    got = score_texts(frame(spark, rows), depth=3, least=3, frequent=frequent)
    assert {r["doc_id"]: round(r["score"], 6) for r in got.collect()} == {i: round(x, 6) for i, x in expected.items()}


def test_blocks_give_their_rows_back_smaller():
    """A block takes a fraction of its rows, whatever their order, and no bucket gets rows of another."""
    chance = np.random.default_rng(7)
    code, after = chance.integers(1, 5000, 60_000), chance.integers(-(1 << 63), 1 << 63, 60_000)
    after[: 50_000] = chance.integers(1, 5000, 50_000)
    buckets = suffix_tree.bucket_of(wordhash.mix(code.view(np.uint64)), 7)
    blocks = suffix_tree.packed(buckets, [code, after, np.ones(60_000, np.int64)])
    assert sorted(blocks.column("bucket").to_pylist()) == list(range(7))
    told = []
    for bucket, size, data in zip(*(c.to_pylist() for c in blocks.columns), strict=True):
        columns = suffix_tree.unpacked(size, data, 3)
        assert set(suffix_tree.bucket_of(wordhash.mix(columns[0].view(np.uint64)), 7).tolist()) == {bucket}
        told += zip(*(c.tolist() for c in columns), strict=True)
    assert sorted(told) == sorted(zip(code.tolist(), after.tolist(), [1] * 60_000, strict=True))
    assert sum(len(d) for d in blocks.column("data").to_pylist()) < 6 * 60_000


def test_only_the_tables_of_the_answer_and_its_shuffles_stay(spark):
    """What the steps of the tree write and shuffle is gone when the scores are read."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {t for t in os.listdir(folder) if t.startswith("table-")}
    before = tables()
    scores = score_texts(frame(spark, corpus()))
    assert len(tables() - before) == 2  # the words and the tree
    assert scores.count() == 250
