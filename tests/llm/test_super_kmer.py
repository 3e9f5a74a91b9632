import random
import re

import numpy as np
import pytest

from cinderleaf.llm import super_kmer, wordhash
from cinderleaf.llm.queries import ORACLES, QUERIES

NONE = np.zeros(0, np.uint64)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows):
    """(id, n_words, n_removed, kept) of every row, by looking at all windows."""
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, text in rows:
        w = words_of(text)
        for k in range(len(w) - 12):
            t = tuple(w[k : k + 13])
            least[t] = min(key(i), least.get(t, float("inf")))
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < key(i) for j in range(k, k + 13)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def made(seed, n=300):
    """Texts that share passages, a phrase in a third of them, copies, loops and letter case."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages, phrase = [say(40) for _ in range(5)], say(5)
    rows = []
    for i in rng.sample(range(10 * n), n):
        w = say(rng.randrange(40))
        if rng.random() < 0.4:
            w += rng.choice(passages)[rng.randrange(20) :] + say(3)
        if rng.random() < 0.33:
            w += phrase + say(15)
        if rng.random() < 0.1:
            w += say(3) * 12
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(20_000 + k, rows[0][1]) for k in range(n // 3)] + [(30_000, rows[1][1].upper())]
    return rows


def found(spark, rows, parts=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.repartition(parts) if parts else docs
    return sorted(map(tuple, super_kmer.remove_repeats(docs).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    rows = made(seed)
    assert found(spark, rows, 3) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(13)), " ".join(f"b{k}" for k in range(20))
    long = " ".join(f"c{k % 1000}" for k in range(50_000))
    rows = [(None, a), (None, a), (5, a), (5, b), (5, b), (3, None), (3, ""), (3, " \n"), (4, "one two"), (9, b + " x " + a), (8, long), (7, long)]
    assert found(spark, rows) == sorted(plain(rows), key=str)
    docs = spark.createDataFrame([(1, "x", "y", 2)], "doc_id long, text string, check string, ranges int")
    assert [tuple(r) for r in super_kmer.remove_repeats(docs).collect()] == [(1, 1, 0, "x")]
    assert super_kmer.remove_repeats(docs.limit(0)).count() == 0


def test_strings_hold_every_window_once_and_copies_stay_at_home():
    rows = made(3)
    import pyarrow as pa

    texts, ids = pa.array([t for _, t in rows]), np.array([i for i, _ in rows])
    strings, least, travel, covered, n = super_kmer.slice_strings(ids, ids * 0, texts, NONE)
    windows = sum(max(0, len(words_of(t)) - 12) for _, t in rows)
    assert (n - 12).sum() == windows
    assert n.sum() < 5 * windows
    spelled = [strings.data[a:b].tobytes() for a, b in zip(strings.offsets, strings.offsets[1:])]
    smallest = {}
    for k, t in enumerate(spelled):
        smallest[t] = min(smallest.get(t, 1 << 60), int(strings.ids[k]))
    assert all((strings.ids[k] == smallest[spelled[k]]) == bool(travel[k]) for k in range(len(spelled)))
    assert set(covered.tolist()) == set(np.flatnonzero(~travel).tolist())
    stored = super_kmer.Strings.read(strings.stored(3, 9))
    assert stored.ids.tolist() == strings.ids[3:9].tolist()
    assert stored.data.tobytes() == strings.data[strings.offsets[3] : strings.offsets[9]].tobytes()


def test_frequent_runs_lose_to_rarer_ones():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    plain = super_kmer.minimisers(words, NONE)
    hot = np.unique(plain)[:1]
    ranked = super_kmer.minimisers(words, hot)
    assert hot[0] not in ranked.tolist()
    assert (plain != hot[0]).sum() == (plain == ranked).sum()


def test_equal_hashes_of_other_words(monkeypatch):
    """Windows are told apart by their words where hashes agree."""
    import pyarrow as pa

    monkeypatch.setattr(super_kmer, "_sums", lambda words, n, seed: np.ones(max(0, len(words) - n + 1), np.uint64))
    a, b = (" ".join(f"{c}{k:02}" for k in range(13)) for c in "ab")
    data, offsets = wordhash.text_bytes(pa.array([a, b, a]))
    strings = super_kmer.Strings(np.array([2, 1, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64), data, offsets)
    assert [x.tolist() for x in super_kmer.repeated_windows(strings)] == [[2], [0]]


def test_query_equals_all_windows(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in plain([tuple(d) for d in docs])}
    assert {tuple(r) for r in QUERIES["op12_super_kmer_dedup"](spark, sf).collect()} == expected
    assert "op12_super_kmer_dedup" in ORACLES
