"""The chain against sums over all paths, and languages of held-out and code-switched texts."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cinderleaf.llm import crf_language, wordhash
from cinderleaf.llm.crf_language import identify, keep_identified, marginals, train

SOUNDS = {"aa": ["lo", "mi", "ra", "ta"], "bb": ["kech", "strg", "pfun", "dtz"], "cc": ["ñu", "éo", "ção", "üi"]}
SCHEMA = "doc_id long, text string, lang string, source string, id string, letters string, shares string"


def prose(chance, lang, n):
    return " ".join("".join(chance.choice(SOUNDS[lang]) for _ in range(chance.randrange(1, 4))) for _ in range(n))


def rows(n=240):
    chance = random.Random(2)
    langs = list(SOUNDS)
    return [(i, prose(chance, langs[i % 3], chance.randrange(5, 120)), langs[i % 3]) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "s", "x", "y", "z") for r in data], SCHEMA)


@pytest.mark.parametrize("chunk", [1, 2, 48])
def test_marginals_equal_sums_over_paths(monkeypatch, chunk):
    monkeypatch.setattr(crf_language, "CHUNK", chunk)
    chance = np.random.default_rng(0)
    counts, k = [3, 0, 1, 5, 2], 3
    first = np.concatenate([[0], np.cumsum(counts)])
    scores, moves = chance.normal(size=(first[-1], k)) * 2, chance.normal(size=(k, k))
    got = marginals(scores, first, moves)
    for a, b in zip(first[:-1], first[1:], strict=True):
        expected = np.zeros((b - a, k))
        for path in itertools.product(range(k), repeat=int(b - a)):
            weight = sum(scores[a + t, c] for t, c in enumerate(path))
            weight += sum(moves[x, y] for x, y in itertools.pairwise(path))
            for t, c in enumerate(path):
                expected[t, c] += np.exp(weight)
        if b > a:
            assert np.allclose(got[a:b], expected / expected.sum(axis=1, keepdims=True))


def test_held_out_and_switched_texts(spark):
    data = rows()
    chance = random.Random(5)
    mixed = prose(chance, "aa", 30) + " " + prose(chance, "bb", 60) + " " + prose(chance, "cc", 20)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !? 4", None), (1003, mixed, None), (None, data[0][1], None)]
    got = {r["doc_id"]: r for r in identify(frame(spark, data + odd)).collect()}
    assert len(got) == len(data) + len(odd)
    right = [got[i]["lang_pred"] == lang for i, _, lang in data if got[i]["held_out"]]
    assert len(right) > 30 and sum(right) >= 0.97 * len(right)
    for i, _, _ in data:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    switched = got[1003]
    assert switched["lang_pred"] == "bb" and switched["n_switches"] >= 2
    assert abs(switched["shares"]["bb"] - 60 / 110) < 0.12
    assert got[None]["lang_pred"] == data[0][2]


def test_words_are_labelled_along_the_chain(spark):
    docs = frame(spark, rows()).selectExpr("doc_id AS id", "text", "lang")
    model = train(docs)
    chance = random.Random(8)
    text = prose(chance, "aa", 25) + " " + prose(chance, "cc", 25)
    data, offsets = wordhash.text_bytes(pa.array([text]))
    starts, stops = wordhash.word_spans(data, offsets)
    numbers, first, _ = crf_language.word_features(data, starts, stops)
    found = marginals(crf_language.word_scores(model.weights, numbers, first), np.array([0, len(starts)]), model.moves)
    named = [model.languages[c] for c in found.argmax(axis=1)]
    assert sum(n == w for n, w in zip(named, ["aa"] * 25 + ["cc"] * 25, strict=True)) >= 46


def test_nothing_to_learn_from(spark):
    assert identify(frame(spark, [])).collect() == []
    got = identify(frame(spark, [(1, "some words", None), (2, None, "aa")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_rows_without_a_language_go(spark):
    docs = frame(spark, rows(60) + [(900, "?? 12", "aa"), (901, None, None), (7, rows()[7][1], "bb")])
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(60), 7])


def test_memory_of_a_worker_is_bounded_by_the_slice():
    """2 MB of text at a time took over 200 MB; many short texts and distinct words are the worst."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Rows:
        def __init__(self):
            self.sparkSession = self.sparkContext = self

        def broadcast(self, value):
            self.value = value
            return self

        def mapInArrow(self, run, schema):
            return run

    model = crf_language.Model(["de", "en", "es", "fr"])
    chance = np.random.default_rng(0)
    texts = [" ".join(f"w{x:x}" for x in chance.integers(0, 1 << 40, 12)) for _ in range(15_000)]
    names = ["id", "held_out", "text", "letters"]
    cells = [pa.array(range(15_000)), pa.array([False] * 15_000), pa.array(texts), pa.array([True] * 15_000)]
    run = crf_language.predict(Rows(), model)
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays(cells, names=names)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 15_000 and peak < 150e6


def test_texts_in_no_learned_language_go(spark):
    """Every text with a letter stayed, whatever the model found in its words."""
    data = rows(600)
    chance = random.Random(9)

    def junk(letters, n):
        return " ".join("".join(chance.choice(letters) for _ in range(chance.randrange(3, 9))) for _ in range(n))

    foreign = [(2000 + i, junk("wxyzqjvu", 40 + i), None) for i in range(20)]
    foreign += [(3000 + i, junk("абвгдежзик", 60), None) for i in range(5)]
    short = [(4000 + i, prose(chance, list(SOUNDS)[i % 3], 1), None) for i in range(30)]
    switched = [(5000 + i, prose(chance, "aa", 30) + " " + prose(chance, "bb", 30), None) for i in range(5)]
    kept = keep_identified(frame(spark, data + foreign + short + switched))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in data + short + switched)
