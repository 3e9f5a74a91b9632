import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderleaf.llm import periodic, wordhash
from cinderleaf.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w):
    """All runs by extending every pair of equal words q apart."""
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                seen.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def plain_row(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aabbc"), max_size=60), min_size=1, max_size=5))
def test_runs_equal_plain_ones(texts):
    counts, runs, bounds, collapsed = periodic.text_runs(*joined([" ".join(t) for t in texts]))
    shown = wordhash.strings(*collapsed).to_pylist()
    for k, w in enumerate(texts):
        own = list(zip(*(x[bounds[k] : bounds[k + 1]].tolist() for x in runs)))
        expected = plain_runs(w)
        assert counts[k] == len(w)
        assert own == expected
        gone = {i for a, m, q in expected for i in range(a + q, a + m)}
        assert shown[k] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_long_periods_and_one_word():
    rng = random.Random(5)
    block = [f"w{rng.randrange(500)}" for _ in range(333)]
    texts = [
        " ".join([f"x{i}" for i in range(40)] + block * 5 + block[:100] + ["y"] * 3000),
        " ".join(["same"] * 20_000),
        " ".join(f"u{i}" for i in range(5000)),
    ]
    _, runs, bounds, _ = periodic.text_runs(*joined(texts))
    for k in range(2):
        own = list(zip(*(x[bounds[k] : bounds[k + 1]].tolist() for x in runs)))
        assert own == [[(40, 1765, 333), (1805, 3000, 1)], [(0, 20_000, 1)]][k]
    assert bounds[3] == bounds[2]


def test_extensions_equal_plain_ones():
    rng = np.random.default_rng(3)
    words = np.append(rng.integers(1, 3, 400), 0).astype(np.int32)
    reach = periodic.Extensions(words, np.zeros(401, np.int64))
    left, right = np.triu_indices(400, 1)
    some = rng.choice(len(left), 5000, replace=False)
    for i, j, n in zip(left[some], right[some], reach(left[some], right[some])):
        k = 0
        while j + k < 400 and words[i + k] == words[j + k]:
            k += 1
        assert n == k


def test_query_equals_plain_rows(spark, sf):
    found = {tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert found == {plain_row(r.doc_id, r.text) for r in docs}


def test_odd_rows(spark):
    long = " ".join(["a b"] * 30_000)
    rows = [(None, "x " * 9, 1), (7, None, 1), (7, "", 2), (7, " \t\n", 2), (8, "q q q q q", 3), (8, "q q q q q", 3), (9, long, 4), (10, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    shown = periodic.run_digests(periodic.periodic_runs(periodic.repeat_tails(docs)))
    got = sorted((tuple(r) for r in shown.collect()), key=str)
    assert got == sorted((plain_row_fast(a, b) for a, b, _ in rows), key=str)
    empty = periodic.run_digests(periodic.periodic_runs(docs.limit(0)))
    assert empty.count() == 0 and len(empty.columns) == 8


def plain_row_fast(doc_id, text):
    """plain_row, by hand for the long text of two words."""
    if text is None or len(text) < 10_000:
        return plain_row(doc_id, text)
    assert zlib.crc32(str(doc_id).encode()) % 10
    n = len(words_of(text))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, 1, 0, n, 2, 1000 * n // 2, sha(f"0,{n},2\n"), sha("a b"))
