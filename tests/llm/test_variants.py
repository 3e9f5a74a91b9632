import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinderleaf.llm import variants
from cinderleaf.llm.queries import QUERIES


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def edits(w):
    """What is left of a word without one letter, and with one letter masked."""
    return [w[:k] + w[k + 1 :] for k in range(len(w))], [w[:k] + "*" + w[k + 1 :] for k in range(len(w))]


def plain_groups(counts):
    """(word, form, root, n, n_near, form_n) by masks and deletions of all words."""
    near, masked = defaultdict(set), defaultdict(list)
    for w in counts:
        cut, mask = edits(w)
        for c in cut:
            if c in counts:
                near[w].add(c)
                near[c].add(w)
        for m in mask:
            masked[m].append(w)
    for group in masked.values():
        for w in group:
            near[w] |= {x for x in group if x != w}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 10 * n:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return out


def made_words(seed, n=400):
    rng = random.Random(seed)
    alphabet = "abcdeé÷ÿß"
    words = {"".join(rng.choices(alphabet, k=rng.choice([7, 8, 9, 12]))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]}
    words |= {"z" * k for k in range(7, 30)} | {"y" * 300, "y" * 301, "y" * 150 + "x" + "y" * 150}
    return {w: rng.choice([2, 3, 30, 40, 500, 500, 9000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("cell", [5, 4_000])
def test_groups_equal_plain_ones(spark, monkeypatch, cell):
    monkeypatch.setattr(variants, "CELL", cell)
    counts = made_words(cell)
    found = variants.group_variants(spark.createDataFrame(sorted(counts.items()), "word string, n long"))
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.select(names).collect()} == plain_groups(counts)
    assert found.count() == len(counts)


def test_a_small_sample_only_places_the_cuts(spark, monkeypatch):
    monkeypatch.setattr(variants, "CELL", 10)
    monkeypatch.setattr(variants, "SAMPLE", 30)
    counts = made_words(8)
    found = variants.group_variants(spark.createDataFrame(sorted(counts.items()), "word string, n long"))
    assert {(r.word, r.n_near) for r in found.collect()} == {(r[0], r[4]) for r in plain_groups(counts)}


def test_boxes_are_pruned_but_none_that_holds_a_near_word():
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 4, (2000, variants.PLACES)).astype(np.int32)
    nodes = variants.build(vectors, 20)
    leaf = variants.leaf_of(nodes, vectors)
    assert np.bincount(leaf).max() <= 20 and len(nodes) + 1 == leaf.max() + 1
    for down in (True, False):
        seen = set()
        for k, some in variants.reachable(nodes, vectors, down):
            seen |= {(k, int(i)) for i in some}
        assert len(seen) < 0.6 * len(vectors) * (leaf.max() + 1)
        moved = vectors.copy()
        up = rng.integers(0, variants.PLACES, len(moved))
        moved[np.arange(len(moved)), up] += 1
        if down:
            lower = moved.argmax(axis=1)
            moved[np.arange(len(moved)), lower] -= 1
        assert {(int(k), i) for i, k in enumerate(variants.leaf_of(nodes, moved))} <= seen


def test_chains_of_forms(spark):
    rows = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 1999), ("ccccccc", 5)]
    found = variants.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {r.word: (r.form, r.root) for r in found} == {
        "aaaaaaa": ("aaaaaab", "aaaabbb"),
        "aaaaaab": ("aaaaabb", "aaaabbb"),
        "aaaaabb": ("aaaabbb", "aaaabbb"),
        "aaaabbb": (None, "aaaabbb"),
        "aaabbbb": (None, "aaabbbb"),
        "ccccccc": (None, "ccccccc"),
    }


def test_odd_rows(spark):
    long = "Übergrößen STRASSEN straßen " * 3000
    rows = [(None, "Variants variants VARIANTS"), (None, "variants"), (1, None), (1, ""), (2, "kurz ×÷×÷×÷× x"), (2, "variant variant"), (3, long), (4, "İstanbullu İstanbullu")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n long, word string")
    counts = variants.word_counts(docs, changed=True)
    assert {tuple(r) for r in counts.collect()} == set(plain_counts(rows).items())
    shown = variants.group_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in shown.collect()} == plain_groups(plain_counts(rows))
    assert variants.group_variants(variants.word_counts(docs.limit(0))).count() == 0


def test_query_equals_plain_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_groups(plain_counts([tuple(d) for d in docs]))
    found = QUERIES["op13_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
