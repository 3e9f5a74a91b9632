"""Near-duplicate components against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from cinderleaf.llm import near_dedup
from cinderleaf.operators.components import components
from tests.llm.helpers import near_components, shingles

SCHEMA = "doc_id long, text string, n string, low string, key string, bands string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def check(spark, rows):
    got = near_dedup.near_groups(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    expected = near_components(dict(rows))
    for r in got:
        assert r["component_id"] == expected[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert sizes == {i: len(shingles(t)) for i, t in rows}
    return got


def edited(words, chance, edits):
    out = list(words)
    for _ in range(edits):
        out[chance.randrange(len(out))] = f"new{chance.randrange(10**6)}"
    return out


def test_families_of_edits(spark):
    chance = random.Random(4)
    rows = []
    for family in range(40):
        words = [f"w{chance.randrange(400)}" for _ in range(chance.choice([6, 9, 20, 60, 150]))]
        for _ in range(chance.randrange(1, 9)):
            rows.append((chance.randrange(10**6), " ".join(edited(words, chance, chance.randrange(4)))))
    rows = list(dict(rows).items())
    check(spark, rows)


def test_small_and_empty_texts(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, " one "), (7, "a b c d"), (8, "A  b\nc d"),
        (9, "a b c d e"), (10, "a b c d e f"), (11, "a b c d e"), (12, "É b c d e"), (13, "é b c d e"),
    ]
    check(spark, rows)


def test_chain_and_crowd(spark):
    chance = random.Random(7)
    words = [f"c{i}" for i in range(60)]
    chain = []
    for i in range(40):  # each like the one before, the ends not alike at all
        chain.append((500 - i, " ".join(words)))
        words[i % 60] = f"x{i}"
    base = [f"b{i}" for i in range(120)]
    crowd = [(1000 + i, " ".join(edited(base, chance, 1 + i % 4))) for i in range(300)]
    check(spark, chain + crowd)


def test_buckets_with_several_components(spark):
    chance = random.Random(9)
    shared = [f"s{i}" for i in range(50)]  # about half of every text: common buckets, no link
    rows = []
    for family in range(30):
        own = [f"f{family}x{i}" for i in range(30)]
        for copy in range(4):
            rows.append((family * 10 + copy, " ".join(shared + edited(own, chance, copy))))
    check(spark, rows)


def test_cells_compare_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "MEET", 2)
    test_buckets_with_several_components(spark)


def test_template_of_many_texts_without_links(spark, monkeypatch):
    """Texts of one template share 0.64 and more of their shingles and no link: no pairs leave the cells."""
    chance = random.Random(11)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"o{chance.randrange(10**9)}" for _ in range(16)])) for i in range(600)]
    placed, told = [], []
    cells, stars = near_dedup._cells, near_dedup._stars
    monkeypatch.setattr(near_dedup, "_stars", lambda pairs, held: placed.append(pairs.count()) or stars(pairs, held))
    monkeypatch.setattr(near_dedup, "_cells", lambda p, held: told.append(cells(p, held)) or told[-1])
    check(spark, rows)
    assert max(placed) <= len(rows) and sum(t.count() for t in told) == 0


def test_five_texts_of_one_template(spark):
    check(spark, [(i, " ".join([f"s{k}" for k in range(60)] + [f"o{i}x{k}" for k in range(16)])) for i in range(5)])


def test_cell_links_equal_all_pairs():
    chance = np.random.default_rng(2)
    base = np.unique(chance.integers(0, 1 << 60, 300, dtype=np.uint64))
    sets = [np.unique(np.append(chance.choice(base, 280, replace=False), chance.integers(0, 1 << 60, k, dtype=np.uint64))) for k in chance.integers(0, 90, 60)]
    nodes, roots = list(range(100, 160)), [100 + k // 2 * 2 for k in range(60)]
    whole = {r: r for r in roots}

    def find(parent, r):
        while parent[r] != r:
            r = parent[r]
        return r

    for i in range(60):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(whole, roots[i]), find(whole, roots[j])
                whole[max(x, y)] = min(x, y)
    links = near_dedup.cell_links(sets, nodes, roots)
    part = {r: r for r in roots}
    for a, b in links:
        x, y = find(part, roots[a - 100]), find(part, roots[b - 100])
        assert x != y  # no link that others imply
        part[max(x, y)] = min(x, y)
    assert {r: find(whole, r) for r in roots} == {r: find(part, r) for r in roots}


def test_recall_of_pairs_at_the_threshold():
    """Sets that share just 75 hundredths meet in a bucket nearly always."""
    chance = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        shared, own = chance.integers(0, 1 << 63, 150, dtype=np.uint64), chance.integers(0, 1 << 63, 50, dtype=np.uint64)
        sets = [np.append(shared, own[:25]), np.append(shared, own[25:])]
        keys = near_dedup.signatures(np.concatenate(sets), np.array([0, 175, 350]))[1]
        met += bool((keys[0] == keys[1]).any())
    assert met >= 397


def test_very_long_text(spark):
    words = [f"v{i % 30_000}" for i in range(60_000)]
    check(spark, [(1, " ".join(words)), (2, " ".join(words[:-400])), (3, " ".join(words[:20_000]))])


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"k{i}" for i in range(40))
    rows = [(5, long), (5, "other words entirely in this one here"), (3, "other words entirely in this one here"), (9, long), (None, long)]
    got = sorted(near_dedup.near_groups(frame(spark, rows)).collect(), key=str)
    assert {r["component_id"] for r in got if r["doc_id"] is not None} == {3}
    missing = [r for r in got if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in missing] == [(None, True)]
    kept = near_dedup.drop_near(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None"]


def test_empty_table(spark):
    assert near_dedup.near_groups(frame(spark, [])).collect() == []


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(150)], [(7, i) for i in range(8, 400)], [], [(2, 2)]])
def test_components(spark, edges):
    chance = random.Random(1)
    mixed = [e if chance.random() < 0.5 else e[::-1] for e in edges]
    got = dict(map(tuple, components(spark.createDataFrame(mixed, "a long, b long")).collect()))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert set(got) == nodes and set(got.values()) <= {min(nodes)} if nodes else got == {}
