import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from cinderleaf.fixed import place_rules as rules
from cinderleaf.operators import lookup, retrieval, routes
from cinderleaf.operators.lookup import contains_join


def test_contains_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 60))) for _ in range(80)]
    needles = ["".join(rng.choices("abc é", k=rng.randint(1, 9))) for _ in range(60)]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "j long, needle string")
    expected = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(needles) if b in a)
    got = contains_join(t, "text", n, "needle").select("i", "j").collect()
    assert sorted((r["i"], r["j"]) for r in got) == expected
    monkeypatch.setattr(lookup, "fits_broadcast", lambda df, *_: False)
    shuffled = contains_join(t, "text", n, "needle").select("i", "j")
    assert sorted((r["i"], r["j"]) for r in shuffled.collect()) == expected


def test_contains_join_has_no_cartesian_product(spark):
    t = spark.createDataFrame([(1, "abcdefghij")], "i long, text string")
    plan = contains_join(t, "text", t.withColumnsRenamed({"i": "j", "text": "n"}), "n")
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical


def test_first_entry_wins_and_blank_takes_the_first(spark):
    foods = spark.createDataFrame(
        [(0, "white rice", 1), (1, "rice", 2), (2, "dhal curry", 3)], "prio int, name string, calories int"
    )
    items = spark.createDataFrame([(0, "Rice "), (1, "red rice bowl"), (2, "DHAL"), (3, " "), (4, "zzz")], "i int, item string")
    out = lookup.resolve_first_match(items, "item", foods, "name", "prio").collect()
    assert {r["i"]: r["prio"] for r in out} == {0: 0, 1: 1, 2: 2, 3: 0, 4: None}


def bfs(start, end, blocked):
    if start == end:
        return [start]
    if start not in rules.NEIGHBOURS or end not in rules.NEIGHBOURS:
        return None
    queue, seen = deque([[start]]), {start}
    while queue:
        path = queue.popleft()
        for node in rules.NEIGHBOURS[path[-1]]:
            if node in blocked and node not in (start, end):
                continue
            if node not in seen:
                seen.add(node)
                if node == end:
                    return [*path, node]
                queue.append([*path, node])
    return None


def test_routes_equal_breadth_first_search(spark):
    names = [*rules.NEIGHBOURS, "atlantis"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in names for b in names)]
    trips = spark.createDataFrame(pairs, "trip long, src string, dst string")
    blocked = {"kegalle", "kilinochchi", "ratnapura"}
    closed = spark.createDataFrame([(b,) for b in blocked], "district string")
    out = routes.district_routes(trips, "src", "dst", routes.district_edges(spark), closed).collect()
    for row in out:
        clear, free = bfs(row["src"], row["dst"], blocked), bfs(row["src"], row["dst"], set())
        assert row["path"] == (clear or free)
        assert row["fallback"] == (clear is None and free is not None)


def test_similar_prompt_matches_difflib(spark):
    import difflib

    rng = random.Random(2)
    old = [" ".join(rng.choices(["beach", "safe", "kandy", "trip", "food"], k=rng.randint(2, 9))) for _ in range(30)]
    new = old[:3] + ["Beach safe trip", "zzz qqq", " "] + [o[:-3] + "xy" for o in old[5:12]]
    n = spark.createDataFrame(list(enumerate(new)), "i long, ask string")
    o = spark.createDataFrame(list(enumerate(old)), "j long, prompt string")
    got = {r["i"]: r for r in retrieval.similar_prompt(n, "i", "ask", o, "prompt", "j").collect()}
    for i, ask in enumerate(new):
        ask = ask.strip().lower()
        exact = [p for p in old if p.strip().lower() == ask]
        ratio = max((difflib.SequenceMatcher(None, ask, p.lower()).ratio() for p in old), default=0) if ask else 0
        best = 1.0 if exact else ratio
        assert got[i]["duplicate"] == (best > 0.65)
        assert got[i]["similarity"] == (round(best, 2) if best > 0.6 else None)


def test_vector_topk_in_several_batches(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(40, 8))
    vecs[7] = vecs[3]
    vecs[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BATCH", 16)
    got = retrieval.vector_topk(df, df, 3, query_id="id", doc_id="id").collect()
    norms = np.linalg.norm(vecs, axis=1)
    scale = np.outer(norms, norms)
    scores = np.divide(vecs @ vecs.T, scale, out=np.zeros_like(scale), where=scale > 0)
    for i in range(40):
        best = sorted(range(40), key=lambda j: (-round(scores[i, j], 12), j))[:3]
        mine = [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        assert mine == best


def test_vector_blocks_out_of_reach_are_not_visited(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vecs = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centres])
    vecs[5], vecs[100] = 0, vecs[101]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(9999, None)], "id long, embedding array<double>")
    index = retrieval.VectorIndex(df, "id", "embedding", 40, 10)
    blocks = index.blocks.count()
    solid = df.where("embedding IS NOT NULL AND id != 5").select("id", F.col("embedding").alias("vec"))
    asked = []
    visits = retrieval.VectorIndex.visits
    monkeypatch.setattr(retrieval.VectorIndex, "visits", lambda self, *a: asked.append(visits(self, *a)) or asked[-1])
    got = retrieval.vector_topk(df, df, 4, query_id="id", doc_id="id", skip_self=True, index=index).collect()
    assert blocks > 40 and asked[0].count() < 0.25 * blocks * solid.count()
    norms = np.linalg.norm(vecs, axis=1)
    scale = np.outer(norms, norms)
    scores = np.divide(vecs @ vecs.T, scale, out=np.zeros_like(scale), where=scale > 0)
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append(r["doc_id"])
    for i in range(len(vecs)):
        assert mine[i] == sorted((j for j in range(len(vecs)) if j != i), key=lambda j: (-round(scores[i, j], 12), j))[:4]


def test_pieces_do_not_carry_their_text(spark):
    t = spark.createDataFrame([(1, "word " * 20_000 + "needle one")], "i int, text string")
    n = spark.createDataFrame([(1, "needle one"), (2, "absent thing")], "j int, needle string")
    found = contains_join(t, "text", n, "needle")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.split("\n") if "Generate" in line]
    assert generators and not any("text#" in line.split("], ", 1)[-1].rsplit("[", 1)[0] for line in generators if "_text_id" in line)
    assert [(r["i"], r["j"]) for r in found.collect()] == [(1, 1)]


def test_a_text_becomes_rows_only_for_candidates(spark):
    """However long the texts, only pieces that pass the filter leave the pass over them."""
    from cinderleaf.functions.fingerprints import FILTER_BITS, filter_bits, fingerprints

    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij ", k=200_000))
    needle = "a needle of some length in the hay"
    t = spark.createDataFrame([(0, long), (1, long + needle + long), (2, None), (3, "")], "i long, text string")
    key = spark.createDataFrame([(needle,)], "n string").select(F.explode(fingerprints(F.col("n"))).alias("k"))
    leading = [r["b"] for r in key.select(F.shiftrightunsigned("k", 64 - FILTER_BITS).alias("b")).collect()]
    found = t.select("i", F.size(fingerprints(F.col("text"), [32], filter_bits(leading))).alias("n")).collect()
    sizes = {r["i"]: r["n"] for r in found}
    assert sizes[1] >= 3 and sizes[0] < 20 and sizes[2] == sizes[3] == 0
    n = spark.createDataFrame([(7, needle), (8, needle), (9, "not there at all")], "j long, needle string")
    assert sorted(tuple(r) for r in contains_join(t, "text", n, "needle").select("i", "j").collect()) == [(1, 7), (1, 8)]


def test_prompts_unlike_by_their_common_subsequence_are_not_compared(monkeypatch):
    """Before, every pair that shares its letters in some order was worked out by difflib."""
    import difflib

    import pandas as pd

    rng = random.Random(5)
    new = ["".join(rng.choices("abcdefghij ", k=150)) for _ in range(12)]
    old = ["".join(rng.choices("abcdefghij ", k=rng.randint(120, 260))) for _ in range(40)] + [n[3:] + "xy" for n in new]
    pairs = [(a, b) for a in new for b in old]
    whole = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    asked = []
    matcher = difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a: asked.append(a) or matcher(*a))
    got = retrieval._sequence_ratio.func(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert [None if pd.isna(x) else x for x in got] == [x if x > 0.6 else None for x in whole]
    assert 12 <= len(asked) < 0.2 * len(pairs)


def test_common_subsequences_equal_the_table(monkeypatch):
    import numpy as np

    from cinderleaf.functions import subsequence

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    sizes = [0, 1, 5, 63, 64, 65, 130, 200]
    left = ["".join(rng.choices("abcdé 漢", k=n)) for n in sizes] + ["a" * 128]
    right = ["".join(rng.choices("abcdxyz 漢", k=n)) for n in sizes] + ["a" * 70]
    a, b = map(np.array, zip(*[(i, j) for i in range(9) for j in range(9)]))
    for cells in (1 << 22, 300):
        monkeypatch.setattr(subsequence, "CELLS", cells)
        got = subsequence.common_subsequences(left, right, a, b)
        assert got.tolist() == [length(left[i], right[j]) for i, j in zip(a, b)]
        assert (subsequence.common_characters(left, right, a, b) >= got).all()


def test_a_worker_holds_one_block_of_vectors(monkeypatch):
    """Rows of a pass were pairs of whole blocks, thousands of them in a worker at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)

    def rows(block, asks):
        ids = pa.array(range(500), pa.int64())
        none = pa.nulls(500, pa.int64())
        vecs = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=500 * 64)), 64).cast(pa.list_(pa.float64()))
        cells = [pa.array([block] * 500, pa.int64()), pa.array([0] * 500, pa.int64()), pa.array([asks] * 500)]
        names = ["block", "part", "asks", "query_id", "doc_id", "vec"]
        return pa.RecordBatch.from_arrays([*cells, ids if asks else none, none if asks else ids, vecs], names=names)

    tracemalloc.start()
    stream = (rows(block, asks) for block in range(60) for asks in (False, True, True))
    found = sum(b.num_rows for b in retrieval._best_of_blocks(3, False)(stream))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 60 * 1000 * 3 and peak < 30e6


def _best_by_hand(queries, docs, k, skip_self):
    """{id: sorted scores and documents of its best k}; rows that repeat an id share one answer."""
    import numpy as np

    found = {}
    for i, q in queries:
        for j, d in docs:
            if not (skip_self and i is not None and i == j):
                scale = np.linalg.norm(q) * np.linalg.norm(d)
                found.setdefault(i, []).append((-round(float(q @ d / scale) if scale > 0 else 0.0, 9), j))
    return {i: sorted(x, key=lambda e: (e[0], e[1] is not None, e[1]))[:k] for i, x in found.items()}


@pytest.mark.parametrize("skip_self", [False, True])
def test_vectors_go_to_a_shelf_once(spark, monkeypatch, skip_self):
    """A query was sent to every block that it visits; without clusters that is every block there is."""
    import numpy as np

    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 16))
    vecs[20:90] = vecs[20]  # copies, more than a block has
    ids = list(range(400))
    ids[95], ids[96], ids[30] = 94, 94, 29  # ids that repeat, with other vectors and with equal ones
    rows = list(zip(ids, vecs, strict=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "SHELF_NUMBERS", 100 * 16)
    monkeypatch.setattr(retrieval, "QUERY_BATCH", 50)
    index = retrieval.VectorIndex(df, "id", "embedding", 20, 10)
    asked = []
    visits = retrieval.VectorIndex.visits
    monkeypatch.setattr(retrieval.VectorIndex, "visits", lambda self, *a: asked.append(visits(self, *a)) or asked[-1])
    got = retrieval.vector_topk(df, df, 3, query_id="id", doc_id="id", skip_self=skip_self, index=index).collect()
    assert index.blocks.count() > 30
    assert asked[0].count() <= 6 * 400
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["doc_id"]))
    assert mine == _best_by_hand(rows, rows, 3, skip_self)


def test_copies_of_a_vector_and_null_ids():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(300, 8))
    vecs[50:250] = vecs[50]
    vecs[7, 3] = np.nan
    ids = [None, None, *sorted(rng.integers(0, 40, 298).tolist())]
    held = retrieval._Held(pa.array(ids), vecs, 3, vecs[[1, 60, 270]] / np.linalg.norm(vecs[[1, 60, 270]], axis=1)[:, None])
    assert len(held.place) < 120
    plain = retrieval._plain(pa.array(ids))
    score, at = held.best(plain, vecs, np.full(300, -np.inf), 3, True)
    for n, i in enumerate(ids):
        every = _best_by_hand([(i, vecs[n])], zip(ids, vecs, strict=True), 3, True)[i]
        assert [(-round(s, 9), ids[a]) for s, a in zip(score[n], at[n], strict=True)] == every


def test_slices_of_a_shelf_out_of_reach_are_not_scored():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    vecs = np.concatenate([c + 0.05 * rng.normal(size=(100, 16)) for c in centres])
    pivots = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    held = retrieval._Held(pa.array(range(1200)), vecs, 3, pivots)
    scored = []

    class Counted:
        def __init__(self, rows):
            self.rows = rows

        def __matmul__(self, asks):
            scored.append(len(self.rows) * asks.shape[1])
            return self.rows @ asks

    held.slices = [(a, b, Counted(rows)) for a, b, rows in held.slices]
    held.best(np.arange(1200), vecs, np.full(1200, 0.9), 3, False)
    assert len(held.slices) == 12 and sum(scored) < 0.25 * 1200 * 1200
