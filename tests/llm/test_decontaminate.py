"""Benchmark items in documents, verbatim and with other numbers, names and units."""

from cinderleaf.llm.decontaminate import decontaminate, find_items

ITEM = "a train leaves the old station at 9 and travels 120 km north before Anna meets Bob near the river bridge"
SAME = "a train leaves the old station at 9 and travels 120 km north before Anna meets Bob near the river bridge"
MOVED = "a train leaves the old station at 7 and travels 350 miles north before Carla meets Dora near the river bridge"
MIXED = "a train leaves the old station at 7 and travels 350 miles north before Carla meets Carla near the river bridge"
PLAIN = "every morning the baker opens her small shop and sells warm bread to people who pass by on their way"
BENCH = "item_id long, text string, id string, words string"
DOCS = "doc_id long, text string, item string, hash string, shift string, windows string"


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, "x", "y") for i, t in items], BENCH),
    )


def found(spark, docs, items):
    return sorted((r["doc_id"], r["item_id"]) for r in find_items(*frames(spark, docs, items)).collect())


def test_passages_and_reparameterised_questions(spark):
    filler = "unrelated words come first and last in this text so that the passage sits in the middle "
    docs = [
        (1, filler + SAME + " " + filler), (2, filler + MOVED + " " + filler), (3, filler), (4, None), (5, ""),
        (6, filler + PLAIN.upper().lower()), (7, SAME.replace(" ", "\n  ")), (8, " ".join(PLAIN.split()[:7])),
        (9, filler * 3000 + SAME), (1, filler),
    ]
    items = [(10, ITEM), (11, PLAIN), (12, "too short"), (13, None), (10, ITEM)]
    assert found(spark, docs, items) == [(1, 10), (2, 10), (6, 11), (7, 10), (9, 10)]


def test_slots_must_pair_up_one_to_one(spark):
    rows = {r["doc_id"]: r for r in find_items(*frames(spark, [(1, MOVED), (2, MIXED)], [(10, ITEM)]), paired=0.0).collect()}
    assert rows[1]["slot_share"] == 1.0 and rows[2]["slot_share"] < 0.95
    swapped = ITEM.replace("Anna", "Zed").replace("Bob", "Zed").replace("120", "9")
    assert found(spark, [(1, swapped)], [(10, ITEM)]) == []


def test_empty_tables_and_columns(spark):
    assert found(spark, [], [(1, ITEM)]) == []
    assert found(spark, [(1, SAME)], []) == []
    docs, items = frames(spark, [(1, SAME), (2, PLAIN), (None, SAME), (None, PLAIN), (2, PLAIN)], [(10, ITEM)])
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [2, 2]


def test_large_benchmarks_take_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr("cinderleaf.llm.decontaminate.BROADCAST_WINDOWS", 0)
    assert found(spark, [(1, SAME), (2, MOVED), (3, PLAIN)], [(10, ITEM)]) == [(1, 10), (2, 10)]


def test_slots_are_read_where_their_windows_were_found(spark):
    name = "every morning the baker opens her small shop and sells warm bread to Anna and people who pass by on their way"
    docs = [
        (1, ITEM.replace("Anna", "then Anna")), (2, ITEM.lower()), (3, MOVED.replace("north ", "")),
        (4, name.replace("Anna", "anna")), (5, MIXED.replace("travels", "then travels")),
    ]
    rows = frames(spark, docs, [(10, ITEM), (11, name)])
    got = {(r["doc_id"], r["item_id"]): r for r in find_items(*rows, paired=0.0).collect()}
    assert found(spark, docs[:4], [(10, ITEM), (11, name)]) == [(1, 10), (2, 10), (3, 10), (4, 11)]
    assert got[1, 10]["n_windows"] == 11 and got[1, 10]["slot_share"] == 1.0
    assert got[5, 10]["slot_share"] < 0.95


def test_items_without_usable_windows_and_long_passages(spark, monkeypatch):
    dense, short = "What is 12 * 34 + 56 - 7 / 8?", "who painted Guernica?"
    long = " ".join(f"{a}{b}" for a in ("ba", "ko", "ru", "te", "mi", "so") for b in ("na", "le", "vu", "gi", "po"))
    docs = [
        (1, f"Solve it. {dense} Thanks."), (2, "What is 12 * 34 + 56 - 7 / 9?"), (3, "Tell me: Who painted guernica"),
        (4, "who painted it"), (5, "so " + " ".join(long.split()[4:17]) + " and no more"), (6, " ".join(long.split()[4:16])),
        (7, None), (None, dense),
    ]
    items = [(10, dense), (11, short), (12, long), (13, ""), (10, dense)]
    data = frames(spark, docs, items)
    for most in (1_000_000, 0):
        monkeypatch.setattr("cinderleaf.llm.decontaminate.BROADCAST_WINDOWS", most)
        got = {(r["doc_id"], r["item_id"]) for r in find_items(*data).collect()}
        assert got == {(1, 10), (3, 11), (5, 12), (None, 10)}
    assert sorted(r["doc_id"] for r in decontaminate(*data).collect()) == [2, 4, 6, 7]
