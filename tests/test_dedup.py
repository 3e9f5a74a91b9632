import random

import pytest
from pyspark.sql import functions as F

from cinderleaf.operators import dedup
from cinderleaf.operators.dedup import merge_records, near_dedup


def shingles(text):
    words = text.lower().split()
    if len(words) < 5:
        return {("raw", text)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def sequential(texts):
    kept, sets = [], []
    for i, text in enumerate(texts):
        own = shingles(text)
        if any(len(own & s) * 5 >= len(own | s) * 4 for s in sets):
            continue
        kept.append(i)
        sets.append(own)
    return kept


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocab, k=rng.randint(3, 60)) for _ in range(12)]
    boiler = rng.choices(vocab, k=30)
    texts = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words = words + boiler
        text = " ".join(words)
        texts.append(text.upper() if rng.random() < 0.1 else text)
    return texts


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in near_dedup(df, "doc_id").select("doc_id").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_equals_sequential_scan(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts) == sequential(texts)


def test_crowds_are_resolved_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PAIRS_PER_ENTRY", 0)
    monkeypatch.setattr(dedup, "HEADS", 2)
    texts = corpus(3, n=60)
    assert run(spark, texts) == sequential(texts)


def test_rows_without_partner_are_not_counted_in_full(spark, monkeypatch):
    rng = random.Random(4)
    alone = [[f"v{rng.randrange(9000)}" for _ in range(50)] for _ in range(12)]
    boiler = [f"b{i}" for i in range(12)]
    texts = [" ".join(words + boiler) for words in alone]
    texts += [texts[0].replace("b11", "x")]
    # one set of shingles, but two texts
    texts += ["p q r s t p q r s t p", "p q r s t p q r s t p q r s t p"]
    seen = []
    prefixes = dedup._prefixes
    monkeypatch.setattr(dedup, "_prefixes", lambda sets: seen.extend(r["ord"] for r in sets.collect()) or prefixes(sets))
    assert run(spark, texts) == sequential(texts)
    assert sorted(seen) == [0, 12, 13, 14]


def test_sets_at_the_threshold_stay_partners(spark):
    """Texts of n words and ones cut or changed at their ends, most of them just at or past the threshold."""
    texts = []
    for n in (5, 6, 9, 14, 15, 16, 24, 44, 64, 104):
        words = [f"t{n}x{i}" for i in range(n)]
        texts.append(" ".join(words))
        for k in range(1, max(2, n // 3)):
            texts += [" ".join(words[: n - k]), " ".join(words[k:] + [f"z{n}x{k}"])]
    assert run(spark, texts) == sequential(texts)


def test_chain_keeps_both_ends(spark):
    words = [f"t{i}" for i in range(60)]
    a = words
    b = words[:57] + ["x1", "x2", "x3"]
    c = words[:54] + ["y1", "y2", "y3"] + ["x1", "x2", "x3"]
    texts = [" ".join(t) for t in (a, b, c)]
    assert run(spark, texts) == sequential(texts)


def test_merge_records_equals_sequential_scan(spark):
    import hashlib

    rng = random.Random(7)
    rows = [
        (i, rng.choice(["", "a", "b", "c", "d", f"u{i}"]), rng.choice(["", "N1", "n2 ", "N3", f"n{i}"]))
        for i in range(80)
    ]
    ids, names, kept = set(), set(), []
    for i, rid, name in rows:
        low = name.strip().lower()
        if (rid and rid in ids) or (low and low in names):
            continue
        rid = rid or "pl_" + hashlib.md5(low.encode()).hexdigest()[:8]
        ids.add(rid)
        names.add(low)
        kept.append((i, rid))
    df = spark.createDataFrame(rows, "ord long, id string, name string")
    got = sorted((r["ord"], r["id"]) for r in merge_records(df, "ord").collect())
    assert got == kept


def _chain(spark, n):
    """Rows of which each conflicts with the one before it only: every other one is dropped."""
    rows = spark.range(n)
    claims = rows.selectExpr("id AS ord", "id AS key")
    checks = rows.where("id > 0").selectExpr("id AS ord", "id - 1 AS key")
    return claims, checks


def test_a_long_chain_takes_few_checkpoints(spark, monkeypatch):
    from cinderleaf.operators import components as graph
    from cinderleaf.operators import resolve

    made = []
    original = resolve.checkpoint

    def counted(df):
        made.append(1)
        return original(df)

    monkeypatch.setattr(resolve, "checkpoint", counted)
    monkeypatch.setattr(graph, "written", counted)
    gone = sorted(r["ord"] for r in resolve.dropped_rows(*_chain(spark, 300)).collect())
    assert gone == list(range(1, 300, 2))
    assert len(made) < 120


def test_components_too_large_for_a_task_stay_in_rounds(spark, monkeypatch):
    from cinderleaf.operators import resolve

    monkeypatch.setattr(resolve, "SCAN_ROWS", 6)
    claims, checks = _chain(spark, 12)
    other = spark.createDataFrame([(100, 500), (101, 501), (102, 502)], "ord long, key long")
    later = spark.createDataFrame([(101, 500), (102, 501)], "ord long, key long")
    gone = resolve.dropped_rows(claims.unionByName(other), checks.unionByName(later)).collect()
    assert sorted(r["ord"] for r in gone) == [1, 3, 5, 7, 9, 11, 101]


def test_first_rows_of_a_crowded_key(spark, monkeypatch):
    """A key's rows are cut part by part; no part is much larger than the head times SPREAD."""
    monkeypatch.setattr(dedup, "SPREAD", 4)
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), (F.col("id") * 7919 % 20_011).alias("o"))
    parts = []
    monkeypatch.setattr(dedup, "checkpoint", lambda df: parts.append(df.count()) or df)
    got = sorted(map(tuple, dedup.first_rows(rows, ["k"], "o", 5).collect()))
    expected = []
    every = [tuple(r) for r in rows.collect()]
    for k in {r[0] for r in every}:
        expected += sorted(r for r in every if r[0] == k)[:5]
    assert got == sorted(expected)
    assert len(parts) >= 3 and parts == sorted(parts, reverse=True)
