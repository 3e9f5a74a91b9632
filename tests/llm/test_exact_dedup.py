"""Exact groups against a dictionary of normalised texts."""

import re

from cinderleaf.llm.exact_dedup import drop_exact, exact_groups
from tests.llm.helpers import sha

SCHEMA = "doc_id long, text string, lang string, digest string, cell string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "d", "c", "k") for i, t in rows], SCHEMA)


def expected(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, plain, strict=True):
        ids = [j for (j, _), u in zip(rows, plain, strict=True) if u == t]
        named = [j for j in ids if j is not None]
        keep = min(named) if named else None
        out.append((i, keep, len(ids), i == keep, sha(t)))
    return sorted(out, key=str)


def test_groups(spark):
    rows = [
        (5, "a  b"), (3, "a\tb"), (9, " a b"), (4, "a b "), (1, None), (2, ""), (7, "\n"), (None, "a b"), (None, "x"),
        (None, "x"), (8, "a b"), (10, "long " * 200_000), (11, "long  " * 200_000), (12, "A b"), (3, "a b"),
    ]
    got = exact_groups(frame(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_hot_text_and_many_runs(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"text {i % 700}") for i in range(2100)]
    got = exact_groups(frame(spark, rows).repartition(13), fan=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty(spark):
    assert exact_groups(frame(spark, [])).collect() == []
    assert drop_exact(frame(spark, [])).collect() == []


def test_drop_keeps_columns_and_one_row_a_text(spark):
    rows = [(2, "a b"), (1, "a  b"), (1, "a b"), (None, "n"), (None, "n"), (7, "n"), (8, None), (9, "")]
    kept = drop_exact(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = kept.collect()
    assert sorted((r["doc_id"], (r["text"] or "").split()) for r in got) == [(1, ["a", "b"]), (7, ["n"]), (8, [])]
