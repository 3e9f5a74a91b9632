"""Spans, counts and ownership of secrets against plain expressions."""

import pytest

from cinderleaf.llm.secret_scan import scan_secrets
from tests.llm.helpers import base_spans, sha, span_text

HEXES = "0123456789abcdef" * 2
TEXTS = [
    "",
    None,
    f'token = "{HEXES}" and then',
    "é token= ab, Password:'hunter22' passwd = short secret=token: abcdefgh",
    f"AKIA{'A1' * 8} AKIA123 xAKIA{'Z' * 30} ünï {HEXES}{HEXES}",
    "API_KEY==x=yzzz apikey : 'k-l_m.n/o+p=' api-key=nothing",
    f"{HEXES[:23]} {HEXES[:24]} {HEXES.upper()}",
    "token=abcdef" * 300,
    "secret = 'abc' SECRET:\"abcdefg\"\ntoken\n=abcdefg",
]


def scanned(spark, rows):
    schema = "doc_id long, text string, source string, id string, row string, hash string, kind int"
    full = [(*r, "x", "y", "z", 1) for r in rows]
    return scan_secrets(spark.createDataFrame(full, schema)).collect()


def test_base_spans(spark):
    got = {r["doc_id"]: r for r in scanned(spark, [(i, t, f"o{i}/r") for i, t in enumerate(TEXTS)])}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = base_spans(text)
        row = got[i]
        assert row["base_sha256"] == sha(span_text(spans)), text
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        base = [s for s in row["spans"].split(",") if s and not s.startswith("owned")]
        assert ",".join(base) == span_text(spans)


def test_owned_runs_and_copied_examples(spark):
    live, example = "Zx81kQpL0vNw7TgB2yRc", "exampleExample1234567890"
    rows = [(1, f"see {live} here", "a/one"), (2, f"again {live}", "a/two")]
    rows += [(10 + i, f"use {example} and token: {example}", f"o{i}/r") for i in range(4)]
    got = {r["doc_id"]: r for r in scanned(spark, rows)}
    assert got[1]["spans"] == f"owned:4:{4 + len(live)}" and got[1]["n_live"] == 1
    assert got[2]["spans"].startswith("owned:6:")
    for i in range(4):
        assert got[10 + i]["spans"] == f"assign:{9 + len(example)}:{16 + 2 * len(example)}"
        assert got[10 + i]["n_copied"] == 1 and got[10 + i]["n_live"] == 0


def test_repeats_nulls_and_empty_table(spark):
    rows = [(1, "token=abcdefgh", None), (1, "token=abcdefgh", None), (None, "token=zzzzzzzz", "s")]
    got = scanned(spark, rows)
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in got) == [(0, 1), (1, 1), (1, 1)]
    assert scanned(spark, []) == []


@pytest.mark.parametrize("copies", [2500])
def test_hot_value(spark, copies):
    rows = [(i, "token=hotvalue1", "one") for i in range(copies)] + [(copies + i, f"token=val{i:07d}", "two") for i in range(50)]
    got = scanned(spark, rows)
    assert len(got) == copies + 50 and all(r["n_assign"] == 1 and r["n_live"] == 1 for r in got)
