"""The stages of the pipeline against plain restatements, each on what its predecessor kept."""

import re

import pytest

import corpus_pipeline
from cinderleaf.llm.common import table
from tests.llm.helpers import near_components


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, sf, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.collect()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_language_keeps_texts_with_letters(staged):
    assert ids(staged["language"]) == [i for i in ids(staged["documents"]) if i in {
        r["doc_id"] for r in staged["documents"] if r["text"] and re.search(r"[^\W\d_]", r["text"])
    }]


def test_exact(staged):
    first = {}
    for r in sorted(staged["language"], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert ids(staged["exact_dedup"]) == sorted(first.values())


def test_near(staged):
    roots = near_components({r["doc_id"]: r["text"] for r in staged["exact_dedup"]})
    assert ids(staged["near_dedup"]) == sorted({*roots.values()})


def test_benchmark(spark, sf, staged):
    def plain(text):
        return re.sub(r"[\W_]+", " ", text).lower().strip()

    items = [plain(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = [r["doc_id"] for r in staged["near_dedup"] if not any(i in plain(r["text"]) for i in items)]
    assert ids(staged["decontaminate"]) == sorted(clean)


def test_pack(staged):
    assert {r["doc_id"] for r in staged["pack"]} == {r["doc_id"] for r in staged["decontaminate"]}
    by_doc: dict = {}
    for r in staged["pack"]:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    assert all(sum(parts) == tokens for (_, tokens), parts in by_doc.items())


def test_run(spark, sf, staged):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == list(staged["pack"][0].asDict())
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r["length"] for r in got.collect()) == sum(r["length"] for r in staged["pack"])
    assert set(key) <= set(got.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_columns_of_any_name_pass_the_stages(spark):
    from cinderleaf.llm import crf_language, decontaminate, exact_dedup, near_dedup

    text = " ".join(f"word{k} of a text" for k in range(30))
    names = ["digest", "own", "key", "KEY_", "_digest", "_id", "_gone", "_held"]
    rows = [(i, text if i < 3 else f"other words {i} altogether", "en", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    benchmark = spark.createDataFrame([(1, "nothing that any text holds at all, not one word")], "item_id long, text string")
    for kept in (
        exact_dedup.drop_exact(docs),
        near_dedup.drop_near(docs),
        decontaminate.decontaminate(docs, benchmark),
        crf_language.keep_identified(docs),
    ):
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= set(rows)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(docs).collect()) == [0, 3, 4, 5]
