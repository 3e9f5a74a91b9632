"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderleaf.llm import bitpack, decontaminate, exact_dedup, license_scan, near_dedup, packing, periodic, secret_scan, suffix_tree, super_kmer, variants, wrapper_html
from cinderleaf.llm import crf_language as language
from cinderleaf.llm.common import table
from cinderleaf.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_packed_token_ids")
def packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what its stored ids say: start, n_tokens, ids_crc32."""
    path = bitpack.scratch_path(spark, "packed")
    bitpack.write_packed(
        table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"), vocabulary=49_408, end_id=2
    )
    return bitpack.read_packed(spark, path, with_ids=False)


@query("op6_cost_packing")
def cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=0)


EXACT_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
named AS (SELECT doc_id, sha256(t) AS text_sha256 FROM plain)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM named WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op10_digest_tree", EXACT_SQL)
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the row of its text that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_secret_ownership")
def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its secrets and whether they stay with an owner."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query("op3_template_decontamination")
def template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_minmax_dedup")
def minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its near-duplicate component and whether it stays."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


@query("op8_suffix_tree_score")
def suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its probability under the suffix tree and under single words."""
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


@query("op1_crf_language")
def crf_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the language of its words together."""
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches")


@query("op9_wrapper_extraction")
def wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrapper_html.extract_pages(table(spark, sf_dir, "pages"))


@query("op2_license_paragraphs")
def license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence paragraphs of all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def periodic_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its longest periodic run and digests of all runs and of the collapsed text."""
    found = periodic.periodic_runs(periodic.repeat_tails(table(spark, sf_dir, "documents")))
    return periodic.run_digests(found)


REPEATS_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM split WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM placed),
repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY t) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM repeated),
removed AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id),
kept AS (
  SELECT split.doc_id, len(w) AS n, coalesce(len(l), 0) AS m,
         list_filter(w, lambda x, i: l IS NULL OR NOT list_contains(l, i)) AS k
  FROM split LEFT JOIN removed ON split.doc_id = removed.doc_id)
SELECT doc_id, n AS n_words, m AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query("op12_super_kmer_dedup", REPEATS_SQL)
def super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words that no repeated window of an earlier document covers."""
    left = super_kmer.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word its near words, its frequent form and the end of its forms."""
    words = variants.word_counts(table(spark, sf_dir, "documents"), changed=True)
    return variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
