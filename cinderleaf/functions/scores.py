"""Answer and text similarity scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import food_rules as rules
from cinderleaf.functions.text import passes_toxicity, strip


OVERLAP = T.StructType(
    [T.StructField("bleu", T.DoubleType()), T.StructField("rouge_l", T.DoubleType())]
)


def _bleu(reference: list[str], candidate: list[str]) -> float:
    if not reference or len(candidate) < 4:
        return 0.0
    log_sum = 0.0
    for n in range(1, 5):
        seen = Counter(zip(*(candidate[i:] for i in range(n))))
        known = Counter(zip(*(reference[i:] for i in range(n))))
        total = len(candidate) - n + 1
        log_sum += math.log(((seen & known).total() + 0.1) / (total + 0.1))
    ratio = len(reference) / len(candidate)
    brevity = 1.0 if ratio < 1 else math.exp(1 - ratio)
    return brevity * math.exp(log_sum / 4.0)


def _longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one vector step per element of `a`."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for token in a:
        step = row.copy()
        np.maximum(row[1:], row[:-1] + (b == token), out=step[1:])
        row = np.maximum.accumulate(step)
    return int(row[-1])


def _rouge(reference: list[str], candidate: list[str]) -> float:
    if not reference or not candidate:
        return 0.0
    ids = {t: i for i, t in enumerate(dict.fromkeys(reference + candidate))}
    ref = np.array([ids[t] for t in reference], dtype=np.int32)
    cand = np.array([ids[t] for t in candidate], dtype=np.int32)
    common = _longest_common(ref, cand)
    if common == 0:
        return 0.0
    precision, recall = common / len(cand), common / len(ref)
    return 2 * precision * recall / (precision + recall)


@F.pandas_udf(OVERLAP)
def _overlap(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for references, candidates in pairs:
        rows = []
        for reference, candidate in zip(references, candidates):
            ref, cand = (reference or "").lower().split(), (candidate or "").lower().split()
            rows.append((_bleu(ref, cand), _rouge(ref, cand)))
        yield pd.DataFrame(rows, columns=["bleu", "rouge_l"])


def overlap_scores(reference: Column, candidate: Column) -> Column:
    """Struct (bleu, rouge_l) over lower-cased words."""
    return _overlap(reference, candidate)


def bleu(reference: Column, candidate: Column) -> Column:
    return overlap_scores(reference, candidate)["bleu"]


def rouge_l(reference: Column, candidate: Column) -> Column:
    return overlap_scores(reference, candidate)["rouge_l"]


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 when either norm is 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).otherwise(0.0)


def score_choice(answer: Column, gold_index: Column) -> Column:
    """First letter of the answer is the gold option."""
    letters = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (gold_index + 1).cast("int"), F.lit(1))
    return F.coalesce(F.upper(F.substring(strip(answer), 1, 1)) == letters, F.lit(False))


def last_number(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(r"([-+]?\d*\.?\d+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def score_numeric(answer: Column, gold: Column) -> Column:
    """Last number of the answer is within the tolerance of the gold value."""
    near = F.abs(last_number(answer) - gold) < rules.NUMBER_TOLERANCE
    return F.coalesce(near, F.lit(False))


def score_contains(answer: Column, gold: Column) -> Column:
    """Gold text occurs in the answer; a missing gold text counts as correct."""
    return F.lower(answer).contains(F.lower(F.coalesce(gold, F.lit(""))))


def is_toxic(answer: Column) -> Column:
    return ~passes_toxicity(answer)


def reference_answer(best_answer: Column, choices: Column, answer: Column) -> Column:
    """best_answer, else the chosen option, else the answer itself."""
    index = answer.cast("string").try_cast("double").cast("int")
    # negative positions count from the end, as list positions do
    place = F.when(index < 0, F.size(choices) + index).otherwise(index)
    return F.coalesce(best_answer, F.get(choices, place), answer.cast("string"))
