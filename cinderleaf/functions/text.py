"""Column functions over raw text: words, quality, toxicity, normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import guard_rules as rules

# Unicode white space plus the four information separators.
BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(text, rf"(?U){BLANK}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def squeeze(text: Column) -> Column:
    """Collapse every white-space run to one blank and trim."""
    return F.trim(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def letter_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return letters / F.greatest(F.length(text), F.lit(1))


def unique_word_ratio(text: Column) -> Column:
    """Null for blank text."""
    return let(words(text), lambda w: F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)))


def quality_score(text: Column) -> Column:
    """Unique-word ratio times letter ratio; zero outside the length, letter or repetition gates."""
    outside = ~F.length(text).between(rules.QUALITY_MIN_CHARS, rules.QUALITY_MAX_CHARS)

    def with_letters(alpha: Column) -> Column:
        repeated = F.lit(rules.QUALITY_MIN_UNIQUE)
        by_words = let(
            F.coalesce(unique_word_ratio(text), F.lit(0.0)),
            lambda unique: F.when(unique < repeated, 0.0).otherwise(F.least(F.lit(1.0), unique * alpha)),
        )
        return F.when(alpha < rules.QUALITY_MIN_ALPHA, 0.0).otherwise(by_words)

    return F.when(outside, 0.0).otherwise(let(letter_ratio(text), with_letters))


def passes_quality(text: Column, threshold: float = rules.QUALITY_PASS) -> Column:
    return quality_score(text) >= threshold


def count_hits(text: Column, patterns: list[str], flags: str) -> Column:
    """How many of the patterns occur in the text."""
    hits = F.lit(0)
    for pattern in patterns:
        hits = hits + text.rlike(f"(?{flags}){pattern}").cast("int")
    return hits


def toxicity_score(text: Column) -> Column:
    hits = count_hits(text, rules.TOXIC_PATTERNS, "Ui")
    return F.least(F.lit(1.0), hits * F.lit(rules.TOXIC_HIT))


def passes_toxicity(text: Column) -> Column:
    """No pattern occurs (one hit already exceeds the limit)."""
    return ~text.rlike("(?Ui)" + "|".join(rules.TOXIC_PATTERNS))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; only rows with a non-ASCII character travel to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def normalize_security(text: Column) -> Column:
    """NFKC, invisible marks removed, look-alike letters mapped to Latin."""
    source = "".join(a for a, _ in rules.LOOKALIKES)
    target = "".join(b for _, b in rules.LOOKALIKES)
    return F.coalesce(
        F.translate(nfkc(text), source + rules.INVISIBLE_MARKS, target), F.lit("")
    )


def normalize_whitespace(text: Column, compose: bool = True) -> Column:
    """Collapse white space and trim; `compose` applies NFKC first."""
    return squeeze(nfkc(text) if compose else text)


def safe_float(text: Column) -> Column:
    """First number in the text, 0 when there is none."""
    first = F.regexp_extract(text.cast("string"), r"[-+]?\d*\.\d+|\d+", 0)
    return F.coalesce(first.try_cast("double"), F.lit(0.0))


def md5_fraction(*parts: Column | str | int) -> Column:
    """A uniform draw in [0, 1) from the MD5 of the joined parts."""
    joined = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    head = F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")
    return head / F.lit(4294967296.0)


def draw(n: Column | int, *parts: Column | str | int) -> Column:
    """An integer draw in 0..n-1."""
    return F.floor(md5_fraction(*parts) * n).cast("int")
