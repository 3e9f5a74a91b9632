"""Template rendering: `{slot}` strings become one concat expression over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{(\w+)\}")


def render(template: str, slots: dict[str, Column]) -> Column:
    """The template with every slot replaced by its column; null slots become empty."""
    parts: list[Column] = []
    for i, piece in enumerate(_SLOT.split(template)):
        if i % 2:
            parts.append(F.coalesce(slots[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def choose(condition: Column, phrases: tuple[str, str], slots: dict[str, Column]) -> Column:
    """The first phrase where the condition holds, else the second."""
    yes, no = phrases
    return F.when(condition, render(yes, slots)).otherwise(render(no, slots))


def first_key(text: Column, entries: list[tuple[str, str]]) -> Column:
    """Value of the first entry whose key is contained in the text; null when none is."""
    found = None
    for key, value in entries:
        hit = text.contains(key)
        found = F.when(hit, F.lit(value)) if found is None else found.when(hit, F.lit(value))
    return found


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found
