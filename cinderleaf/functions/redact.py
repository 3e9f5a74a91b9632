"""Personal data and credential redaction as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import guard_rules as rules
from cinderleaf.functions.text import let, passes_toxicity


def contains_pii(text: Column) -> Column:
    found = F.lit(False)
    for _, pattern in rules.CORPUS_PII:
        found = found | text.rlike("(?U)" + pattern)
    return found


def redact_pii(text: Column) -> Column:
    """E-mail, phone, SSN and card numbers replaced by tags, in that order."""
    for tag, pattern in rules.CORPUS_PII:
        text = F.regexp_replace(text, "(?U)" + pattern, tag)
    return text


# Every phone and card pattern needs three digits in a row; texts without them skip the patterns.
DIGIT_RUN = r"(?U)\d{3}"


def replace_each(
    text: Column, pattern: str, decide: Callable[[Column], Column], gate: str | None = None
) -> Column:
    """Replace every match by `decide(match)`; text without a match of the gate is passed through."""

    def weave(value: Column) -> Column:
        woven = F.zip_with(
            F.split(value, pattern, -1),
            F.regexp_extract_all(value, F.lit(pattern), F.lit(0)),
            lambda gap, hit: F.concat(gap, F.when(hit.isNotNull(), decide(hit)).otherwise("")),
        )
        return F.when(value.rlike(gate or pattern), F.array_join(woven, "")).otherwise(value)

    return let(text, weave)


def hide_emails(text: Column) -> Column:
    hidden = F.regexp_replace(text, rules.EMAIL, "[REDACTED_EMAIL]")
    return F.when(text.contains("@"), hidden).otherwise(text)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"(?U)\D", "")


def luhn_valid(digits: Column) -> Column:
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda ch, i: F.when(i % 2 == 0, ch.cast("int"))
        .when(ch.cast("int") > 4, ch.cast("int") * 2 - 9)
        .otherwise(ch.cast("int") * 2),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _hide_phone(match: Column) -> Column:
    low, high = rules.PHONE_DIGITS
    size = F.length(_digits(match))
    return F.when(size.between(low, high), "[REDACTED_PHONE]").otherwise(match)


def _hide_card(match: Column) -> Column:
    digits = _digits(match)
    card = F.length(digits).isin(rules.CARD_DIGITS) & luhn_valid(digits)
    return F.when(card, "[REDACTED_CARD]").otherwise(match)


def _hide_contacts(text: Column) -> Column:
    return replace_each(hide_emails(text), "(?U)" + rules.ANY_PHONE, _hide_phone, DIGIT_RUN)


def scrub_pii(text: Column) -> Column:
    """E-mail, phone by digit count, identity numbers, Luhn-valid cards and coordinate pairs."""
    text = _hide_contacts(text)
    text = F.regexp_replace(text, "(?U)" + rules.OLD_NIC, "[REDACTED_NIC]")
    text = F.regexp_replace(text, "(?U)" + rules.NEW_NIC, "[REDACTED_NIC]")
    text = replace_each(text, "(?U)" + rules.CARD, _hide_card, DIGIT_RUN)
    return F.regexp_replace(text, "(?U)" + rules.GPS, "[REDACTED_GPS]")


def sanitize_credentials(text: Column) -> Column:
    """E-mail, phone by digit count, key=value secrets and token shapes."""
    text = _hide_contacts(text)
    text = F.regexp_replace(text, "(?U)" + rules.KEY_VALUE_SECRET, "$1: [REDACTED_KEY]")
    return F.regexp_replace(text, "(?U)" + rules.TOKEN_SHAPE, "[REDACTED_KEY]")


def scrub_guest_text(text: Column) -> Column:
    text = hide_emails(text)
    text = F.regexp_replace(text, "(?U)" + rules.LOCAL_PHONE, "[REDACTED_PHONE]")
    nic = f"(?U){rules.OLD_NIC}|{rules.NEW_NIC}"
    text = F.regexp_replace(text, nic, "[REDACTED_NIC]")
    text = F.regexp_replace(text, rules.SK_KEY, "[REDACTED_API_KEY]")
    return F.regexp_replace(text, rules.AIZA_KEY, "[REDACTED_GOOGLE_KEY]")


def redact_output(text: Column) -> Column:
    """Struct (text, ok): not ok for toxic text, personal data or a secret."""
    clean = passes_toxicity(text) & ~contains_pii(text)
    shown = F.when(clean, redact_pii(text)).otherwise(text)

    def judge(v: Column) -> Column:
        ok = v["clean"] & ~v["text"].rlike(rules.OUTPUT_SECRET)
        return F.struct(v["text"].alias("text"), ok.alias("ok"))

    return let(F.struct(clean.alias("clean"), shown.alias("text")), judge)


def _walk(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return sanitize_credentials(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _walk(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _walk(item, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitize_nested(df: DataFrame) -> DataFrame:
    """`sanitize_credentials` on every string of every column, at any depth."""
    return df.select(*[_walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
